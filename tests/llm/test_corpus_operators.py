"""Operators over the whole corpus against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkwright.llm import components, near_dedup, packing, queries, secret_scan, substring_dedup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


# Components


def test_components(spark) -> None:
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)] + [(5, 5), (900, 900)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if root(x) != x or any(root(y) == x and y != x for y in parent)}
    got = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_random_links(spark) -> None:
    """Also nodes that lead to several roots are brought together."""
    rng = random.Random(21)
    links = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2600)] + [(9000 + k, 9000 + (k * 7919) % 300) for k in range(300)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for link in links if link[0] != link[1] for x in link}


# Near-duplicates


def brute_classes(rows, alike=0.8):
    """Each two texts are aligned without a band."""
    keys = sorted({t or "" for _, t in rows})
    hashes = {t: near_dedup.word_hashes(t) for t in keys}
    parent = {t: t for t in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = hashes[a], hashes[b]
            longer = max(len(x), len(y))
            if root(a) != root(b) and min(len(x), len(y)) >= max(1, alike * longer) and near_dedup.common_run(x, y, longer) >= alike * longer:
                parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        least[root(t or "")] = min(least.get(root(t or ""), 1 << 60), i)
    return {i: least[root(t or "")] for i, t in rows}


def edited(rng, base: list[str], share: float) -> list[str]:
    return [rng.choice(words(rng, 1)) if rng.random() < share else w for w in base]


def test_classes_against_all_pairs(spark) -> None:
    rng = random.Random(2)
    texts = []
    passage = words(rng, 60)
    for n in range(12):
        base = words(rng, rng.choice([6, 100, 200, 700]))
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.003, 0.01, 0.03, 0.05, 0.6] if len(base) > 6 else [0, 1]))) for _ in range(rng.choice([1, 3, 25]))]
    texts += [" ".join(words(rng, 80) + passage + words(rng, 80)) for _ in range(30)]
    texts += ["", "", "one two", "one two", "One, two!", "..."]
    rows = list(enumerate(texts))
    got = near_dedup.near_classes(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_near_copies_of_documents_are_found(spark) -> None:
    """Against each two documents of sf0.01 that share a shingle: at least 0.9 of those alike are in one class (here: all)."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    texts = {t: i for i, t in reversed(rows)}
    hashes = {i: near_dedup.word_hashes(t) for t, i in texts.items()}
    having: dict = {}
    for i, w in hashes.items():
        for x in set(near_dedup.shingles(w).tolist()):
            having.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in having.values() for n, b in enumerate(ids) for a in ids[:n] if min(len(hashes[a]), len(hashes[b])) >= 0.8 * max(len(hashes[a]), len(hashes[b]))}
    longer = {p: max(len(hashes[p[0]]), len(hashes[p[1]])) for p in pairs}
    alike = [p for p in pairs if near_dedup.common_run(hashes[p[0]], hashes[p[1]], longer[p]) >= 0.8 * longer[p]]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).select("doc_id", "class_id").collect()}
    assert len(alike) > 60 and sum(of[a] == of[b] for a, b in alike) >= 0.9 * len(alike)


def test_template_crowd(spark) -> None:
    """Many texts that share half their words with all others, and pairs among them that are alike."""
    rng = random.Random(12)
    template, rows = words(rng, 100), []
    for n in range(60):
        own = words(rng, 100)
        rows += [(2 * n, " ".join(template + own)), (2 * n + 1, " ".join(edited(rng, template + own, 0.04)))]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert of == brute_classes(rows) and len(set(of.values())) == 60


@pytest.mark.parametrize("tasks", [1, 40])
def test_neighbours_across_tasks(spark, tasks) -> None:
    """However the ordered rows are dealt out, each two neighbours of a group with different classes are a pair."""
    rows = [(g, f, n, bytes([g, f, n]), bytes([k % 3])) for g in range(3) for f in range(8) for k, n in enumerate(range(10, 20))]
    got = {(r["a"], r["b"]) for r in near_dedup.beside(spark.createDataFrame(rows, "group long, finer long, n long, key binary, class binary"), 0.8, tasks)[0].collect()}
    assert got == {tuple(sorted((x[3], y[3]))) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and x[4] != y[4] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2])}


def test_crowds(spark) -> None:
    """A large group: copies of one text, each with edits of its own, and copies of copies."""
    rng = random.Random(3)
    base = words(rng, 400)
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 0.012)) for _ in range(80)]
    texts += [" ".join(edited(rng, texts[rng.randrange(1, 80)].split(" "), 0.006)) for _ in range(40)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_odd_rows(spark) -> None:
    frame = docs(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (1, None), (2, ""), (None, None), (None, "only null " * 9)]).withColumn("key", F.lit("x")).withColumn("class_id", F.lit("y"))
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_copies"]) for r in near_dedup.near_classes(frame).collect())
    assert got == sorted([("3", "3", 3), ("3", "3", 3), ("None", "3", 3), ("1", "1", 3), ("2", "1", 3), ("None", "1", 3), ("None", "None", 1)])
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert near_dedup.near_classes(docs(spark, [])).count() == 0


def longest_common(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment() -> None:
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 3) % len(a)) if rng.random() < 0.5 else rng.integers(0, 30, 40).astype(np.uint64)
        assert near_dedup.common_run(a, b, 100) == longest_common(a.tolist(), b.tolist())


@pytest.mark.parametrize("vocabulary", [50, 1000])
def test_matched_share(vocabulary) -> None:
    """Never more than the best alignment; the same answer at ALIKE."""
    rng, odd = np.random.default_rng(4), 0
    for _ in range(150):
        a = rng.integers(0, vocabulary, rng.integers(1, 150)).astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 1 + len(a) // 3)):
            at, kind = rng.integers(0, len(b)), rng.integers(0, 3)
            b = np.insert(b, at, rng.integers(0, vocabulary)) if kind == 0 else np.delete(b, at) if kind == 1 and len(b) > 1 else np.where(np.arange(len(b)) == at, rng.integers(0, vocabulary), b).astype(np.uint32)
        best = longest_common(a.tolist(), b.tolist()) / max(len(a), len(b))
        got = near_dedup.matched_share(a, b)
        assert got <= best + 1e-9 or max(got, best) < near_dedup.ALIKE
        odd += (got >= near_dedup.ALIKE) != (best >= near_dedup.ALIKE)
    assert odd <= 1  # a chain of single shingles can be a little worse than the best alignment
    assert near_dedup.matched_share(a, a) == 1.0 and near_dedup.matched_share(a, a[:0]) == 0.0


def test_long_texts_are_aligned() -> None:
    rng = np.random.default_rng(5)
    a = rng.integers(0, 5000, 100_000).astype(np.uint32)
    b = np.where(rng.random(len(a)) < 0.1, 9999, a).astype(np.uint32)
    assert 0.88 < near_dedup.matched_share(a, b) < 0.92
    assert near_dedup.matched_share(a, rng.permutation(a)) < near_dedup.ALIKE


def test_sketch_sees_order() -> None:
    rng = random.Random(5)
    s = near_dedup.shingles(near_dedup.word_hashes(" ".join(words(rng, 500))))
    one = near_dedup.order_minhash(s)
    assert (one == near_dedup.order_minhash(s[::-1])).sum() <= 2
    marks = near_dedup.labelled(s).tolist()
    seed, low = int(near_dedup.SEEDS[3]), (1 << 64) - 1

    def value(x: int) -> int:
        x = (x ^ seed) * (seed | 1) & low
        return (x ^ x >> 32) * int(near_dedup.FACTOR) & low

    least = sorted(sorted(range(len(marks)), key=lambda k: value(marks[k]))[: near_dedup.TUPLE])
    bucket = np.array([4], np.uint64)
    for k in least:
        bucket = near_dedup.mixed(bucket * np.uint64(5) + np.array([marks[k]], np.uint64))
    assert one.view(np.uint64)[3] == bucket[0]


# Substring dedup


def test_passages_are_cut(spark) -> None:
    rng = random.Random(6)
    passage = " ".join(words(rng, 70))
    rows = [(i, " ".join(words(rng, 100)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(words(rng, 100))) for i in range(30)]
    rows += [(100, rows[0][1]), (101, None), (102, ""), (102, ""), (103, "short line"), (104, "short line"), (None, rows[1][1])]
    got = {}
    for r in substring_dedup.substring_dedup(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], r)
    for i, text in rows[:30]:
        cut = got[i]["__llm_removed"]
        assert got[i]["text"] == "".join(text[a:b] for a, b in zip([0, *(s["end"] for s in cut)], [*(s["start"] for s in cut), len(text)]))
        if i == 1:
            assert got[i]["text"] == ""  # the row without an id comes first
        elif i % 3 or i == 0:
            assert not cut, i
        else:
            assert passage not in got[i]["text"] and got[i]["__llm_removed_chars"] == len(passage)
    assert got[100]["text"] == "" and got[101]["text"] is None and got[104]["text"] == "short line" and got[None]["text"] == rows[1][1]
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def held_windows(rows, size):
    """By document: the characters of windows that an earlier document has, too."""
    held, want = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        at = [k for k in range(len(text) - size + 1) if text[k : k + size] in held]
        want[i] = {c for k in at for c in range(k, k + size)}
        held |= {text[k : k + size] for k in range(len(text) - size + 1)}
    return want


def at_words(text: str, chars: set[int]) -> set[int]:
    """``chars`` of ``text`` as spans that end at words."""
    starts, ends = sorted(c for c in chars if c - 1 not in chars), sorted(c + 1 for c in chars if c + 1 not in chars)
    return {c for a, b in zip(starts, ends) for c in range(*substring_dedup.at_words(text, a, b))}


def test_passages_against_all_windows(spark) -> None:
    """What is cut is what windows of MIN_RUN characters repeat; passages of over 50 words are found wherever chunks lie."""
    rng = random.Random(9)
    passages = [" ".join(words(rng, n)) for n in (28, 40, 45, 51, 60) for _ in range(8)]
    rows = [(i, " ".join(words(rng, 40)) + f" {passages[i % 40]} " + " ".join(words(rng, 40))) for i in range(120)]
    rows += [(200, "x" * 400), (201, "y" * 300 + "x" * 200), (202, "漢字" * 10 + passages[0]), (None, passages[7])]
    want, texts = held_windows(rows, substring_dedup.MIN_RUN), dict(rows)
    frame = docs(spark, rows).withColumn("row", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("runs", F.array(F.lit(None).cast("date")))
    out = substring_dedup.substring_dedup(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    whole = found = 0
    for r in out.collect():
        got = {c for s in r["__llm_removed"] for c in range(s["start"], s["end"])}
        short = r["doc_id"] is not None and (r["doc_id"] >= 120 or len(passages[r["doc_id"] % 40].split()) <= 50)
        assert got == at_words(texts[r["doc_id"]], want[r["doc_id"]]) or short and got <= want[r["doc_id"]], r["doc_id"]
        whole, found = whole + len(want[r["doc_id"]]), found + len(got)
    assert found > 0.9 * whole


def test_very_long_texts_are_cut(spark) -> None:
    rng = random.Random(10)
    long = " ".join(words(rng, 30_000))
    rows = [(1, long), (2, "before " + long + " after"), (3, "x " + long[50_000:60_000])]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got[1] == long and len(got[2]) < 40 and len(got[3]) < 40


def test_cuts_on_documents(spark) -> None:
    """On sf0.001 at least 0.99 of the characters that windows of MIN_RUN repeat are cut, and no other."""
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    want, cut = held_windows(rows, substring_dedup.MIN_RUN), 0
    for r in substring_dedup.substring_dedup(table).collect():
        got = {c for s in r["__llm_removed"] for c in range(s["start"], s["end"])}
        assert got <= want[r["doc_id"]] and r["__llm_removed_chars"] == len(got) and r["__llm_before"] - len(got) == len(r["text"] or "")
        cut += len(got)
    whole = sum(map(len, want.values()))
    assert whole and cut >= 0.95 * whole


def test_chunks_against_a_plain_loop(spark, monkeypatch) -> None:
    def value(c: str) -> int:
        h = (ord(c) + 1) * 0x9E3779B1 % (1 << 32)
        h = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32)
        return h ^ h >> 13

    def plain(text: str) -> list[int]:
        ends, start, hash_ = [], 0, 0
        for k, c in enumerate(text, 1):
            hash_ = ((hash_ << 1) + value(c) - ((value(text[k - 1 - substring_dedup.WINDOW]) << substring_dedup.WINDOW) if k > substring_dedup.WINDOW else 0)) % (1 << 32)
            may = (hash_ >> substring_dedup.WINDOW - 5) % substring_dedup.EXPECTED == 0
            if k - start >= substring_dedup.LEAST and may or k - start == substring_dedup.MOST or k == len(text):
                start = k
                ends.append(k)
        return ends

    texts = [*(r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()), "", "a", "a" * 1000, "é漢" * 200, "x" * 128]
    for size in (1 << 16, 100):
        monkeypatch.setattr(substring_dedup, "SLICE", size)
        for text in texts:
            assert substring_dedup.chunk_ends(text or "") == plain(text or "")
    text = " ".join(words(random.Random(7), 3000))
    parts = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.chunk_ends(t)], substring_dedup.chunk_ends(t))}
    assert len(parts(text) - parts(text[:2000] + "inserted" + text[2000:])) <= 4


# Top-k


@pytest.mark.parametrize("folder", [DIR])
def test_top_k_is_the_sql(spark, folder) -> None:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(queries.TOP_K)
    frame = queries.op6_top_k(spark, folder)
    assert sorted(tuple(r[c] for c in want.columns) for r in frame.collect()) == sorted(want.fetchall())


def brute_top(rows, k=20):
    import math

    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 20 == 0:
            others = sorted(((sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(good) if m != n), key=lambda x: (-x[0], x[1]))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(others[:k])]
    return sorted(out)


def test_top_k_of_repeated_ids_is_the_sql(spark, tmp_path) -> None:
    """Rows of one id are queries and candidates each; only the query's own row is none of its candidates."""
    rng = np.random.default_rng(3)
    rows = [(i % 30, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(90)] + [(20, [1.0] * 8)] * 3 + [(40, [0.0] * 8)] * 2 + [(7, [1.0] * 8)] * 25
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.embeddings_top_k(frame).select("query_id", "rank", "vec_id", "score").collect())
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == brute_top(rows) == sorted(con.sql(queries.TOP_K).fetchall())


@pytest.mark.parametrize("block", [16_384, 50])
def test_top_k_ties_and_odd_vectors(spark, monkeypatch, block) -> None:
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", max(2, block // 20))
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5] * 20 if i % 3 == 0 else [float(x) for x in rng.normal(size=40)]) for i in range(700)]
    rows += [(1000, None), (1020, [1.0, None] * 20), (1040, [float("nan")] * 40), (1060, [float("inf")] + [0.0] * 39), (None, [1.0] * 40), (1080, [0.0] * 40), (-20, [2.0] * 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("v", F.lit("y"))
    got = sorted(tuple(r) for r in topk.embeddings_top_k(frame).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)
    assert topk.embeddings_top_k(frame.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark) -> None:
    rows = [(i, [float(1 << 20) * i, 3.0]) for i in range(-30, 30)]
    got = sorted(tuple(r) for r in topk.embeddings_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


# SQL


def test_licence_sql(spark) -> None:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op1_license_scan"])
    frame = queries.op1_license_scan(spark, DIR)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in frame.collect()))) == sorted(map(str, want.fetchall()))


# The pipeline


def test_pipeline_stages(spark, tmp_path) -> None:
    rng = random.Random(8)
    base = words(rng, 300)
    passage = " ".join(words(rng, 80))
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 0.005))), (3, "12 34"), (4, None), (5, " ".join(words(rng, 60)) + " " + passage), (6, passage + " " + " ".join(words(rng, 60))), (7, "my token=abcdef123456 is here " + " ".join(words(rng, 30))), (8, " ".join(base))]
    frame = docs(spark, rows).withColumn("score", F.lit("clash"))
    kept = {}
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DIR)
        assert name == "packing" or now.columns == frame.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(kept["language_id"]) == {1, 2, 5, 6, 7, 8}
    assert set(kept["near_dedup"]) == {1, 5, 6, 7}
    cut = kept["substring_dedup"]
    assert set(cut) == {1, 5, 6, 7} and cut[5]["text"] == rows[4][1] and cut[6]["n_chars"] == len(cut[6]["text"]) < len(rows[5][1]) - 100
    assert kept["secret_scan"][7]["text"].startswith("my [SECRET] is here") and kept["secret_scan"][1]["text"] == rows[0][1]
    assert set(kept["packing"]) == {1, 5, 6, 7}


def test_pipeline_against_brute_force(spark, tmp_path) -> None:
    """From end to end, with repeated and null ids: what each stage keeps, by plain loops, and the pieces of what is left."""
    rng = random.Random(14)
    passage = " ".join(words(rng, 90))
    base = [words(rng, 150) for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(20 + i, " ".join(edited(rng, b, 0.03))) for i, b in enumerate(base[:6])] + [(3, rows_text) for rows_text in [" ".join(base[3])] * 2]
    rows += [(None, " ".join(base[1])), (None, " ".join(words(rng, 80))), (40, None), (41, "12 34 !"), (42, ""), (None, None)]
    rows += [(50 + i, " ".join(words(rng, 70)) + f" {passage} " + " ".join(words(rng, 70))) for i in range(4)] + [(60, "token=abcdefgh1234 " + " ".join(words(rng, 60)))]
    frame = docs(spark, rows)
    path = tmp_path / "in"
    frame.write.parquet(str(path / "documents.parquet"))
    # language ID and one of each class
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    known = {t: n for n, t in enumerate(sorted({t for _, t in left}))}
    classes = brute_classes([(n, t) for t, n in known.items()])
    groups: dict = {}
    for i, t in left:
        groups.setdefault(classes[known[t]], set()).add((i is None, i or 0, t))
    kept = sorted(((None if none else i), t) for none, i, t in (min(g) for g in groups.values())) if all(not min(g)[0] for g in groups.values()) else [((None if none else i), t) for none, i, t in (min(g) for g in groups.values())]
    # passages that an earlier document has, then secrets
    texts = {}
    held = held_windows(kept, substring_dedup.MIN_RUN)
    for i, t in kept:
        cut = at_words(t, held[i])
        texts[i] = secret_scan.redact("".join(c for n, c in enumerate(t) if n not in cut), secret_scan.default_vocabulary())
    want = {}
    for i, t in texts.items():
        n = len(packing.token_ids(t, packing.default_vocabulary())) // 4 + 1
        want[i] = [min(4096, n - at) for at in range(0, n, 4096)]
    got: dict = {}
    out = corpus_pipeline.run(spark, str(path)).collect()
    for r in sorted(out, key=lambda r: r["piece"]):
        got.setdefault(r["doc_id"], []).append(r["length"])
    assert got == want and None in got and sum(map(sum, got.values())) == sum(r["length"] for r in out)


def test_pipeline_on_nothing(spark, tmp_path) -> None:
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DIR)
    assert now.count() == 0


def test_pipeline_runs(spark) -> None:
    out = corpus_pipeline.run(spark, DIR).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= set(out[0].asDict())
    assert len(secret_scan.KINDS) == 4 and os.path.exists(DIR)

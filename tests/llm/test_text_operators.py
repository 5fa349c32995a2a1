"""The row-by-row text operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwright.llm import fingerprint, language, license_scan, packing, pii, queries, secret_scan, sentence_pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"
ODD = [(1, None), (None, "a b"), (2, ""), (3, "  \n\t"), (4, "x" * 5000), (4, "x" * 5000), (5, "one two\nthree"), (6, "日本語 テキスト é😀")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def odd(spark, *, taken: str):
    """Odd rows with extra columns whose names clash with results."""
    frame = docs(spark, ODD)
    for name in taken.split():
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


# Personal data


def brute_pii(text: str) -> dict:
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    found = {
        "email": re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": (m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))),
        "card": (m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in v] for k, v in found.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-_% 0123459()é\n", max_size=60))
def test_pii_is_the_patterns(text) -> None:
    got = pii.find(text, pii.automaton())
    assert {k: got.get(k, []) for k in pii.BASE} == brute_pii(text)


def test_pii_on_documents(spark) -> None:
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = queries.op3_pii(spark, DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_pii(rows[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(v) for v in want.values()]
        listed = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_pii_more_kinds() -> None:
    text = "IBAN: DE89 3704 0044 0532 0130 00, iban DE88370400440532013000, ssn 123-45-6789, ssn 000-45-6789, ftp://me:pw@h.org/x, mailto:a@b.org"
    got = pii.find(text, pii.automaton())
    assert len(got["iban"]) == 1 and len(got["ssn"]) == 1 and len(got["login"]) == 1 and len(got["mailto"]) == 1


def test_pii_cues_in_any_case_and_lengths_by_country() -> None:
    auto = pii.automaton()
    found = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t, auto).items() if k not in pii.BASE}
    iban = "DE89 3704 0044 0532 0130 00"
    for cue in ("IBAN: ", "Iban ", "iban=", "İ Iban: "):
        assert found(f"{cue}{iban} The bank") == {"iban": [iban]}
    assert found("iban de89370400440532013000.") == {"iban": ["de89370400440532013000"]}
    assert found("IBAN DE89 3704 0044 0532 0130 01") == {} and found("IBAN DE89 3704") == {} and found("IBAN ZZ89 3704 0044 0532 0130 00") == {}
    assert found("IBAN GB82WEST12345698765432X") == {} and found("IBAN GB82 WEST 1234 5698 7654 32 x") == {"iban": ["GB82 WEST 1234 5698 7654 32"]}
    assert found("Ssn 123-45-6789, SOCIAL SECURITY NUMBER: 219-09-9999") == {"ssn": ["123-45-6789", "219-09-9999"]}
    assert found("HTTP://me:pw@host.org/") == {"login": ["HTTP://me:pw@host.org"]}
    assert found("see https://example.org/~ann.other, https://x.example.org/users/bob and https://example.org/shop") == {"profile": ["https://example.org/~ann.other", "https://x.example.org/users/bob"]}
    assert found("Account number: 12345 67890; acct 123") == {"account": ["12345 67890"]}


def test_pii_long_runs_of_digits() -> None:
    assert pii.find("1" * 200_000 + "." + "0" * 5000 + "1.1.1", pii.automaton()) is not None


# Secrets


def brute_secrets(text: str) -> dict:
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    return {
        "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "AKIA", "0123456789abcdef", "ZZ", "é", "paſſword=abcdefgh"]), max_size=14).map("".join))
def test_secrets_are_the_patterns(text) -> None:
    got = secret_scan.find(text, secret_scan.default_vocabulary())
    assert {k: got.get(k, []) for k in secret_scan.BASE} == brute_secrets(text)


def test_secrets_random_strings_only() -> None:
    find = lambda t: secret_scan.find(t, secret_scan.default_vocabulary()).get("random", [])
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    assert find(f"see {key} here") == [(4, 44)]
    for clean in ("550E8400-E29B-41D4-A716-446655440000", "sha256: " + hashlib.sha256(b"x").hexdigest().upper(), "internationalization-of-2-documents-and-words", "20240101000000000000000000", "keitlichenlichkeitbeheit", f"sha512-{key}"):
        assert find(clean) == [], clean


def test_secrets_of_letters_and_after_a_digests_name() -> None:
    rng, vocabulary = random.Random(4), secret_scan.default_vocabulary()
    small, both = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = ["".join(rng.choice(s) for _ in range(n)) for s in (small, both) for n in (24, 40, 64) for _ in range(30)]
    assert sum("random" in secret_scan.find(f"see {k} here", vocabulary) for k in made) >= 0.97 * len(made)
    for text in ("internationalization and Donaudampfschifffahrtsgesellschaft", "src/main/java/com/example/application", "ArrayIndexOutOfBoundsException", "x" * 60, "=" * 40, "12345678901234567890123"):
        assert "random" not in secret_scan.find(text, vocabulary), text
    key = "q7Zk2Xv9Lw4Rt8Yp3Ns6Hd1Gf5"
    assert "random" in secret_scan.find(f"commit: {key}", vocabulary)
    assert "random" not in secret_scan.find("integrity: " + "q7Zk2Xv9Lw4Rt8Yp3Ns6Hd1Gf5Jb0MzQc8VxKa2WeT4=", vocabulary)


def brute_all_secrets(text: str) -> dict:
    known = {
        "assign": [m.span() for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    spans = [x for v in known.values() for x in v]
    encode = secret_scan.encoding(secret_scan.default_vocabulary()).encode_ordinary
    known["random"] = [
        m.span()
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text)
        if re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in spans) and len(m[0]) < 2.1 * len(encode(m[0]))
        and not secret_scan.KNOWN.fullmatch(m[0]) and not (secret_scan.DIGEST.fullmatch(m[0]) and secret_scan.DIGEST_NAME.search(text, max(0, m.start() - 16), m.start()))
    ]
    return {k: v for k, v in known.items() if v}


def test_secret_report_against_brute_force(spark) -> None:
    """The query's rows, digests and all spans, on documents and on texts full of overlapping spans."""
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, " ".join(rng.choice([f"token={key(30)}", key(24), "%040x" % rng.getrandbits(160), "AKIA" + key(20).upper(), f"commit {'%040X' % rng.getrandbits(160)}", "word"]) for _ in range(60))) for i in range(20)]
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs(spark, rows)).collect()}
    order = (*secret_scan.BASE, "random")
    for i, text in rows:
        want = brute_all_secrets(text or "")
        spans = sorted((a, order.index(k), b, k) for k, v in want.items() for a, b in v)
        base = ",".join(f"{k}:{a}:{b}" for a, n, b, k in spans if n < 3)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(len(want.get(k, ())) for k in secret_scan.BASE)


def test_many_secrets_take_linear_time() -> None:
    text = " ".join(f"token=abc{i:06d}xyz" for i in range(20_000))
    began = time.process_time()
    assert len(secret_scan.find(text, secret_scan.default_vocabulary())["assign"]) == 20_000 and time.process_time() - began < 5


def test_redaction() -> None:
    text = "a token=abcdef12 b AKIA" + "A" * 16 + " c"
    assert secret_scan.redact(text, secret_scan.default_vocabulary()) == "a [SECRET] b [SECRET] c"


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcXYZ'sStT09 \n\té Éßſ!?.,<|endoftx>_²½Σσςİŉ́\x1c\x85漢"), max_size=40))
def test_ids_are_the_librarys(tokenizer, text) -> None:
    assert np.frombuffer(packing.token_ids(text, packing.default_vocabulary()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, tokenizer) -> None:
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc_id, got in by.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        got.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in got] == list(range(0, len(ids), 4096)) and sum(r["length"] for r in got) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in got)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len(places) <= least * 1.1 + 8


def test_packing_documents(spark, tokenizer) -> None:
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    check_packing(queries.op7_packing(spark, DIR).collect(), texts, tokenizer)


def test_packing_odd_rows(spark, tokenizer) -> None:
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "x" * 30_000)]
    check_packing(packing.packed(docs(spark, rows)).collect(), dict(rows), tokenizer)
    assert packing.packed(odd(spark, taken="piece start sequence_id")).count() == len(ODD)
    assert packing.packed(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest() -> None:
    fit = packing.BestFit(10, 2)
    assert fit.place(6) == (0, 0)
    assert fit.place(7) == (1, 0)
    assert fit.place(3) == (1, 7)
    assert fit.place(8) == (2, 0)
    assert fit.place(9) == (3, 0)  # bin 2, with the least space, has closed
    assert fit.place(2) == (0, 6)


def plain_best_fit(sizes: list[int], length: int, most: int) -> list[tuple[int, int]]:
    """Every open bin is looked at; the fullest closes, and of equally full ones the one that was filled last."""
    open_: list[list[int]] = []  # free, when filled, number
    out, made = [], 0
    for now, size in enumerate(sizes):
        fits = [b for b in open_ if b[0] >= size]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[1]))
            open_.remove(best)
        else:
            if len(open_) >= most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
            best, made = [length, 0, made], made + 1
        out.append((best[2], length - best[0]))
        if best[0] > size:
            open_.append([best[0] - size, now + 1, best[2]])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 12))
def test_places_are_those_of_a_plain_best_fit(sizes, most) -> None:
    fit = packing.BestFit(40, most)
    assert [fit.place(x) for x in sizes] == plain_best_fit(sizes, 40, most)


def test_packing_is_tight_with_the_bound(spark) -> None:
    """More pieces than a block has, in one task: at most one sequence in a hundred more than the tokens need, and never more open bins than allowed."""
    rng = random.Random(2)
    rows = [(i, 0, 0, min(4096, int(rng.lognormvariate(6, 1.2)) + 1), i) for i in range(20_000)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 1).collect()
    filled: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(out) == len(rows) and max(filled.values()) <= 4096
    assert len(filled) <= 1.01 * -(-sum(r[3] for r in rows) // 4096)
    fit = packing.BestFit(4096, 8)
    for r in rows:
        fit.place(r[3])
        assert fit.open <= 8


# Language


def test_language_held_out(spark) -> None:
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.languages(table).collect()
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def invented(rng, letters: str, n: int) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_languages_of_one_family_and_of_others(spark) -> None:
    """Four Romance languages and one outside; one has a text of many copies, which mustn't crowd its other texts out."""
    rng = random.Random(3)
    letters = {"fr": "aeiouyzbcd", "es": "aeioumnlrs", "it": "aeioupqtvg", "ro": "aeioufhjkw", "fi": "äöyktpvhjl"}
    rows = [(i, invented(rng, letters[lang], 40), lang) for i, lang in enumerate(sorted(letters) * 60)]
    rows += [(1000 + i, "le meme texte encore", "fr") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, sample=40)
    assert [len(model.langs[f][1]) for f in sorted(model.langs)] == [6, 0]  # Romance, Uralic
    held = [r for r in language.languages(table, model).join(table.select("doc_id", "lang"), "doc_id").collect() if r["held_out"] and r["doc_id"] < 1000]
    assert len({r["lang"] for r in held}) == 5 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(r["score"] > 0.2 for r in held)


def test_many_languages_are_bounded(spark, monkeypatch) -> None:
    monkeypatch.setattr(language, "LANGUAGES", 5)
    monkeypatch.setattr(language, "SAMPLE_OF_ALL", 20)
    table = docs(spark, [(i, f"some text number {i}") for i in range(400)]).withColumn("lang", F.concat(F.lit("x"), (F.col("doc_id") % 40).cast("string")))
    model = language.train(table)
    assert len(model.families) <= 5 and language.languages(table, model).count() == 400


def test_duels(monkeypatch) -> None:
    """The winner of most duels is the prediction, and its closest duel the score."""
    weights = np.zeros((3, language.FEATURES + 1))
    weights[:, -1] = 1.0, 1.0, -2.0  # a beats b and c, c beats b
    model = language.Model(("f",), np.zeros((1, language.FEATURES + 1)), {"f": (("a", "b", "c"), weights)})
    assert model.predict("text") == ("a", pytest.approx(1 / (1 + np.exp(-6.0))))


def test_language_sees_the_text_only(spark) -> None:
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.train(table)
    other = table.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1).withColumn("source", F.lit(None).cast("string"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(table, model).collect()}
    b = {r["doc_id"] - 1: (r["lang_pred"], r["score"]) for r in language.languages(other, model).collect()}
    assert a == b


def test_language_odd_rows(spark) -> None:
    got = language.languages(odd(spark, taken="score lang_pred held_out")).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert language.languages(docs(spark, [])).count() == 0
    unlabelled = docs(spark, [(1, "hello there")]).withColumn("lang", F.lit(None).cast("string"))
    assert language.languages(unlabelled).first()["lang_pred"] == "und"


def test_features_are_the_same_in_slices(monkeypatch) -> None:
    text = "The quick  brown\nfox é " * 50
    whole = language.features(text)
    monkeypatch.setattr(language, "SLICE", 37)
    assert np.dot(whole, language.features(text)) > 0.99


# Licences


def test_licences(spark) -> None:
    mit = license_scan.MIT
    rows = [
        (1, "Copyright (c) 2020 Ann Other\n\n" + mit),
        (2, "THE MIT LICENCE (MIT)\nCopyright 2019-2021 X, Inc. All rights reserved.\n" + mit.upper().replace(",", " ,").replace("\n", "\n\n")),
        (3, mit + " and more"),
        (4, "Some text.\nReleased under the MIT licence\nmore\n  Licensed under CC BY-NC 4.0!\nReleased under the MIT License."),
        (5, license_scan.ZLIB.replace("acknowledgment", "acknowledgement")),
        (6, None),
        (7, "Copyright (c) 2020 Ann Other"),
    ]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "CC-BY-NC-4.0,MIT"), 5: ("Zlib", ""), 6: (None, ""), 7: (None, "")}
    own = spark.createDataFrame([("mine", "Do as you like!"), ("other", None)], "license_id string, text string")
    found = license_scan.license_scan(docs(spark, [(1, "do  as you LIKE"), (2, "no")]), own).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == {1: "mine", 2: None}
    assert license_scan.license_scan(odd(spark, taken="license_id text_digest digest")).count() == len(ODD)
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_licences_wrapped_and_named(spark) -> None:
    """A text's digest doesn't depend on where its lines end, nor on who holds the copyright, with a year or without."""
    bsd = f"{license_scan.BSD_GRANT} {license_scan.BSD_THIRD} {license_scan.BSD_REST}".replace("\n", " ")
    rows = [(n, "Copyright Ann Other\n\n" + textwrap.fill(bsd, n)) for n in range(40, 120, 7)]
    rows += [(200, "All\nRights\nReserved\n" + bsd), (201, "Copyright by Ann\n" + bsd.replace("copyright holder", "copyright\nowner")), (202, "Copyright Holder\n" + bsd)]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got == {i: "BSD-3-Clause" if i != 202 else None for i, _ in rows}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="the texts aren't on this machine")
def test_full_texts_of_long_licences(spark) -> None:
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {}
    for name in names:
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as file:
            texts[name] = file.read()
    rows = [(n, t) for n, t in enumerate(texts.values())] + [(100 + n, " ".join(t.split())) for n, t in enumerate(texts.values()) if "opyright (C)" not in t]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert [got[n] for n in range(len(texts))] == list(names.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ",".join("(?, ?)" for _ in rows) + ") t(doc_id, text)", [x for r in rows for x in r])
    assert {r[0]: r[2] for r in con.sql(license_scan.oracle()).fetchall()} == got


# Fingerprints


def test_fingerprints_against_sets(spark) -> None:
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 7, 400, 900])))) for i in range(30)] + [(40, None), (41, ""), (42, "..."), (43, "a b c d e f"), (44, "A, b c d e f!")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprint.against_edit(docs(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + nxt[:quarter]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(t):
            w = [x for x in re.split(r"[^a-z0-9]+", t.lower()) if x]
            return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

        a, b = shingles(text), shingles(edited)
        if len(a | b) > 300:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.2
        if a == b:
            assert r["near_edited"] == 1.0
    assert got[43]["fingerprint"] == got[44]["fingerprint"] != ""
    assert got[40]["fingerprint"] == got[42]["fingerprint"] == ""


def brute_sketch(text: str, scale: int = fingerprint.SCALE) -> list[int]:
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
    out = set()
    for k in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[k : k + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(signed(h))
    low = {x for x in out if x < -(1 << 63) + (1 << 64) // scale}
    return sorted(low) if low else sorted(out)[:1]


def test_sketches_against_brute_force(spark) -> None:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    base = [word() for _ in range(3000)]
    rows = [(i, " ".join(base[a : a + n])) for i in range(40) for a, n in [(rng.randrange(2000), rng.choice([0, 2, 5, 9, 60, 600]))]] + [(50, " ".join(base * 30)), (51, None), (51, "x y")]
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], tie(r[1])))
    places = {(i, len(t)): n for n, (i, t) in enumerate(order)}
    got = sorted(fingerprint.against_edit(docs(spark, rows)).collect(), key=lambda r: places[r["doc_id"], r["n_chars"]])
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    hexed = lambda a: ",".join(f"{x % (1 << 64):016x}" for x in a)
    for k, ((i, text), r) in enumerate(zip(order, got, strict=True)):
        nxt, quarter = order[(k + 1) % len(order)][1], len(text) // 4
        a, b, c = (brute_sketch(t) for t in (text, text[: len(text) - quarter] + nxt[:quarter], nxt))
        assert (r["doc_id"], r["fingerprint"], r["edited_fingerprint"]) == (i, hexed(a), hexed(b))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_containment_of_short_texts(spark) -> None:
    """A text wholly in another one is held by it, or, where no hash of it lies below the threshold, nothing is said."""
    rng = random.Random(12)
    long = [str(rng.randrange(10**6)) for _ in range(5000)]
    parts = [(i, " ".join(long[a : a + 6 + i % 20])) for i in range(60) for a in [rng.randrange(4900)]] + [(100, ""), (101, "?!")]
    frame = docs(spark, parts).select("doc_id", fingerprint.sketch(F.col("text")).alias("a"), fingerprint.sketch(F.lit(" ".join(long))).alias("b"))
    held = {r["doc_id"]: r["held"] for r in frame.select("doc_id", fingerprint.containment(F.col("a"), F.col("b")).alias("held")).collect()}
    assert set(held.values()) == {1.0, None} and held[100] == held[101] == 1.0 and sum(v == 1.0 for v in held.values()) > 20


def test_fingerprints_of_many_ranges(spark, monkeypatch) -> None:
    """Also where many rows have one id, or none: they are in several ranges, and each row's next one is right."""
    monkeypatch.setattr(fingerprint, "DOCS_A_RANGE", 7)
    rows = [(i * i, f"text number {i} of these") for i in range(100)] + [(900, f"again {i}") for i in range(80)] + [(None, f"nothing {i}") for i in range(60)] + [(5, "twice")] * 2
    got = fingerprint.with_next(docs(spark, rows).select("doc_id", "text"), ["text"], "next_").collect()
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    want = sorted((str(i), text, nxt) for (i, text), (_, nxt) in zip(order, order[1:] + order[:1]))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == want


def test_sketches_merge(spark) -> None:
    rng = random.Random(4)
    a, b = ([str(rng.randrange(10**6)) for _ in range(300)] for _ in range(2))
    both = " ".join(a) + " " + " ".join(b)
    row = docs(spark, [(1, "")]).select(fingerprint.sketch(F.lit(" ".join(a))).alias("a"), fingerprint.sketch(F.lit(" ".join(b))).alias("b"), fingerprint.sketch(F.lit(both)).alias("c"))
    row = row.select(fingerprint.merge(F.col("a"), F.col("b")).alias("m"), "c", fingerprint.containment(F.col("a"), F.col("c")).alias("held")).first()
    assert set(row["m"]) <= set(row["c"]) and len(row["c"]) - len(row["m"]) <= 4 and row["held"] == 1.0


def test_fingerprints_odd_rows(spark) -> None:
    assert fingerprint.against_edit(odd(spark, taken="sketch fingerprint next_text edited")).count() == len(ODD)
    assert fingerprint.against_edit(docs(spark, [])).count() == 0
    assert fingerprint.against_edit(docs(spark, [(1, "only one")])).first()["near_next"] == 1.0


# Sentence pieces

TEXTS = st.one_of(st.text(alphabet="abcde thing  \n", max_size=300), st.text(alphabet="etaoinshrdlu", max_size=300), st.text(max_size=60).filter(lambda t: "▁" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([17, 40, 100]))
def test_scan_is_the_librarys_encoding(text, chunk) -> None:
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    whole = sentence_pieces.escaped(text)
    parts = []
    for low in range(0, len(whole), chunk):
        from_, high = max(0, low - vocab.longest), min(low + chunk, len(whole))
        parts.append((whole[from_ : high + vocab.longest], low - from_, high - from_, low == 0))
    matrices = [sentence_pieces.matrix(vocab, *p) for p in parts]
    right = sentence_pieces.states(matrices) if parts else []
    ids = [sentence_pieces.trace(vocab, *p, a, b) for p, a, b in zip(parts, [(0, 0), *right[:-1]], right)]
    assert [i for x in ids for i in x] == vocab.library.encode(text)
    assert "".join(sentence_pieces.decode(vocab, x, n == 0) for n, x in enumerate(ids)) == text.replace("\0", "\0")


def test_products_are_associative() -> None:
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    whole = sentence_pieces.escaped("internationalization of things " * 6)
    m = []
    for low in range(0, len(whole), 30):
        from_, high = max(0, low - vocab.longest), min(low + 30, len(whole))
        m.append(sentence_pieces.matrix(vocab, whole[from_ : high + vocab.longest], low - from_, high - from_, low == 0))
    product = sentence_pieces.product
    assert product(product(m[0], m[1]), m[2]) == product(m[0], product(m[1], m[2]))


@pytest.mark.parametrize("block", [2, 3, 64])
def test_borders_by_blocks_are_those_of_one_walk(block) -> None:
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    whole = sentence_pieces.escaped("internationalization of things and others, unbelievably " * 8)
    m = []
    for low in range(0, len(whole), 17):
        from_, high = max(0, low - vocab.longest), min(low + 17, len(whole))
        m.append(sentence_pieces.matrix(vocab, whole[from_ : high + vocab.longest], low - from_, high - from_, low == 0))
    whole_way = sentence_pieces.states(m)
    blocks = [m[k : k + block] for k in range(0, len(m), block)]
    ends = sentence_pieces.states([sentence_pieces.combined(b) for b in blocks])
    got = [s for b, left, right in zip(blocks, [(0, 0), *ends[:-1]], ends) for s in sentence_pieces.states(b, left, right)]
    assert got == whole_way and ends == whole_way[block - 1 :: block] + ([whole_way[-1]] if len(m) % block else [])


def test_production_chunks_give_the_librarys_ids(spark) -> None:
    """At the query's own CHUNK: texts of several chunks, words without blanks among them, and more chunks than a block has."""
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    rng, n = random.Random(5), sentence_pieces.CHUNK
    mixed = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(3 * n // 6))
    rows = [(1, mixed), (2, "ab" * n), (3, "".join(rng.choice("etaoin") for _ in range(2 * n + 5))), (4, "x" * n), (5, "é" * (n - 1)), (6, (mixed * 30)[: 70 * n])]
    got = {r["doc_id"]: r for r in sentence_pieces.encoded(docs(spark, rows)).collect()}
    for i, text in rows:
        assert got[i]["ids"] == vocab.library.encode(text) and got[i]["round_trip"] and got[i]["n_chars"] == len(text)


def test_encoded_tables(spark) -> None:
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    rows = [*ODD, (7, "many words here " * 300), (8, "y" * 3000)]
    got = sentence_pieces.encoded(docs(spark, rows).withColumn("ids", F.lit("clash")), chunk=1000).collect()
    assert sorted({(r["doc_id"] or -1, tuple(r["ids"])) for r in got}) == sorted({(i or -1, tuple(vocab.library.encode(t or ""))) for i, t in rows})
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    without = sentence_pieces.encoded(docs(spark, rows), chunk=1000, with_ids=False)
    assert sorted(map(str, without.collect())) == sorted(str(r) for r in spark.createDataFrame(got).drop("ids").collect())
    assert sentence_pieces.encoded(docs(spark, [])).count() == 0


def test_repeated_rows_of_every_length_are_given_each(spark) -> None:
    vocab = sentence_pieces.vocabulary(sentence_pieces.default_vocabulary())
    long = "many words here " * 100
    rows = [(1, "short")] * 2 + [(None, "short")] * 2 + [(2, long)] * 3 + [(None, long)] * 2 + [(None, "2:" + long), (3, long)]
    got = sentence_pieces.encoded(docs(spark, rows), chunk=1000).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"], tuple(r["ids"])) for r in got) == sorted((i or -1, len(t), tuple(vocab.library.encode(t))) for i, t in rows)


def test_reports_of_odd_rows(spark) -> None:
    assert pii.pii_report(odd(spark, taken="spans n_email kind")).count() == len(ODD)
    assert secret_scan.secret_report(odd(spark, taken="spans n_hex")).count() == len(ODD)
    assert pii.pii_spans(docs(spark, [(1, "a@b.org")])).first()["value"] == "a@b.org"
    assert secret_scan.secret_spans(docs(spark, [(1, "token=abcdefg")])).first()["kind"] == "assign"
    assert pii.pii_report(docs(spark, [])).count() == secret_scan.secret_report(docs(spark, [])).count() == 0

"""Operators against truth tables and plain Python."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwright import functions as fn
from chunkwright.operators import chunking, history, ingest, integrity, locks, patterns, store, workspace

TRUTH = [
    ("...", "x/y", True, True),
    ("", "x", True, True),
    ("assets/...", "assets", True, True),
    ("assets/...", "assets/a/b.psd", True, True),
    ("assets/...", "assets2/x", False, False),
    ("assets", "assets/a.psd", True, False),
    ("assets/", "assets/a.psd", True, False),
    ("assets/a.psd", "assets/a.psd", True, True),
    ("*.psd", "x/y/a.psd", True, False),
    ("*.psd", "x/psd", True, False),
    ("*.tar.gz", "a.tar.gz", False, False),
    ("assets/*.psd", "assets/deep/a.psd", True, False),
    ("assets/*", "assets/deep/a.psd", True, False),
    ("hero*", "hero.psd", False, False),
    ("hero*", "hero*", True, True),
    (" assets ", "assets/a", True, False),
    ("assets\\deep", "assets/deep/a", True, False),
]


def test_patterns(spark) -> None:
    for pattern, path, local, remote in TRUTH:
        row = spark.range(1).select(F.lit(path).alias("p")).select(patterns.matches(pattern, F.col("p")).alias("l"), patterns.matches(pattern, F.col("p"), "remote").alias("r")).first()
        assert (row["l"], row["r"]) == (local, remote), (pattern, path)


def test_filters_reach_the_scan(spark, tmp_path) -> None:
    spark.createDataFrame([("a/b", 1), ("c", 2)], "path string, size long").write.parquet(str(tmp_path / "f"))
    plan = spark.read.parquet(str(tmp_path / "f")).where(patterns.in_view(F.col("path"), ("a/...",)))._jdf.queryExecution().toString()
    assert "StringStartsWith(path,a/)" in plan


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 64), st.integers(0, 100), st.integers(0, 400))
def test_cut_tiles(data, least, more, most) -> None:
    sizes = chunking.Sizes(least, least + more, least + more + most)
    ends = chunking.cut(data, sizes)
    assert ends == sorted(set(ends)) and ends[-1] == len(data)
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert not data or all(n <= sizes.most for n in lengths) and all(n >= sizes.least for n in lengths[:-1])


def test_cut_shifts_little() -> None:
    data = random.Random(5).randbytes(200_000)
    sizes = chunking.Sizes(512, 2048, 8192)
    parts = lambda d: {d[a:b] for a, b in zip([0, *chunking.cut(d, sizes)], chunking.cut(d, sizes))}
    a, b = parts(data), parts(data[:5000] + b"abc" + data[5000:])
    assert len(a - b) <= 3
    windows = chunking.cut(data, sizes, 50_000)
    assert {50_000, 100_000, 150_000, 200_000} <= set(windows)


def test_packing_starts_anew(spark) -> None:
    sizes = [5, 3, 4, 20, 1, 1, 9, 2]
    rows = spark.createDataFrame([("g", n, s) for n, s in enumerate(sizes)], "g string, n int, s long")
    got = [r["page"] for r in store.packed_in_order(rows, ["g"], ["n"], F.col("s"), 10, "page").orderBy("n").collect()]
    want, page, used = [], 0, 0
    for n, s in enumerate(sizes):
        if n and used and used + s > 10:
            page, used = page + 1, 0
        used += s
        want.append(page)
    assert got == want


def chain(spark, n: int, extra=()):
    return spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)] + list(extra), "id string, parent string")


@pytest.mark.parametrize("small", [200_000, 10])
def test_history(spark, monkeypatch, small) -> None:
    monkeypatch.setattr(history, "SMALL", small)
    commits = chain(spark, 150)
    assert [r["id"] for r in history.log(commits, "149").orderBy("depth").collect()] == [str(i) for i in reversed(range(150))]
    assert [r["id"] for r in history.log(commits, "9", stop="6").orderBy("depth").collect()] == ["9", "8", "7"]
    assert history.log(commits, "9", most=2).count() == 2
    assert history.log(commits, None).count() == 0 and history.log(commits, "none").count() == 0
    assert history.is_ancestor(commits, "3", "3").first()[0] == "yes"
    assert history.is_ancestor(commits, "3", "9").first()[0] == "yes"
    assert history.is_ancestor(commits, "9", "3").first()[0] == "no"
    assert history.is_ancestor(commits.where("id <> '5'"), "3", "9").first()[0] == "unknown"


@pytest.mark.parametrize("small", [200_000, 1])
def test_history_cycle(spark, monkeypatch, small) -> None:
    monkeypatch.setattr(history, "SMALL", small)
    commits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string")
    assert sorted(r["id"] for r in history.log(commits, "a").collect()) == ["a", "b", "c"]


def test_first_missing(spark) -> None:
    remote = chain(spark, 10)
    local = remote.where("id in ('9', '8', '4', '3')")
    assert sorted(r["id"] for r in history.first_missing(remote, local, "9").collect()) == ["5", "6", "7"]
    assert history.first_missing(remote, remote, "9").count() == 0
    assert history.first_missing(remote, remote.limit(0), "9", 3).count() == 3


def test_locks_against_a_model(spark) -> None:
    rng = random.Random(3)
    ops = [(f"p{rng.randrange(5)}", f"u{rng.randrange(3)}", rng.choice(["lock", "unlock"]), n) for n in range(400)]
    holders, want = {}, {}
    for path, owner, op, seq in ops:
        holder = holders.get(path)
        if op == "lock":
            want[seq] = "ok" if holder in (None, owner) else "conflict"
            holders[path] = holder or owner
        else:
            want[seq] = "ok" if holder == owner else "mismatch"
            holders[path] = None if holder == owner else holder
    out = locks.replay(spark.createDataFrame(ops, "path string, owner string, op string, seq long"))
    assert {r["seq"]: r["outcome"] for r in out.collect()} == want
    assert {r["path"]: r["owner"] for r in locks.held(out).collect()} == {p: o for p, o in holders.items() if o}


def test_access(spark) -> None:
    who = spark.createDataFrame([("t1", "ann"), ("t2", "bob"), ("t3", "cy")], "token string, identity string")
    acl = spark.createDataFrame([("game", "ann", "write"), ("game", "bob", "read"), ("film", "cy", "admin")], "repo string, identity string, access string")
    asks = spark.createDataFrame([(r, t, a) for r in ("game", "film", "new") for t in ("t1", "t2", "t3", "t9") for a in ("read", "write")], "repo string, token string, access string")
    got = {(r["repo"], r["token"], r["access"]): r["verdict"] for r in locks.authorized(asks, who, acl).collect()}
    ok = {k for k, v in got.items() if v == "ok"}
    assert ok == {("game", "t1", "read"), ("game", "t1", "write"), ("game", "t2", "read"), ("film", "t3", "read"), ("film", "t3", "write")}
    assert all(v == "unauthenticated" for k, v in got.items() if k[1] == "t9")
    free = locks.authorized(asks, who, acl.limit(0)).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in free} == {"ok": 18, "unauthenticated": 6}


def test_remote_sources(spark) -> None:
    rows = spark.createDataFrame([("cw://h:1/a/b/",), ("cws://h/x",), ("nothing",), ("http://h",), ("http:///x",), ("ftp://h/x",)], "s string")
    got = [tuple(r["p"]) for r in rows.select(fn.remote_parts(F.col("s")).alias("p")).collect()]
    assert got[:2] == [("http://h:1", "a/b", None), ("https://h", "x", None)]
    assert [g[2] for g in got[2:]] == ["no scheme in nothing", "no repository named in http://h", "host or repository is empty in http:///x", "no way to reach scheme ftp"]


def test_commit_id_leaves_the_author_out(spark) -> None:
    import hashlib

    files = spark.createDataFrame([([("b", "d2", 2), ("a", "d1", 1)],)], "files array<struct<path:string,file_digest:string,size:bigint>>")
    got = files.select(fn.commit_id(F.lit(None).cast("string"), F.lit("m"), F.lit(7), F.col("files"))).first()[0]
    assert got == hashlib.sha256(b"rootm7ad11bd22").hexdigest()
    rows = spark.createDataFrame([("c", None, "m", 7, "b", "d2", 2), ("c", None, "m", 7, "a", "d1", 1), ("d", "c", "n", 8, "a", "d1", 1)], "commit string, parent string, message string, timestamp long, path string, file_digest string, size long")
    assert {r["commit"]: r["id"] for r in ingest.commit_ids(rows).collect()} == {"c": got, "d": hashlib.sha256(b"cn8ad11").hexdigest()}


def test_boundary_reuse_and_same_content(spark) -> None:
    data = random.Random(1).randbytes(20_000)
    sizes = chunking.Sizes(256, 1024, 4096)
    blob = lambda d: spark.createDataFrame([("f", bytearray(d))], "path string, content binary")
    previous = chunking.refs(chunking.content_chunks(blob(data), sizes, small=0)).cache()
    old = [r["c"]["offset"] for r in previous.select(F.explode("chunks").alias("c")).collect()]
    for new in (data + b"x" * 3000, data[:-2500]):
        rows = chunking.boundary_reuse(blob(new), previous, sizes)
        assert integrity.tiling(rows, spark.createDataFrame([("f", len(new))], "path string, size long")).first()["tiles"]
        starts = {r["offset"] for r in rows.collect()}
        assert {o for o in old if o < len(new) - 4096} <= starts
    assert chunking.same_as_before(blob(data), previous).first()["same"]
    assert not chunking.same_as_before(blob(data[:-1] + b"?"), previous).first()["same"]


def test_route_of_equal_files(spark) -> None:
    files = spark.createDataFrame([("a", 50, 1, "x"), ("b", 50, 1, "x"), ("c", 5, 1, "y"), ("d", 50, 1, "k")], "path string, size long, modified int, file_digest string")
    none = spark.createDataFrame([], "path string, size long, modified int, file_digest string")
    got = {r["path"]: r["way"] for r in ingest.routed(files, none, files.where("path = 'd'"), small=10, large=100).collect()}
    assert got == {"a": "chunked", "b": "cache_hit", "c": "small", "d": "cache_hit"}


def test_status_of_nothing(spark) -> None:
    row = workspace.status(spark.createDataFrame([], "path string, state string, commit_id string, file_digest string, size long")).first()
    assert row["hydrated"] == 0 and row["dirty_paths"] == ""

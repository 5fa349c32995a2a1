"""Random snapshots against a plain model of opening, refreshing and comparing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chunkwright import streaming
from chunkwright.operators import store, sync, workspace
from chunkwright.sources.shared import shared_folder

INDEX = "path string, state string, commit_id string, file_digest string, size long"
FILES = "path string, file_digest string, size long"


@pytest.mark.parametrize("seed", range(3))
def test_opening(spark, seed) -> None:
    rng = random.Random(seed)
    paths = [f"d{n % 4}/f{n}" for n in range(60)]
    digest = lambda: rng.choice("abc")
    index = {p: (rng.choice(["Virtual", "Hydrated", "NotInView"]), digest()) for p in paths if rng.random() < 0.7}
    target = {p: digest() for p in paths if rng.random() < 0.7}
    visible = {p for p in target if not p.startswith("d1/")}
    disk = {p for p in paths if rng.random() < 0.6}
    keep = lambda p: p in index and index[p] == ("Hydrated", target.get(p)) and p in disk
    gone = {p for p, (s, d) in index.items() if s == "Hydrated" and (p not in target or p not in visible or d != target[p])} | {p for p in target if p not in visible or not keep(p)}
    states = {p: "NotInView" if p not in visible else "Hydrated" if keep(p) else "Virtual" for p in target}

    frames = (
        spark.createDataFrame([(p, s, "old", d, 1) for p, (s, d) in index.items()], INDEX),
        spark.createDataFrame([(p, d, 1) for p, d in target.items()], FILES),
        spark.createDataFrame([(p,) for p in visible], "path string"),
        spark.createDataFrame([(p,) for p in disk], "path string"),
    )
    assert {r["path"] for r in workspace.cleanup_paths(*frames).collect()} == gone
    assert {r["path"]: r["state"] for r in workspace.opened(*frames, F.lit("new")).collect()} == states
    before = frames[0].select("path", "file_digest")
    changes = {r["path"]: r["change"] for r in workspace.difference(before, frames[1]).collect()}
    assert changes == {p: "added" if p not in index else "removed" if p not in target else "same" if index[p][1] == target[p] else "changed" for p in {*index, *target}}


def test_refresh(spark) -> None:
    index = spark.createDataFrame([(p, s, "c", "x", 1) for p, s in (("gone", "Hydrated"), ("same", "Dirty"), ("other", "Hydrated"), ("touched", "Hydrated"), ("out", "NotInView"))], INDEX)
    disk = spark.createDataFrame([("same", 1, 5, "x"), ("other", 1, 5, "y"), ("touched", 1, 6, "x"), ("out", 1, 5, "q")], "path string, size long, modified int, digest string")
    manifest = spark.createDataFrame([("other", 1, 4, "x"), ("same", 1, 5, "x")], "path string, size long, modified int, file_digest string")
    got = {r["path"]: r["state"] for r in workspace.refreshed(index, disk, manifest).collect()}
    assert got == {"gone": "Virtual", "same": "Hydrated", "other": "Dirty", "touched": "Hydrated", "out": "NotInView"}


def test_store(spark) -> None:
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "id string, raw_len long")
    have = spark.createDataFrame([("b", 2)], "id string, raw_len long")
    assert sorted(r["id"] for r in store.new_chunks(batch, have).collect()) == ["a", "c"]
    assert {r["id"]: r["was_new"] for r in store.put_results(batch, have).collect()} == {"a": True, "b": False, "c": True}
    assert store.first_missing(batch, have).first()["id"] == "a" and store.first_missing(have, batch).isEmpty()
    refs = spark.createDataFrame([("z",)], "id string")
    empty = spark.createDataFrame([], "id string, segment_id long, offset long")
    with pytest.raises(Exception, match="object not found: z"):
        store.checked(store.resolve(refs, empty)).collect()


def test_fetch_takes_hot_files_or_those_asked_for(spark) -> None:
    files = spark.createDataFrame([("code/a", 10, [("1",)]), ("code/big", 1 << 20, [("2",)]), ("art/x", 10, [("3",), ("1",)])], "path string, size long, chunks array<struct<id:string>>")
    none = spark.createDataFrame([], "id string")
    ids = lambda f: sorted(r["id"] for r in f.collect())
    assert ids(sync.to_fetch(files, none, default_only=True)) == ["1"]
    assert ids(sync.to_fetch(files, none, ("art",))) == ["1", "3"]
    assert ids(sync.to_fetch(files, spark.createDataFrame([("1",)], "id string"))) == ["2", "3"]


def test_lock_stream_keeps_holders_between_batches(spark, tmp_path) -> None:
    schema = "path string, owner string, op string, seq long"
    for n, rows in enumerate(([("p", "ann", "lock", 1)], [("p", "bob", "lock", 2), ("p", "ann", "unlock", 3)], [("p", "bob", "lock", 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    out = streaming.drained(streaming.lock_outcomes(streaming.stream(spark, str(tmp_path / "ops"), files_a_trigger=1)), shared_folder(spark))
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["ok", "conflict", "ok", "ok"]

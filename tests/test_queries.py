"""Each query of the catalogue beside its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from chunkwright.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(rows, columns) -> list:
    return sorted((tuple(str(r[c]) for c in sorted(columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name) -> None:
    frame = catalogue.QUERIES[name](spark, DIR)
    got = plain((r.asDict() for r in frame.collect()), frame.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == sorted(frame.columns)
    assert got == plain((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), want.columns)


def test_deep_check_hashes_every_blob(spark, monkeypatch) -> None:
    seen = []
    monkeypatch.setattr(catalogue.integrity, "wrong_files", lambda *tables: seen.extend(tables) or tables[0])
    catalogue.QUERIES["fsck_deep"](spark, DIR)
    want = {r[0] for r in catalogue.snapshot(spark, DIR, "a").select("file_digest").collect()}
    for frame, name in zip(seen, ("file_digest", "id", "id"), strict=True):
        assert {r[0] for r in frame.select(name).collect()} == want


def test_every_candidate_is_repeated(spark, monkeypatch) -> None:
    seen = []
    monkeypatch.setattr(catalogue.ingest, "candidates", lambda rows: seen.append(rows) or rows)
    catalogue.QUERIES["candidate_dedup"](spark, DIR)
    counts = {r["path"]: r["count"] for r in seen[0].groupBy("path").count().collect()}
    assert {p for p, n in counts.items() if n == 2} == {r["path"] for r in catalogue.blobs(spark, DIR).select("path").collect()} and len(counts) - 1 == sum(n == 2 for n in counts.values())

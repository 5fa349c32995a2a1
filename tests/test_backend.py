"""A repository as a backend, and what a server does besides."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from chunkwright import functions as fn
from chunkwright.operators import locks, reporting, sync
from chunkwright.sources import files as tree
from chunkwright.sources.backend import LocalBackend
from chunkwright.sources.legacy import load_index
from chunkwright.sources.repository import Config, NotFastForward, NotFound, Repository, RepositoryError

SMALL = Config(chunk_min=1024, chunk_avg=4096, chunk_max=16384, small_file=8192)


def put(root, path: str, data: bytes) -> None:
    to = os.path.join(root, path)
    os.makedirs(os.path.dirname(to), exist_ok=True)
    with open(to, "wb") as file:
        file.write(data)


@pytest.fixture
def backend(spark, tmp_path) -> LocalBackend:
    repo = Repository.init(spark, str(tmp_path / "served"), SMALL)
    put(repo.root, "code/a.txt", b"a text\n")
    put(repo.root, "assets/b.bin", bytes(range(256)) * 100)
    repo.add()
    repo.commit("first", "ann", 1)
    return LocalBackend(repo)


def stored(spark, *datas: bytes):
    rows = [(hashlib.sha256(d).hexdigest(), len(d), len(s), c, s) for d in datas for c, s in [tree.packed(d)]]
    return spark.createDataFrame(rows, "id string, raw_len long, stored_len long, compressed boolean, data binary")


def test_a_clients_calls(spark, backend, tmp_path) -> None:
    """A commit is sent: chunks, then the commit, then the head; and read back."""
    assert backend.get_config()["chunk_avg"] == 4096
    head = backend.get_head()
    new = b"more " * 3000
    ident = hashlib.sha256(new).hexdigest()
    ids = spark.createDataFrame([(ident,), ("0" * 64,)], "id string")
    assert backend.has_objects(ids).isEmpty()
    files = spark.createDataFrame([("c2", "code/new.txt", len(new), ident, [(ident, 0, len(new), len(new))])], backend.repository.read("commit_files").schema)
    commit = spark.createDataFrame([("c2", head, "bob", "second", 2, False, 1)], backend.repository.read("commits").schema)
    with pytest.raises(NotFound):
        backend.put_commit(commit, files)  # its chunk isn't there
    with pytest.raises(RepositoryError):
        backend.put_chunks(stored(spark, new).withColumn("id", F.lit("f" * 64)))
    assert [r["was_new"] for r in backend.put_chunks(stored(spark, new)).collect()] == [True]
    assert [r["was_new"] for r in backend.put_chunks(stored(spark, new)).collect()] == [False]
    assert [r["id"] for r in backend.has_objects(ids).collect()] == [ident]
    with pytest.raises(NotFound):
        backend.update_head("c2", head)
    with pytest.raises(NotFound):
        backend.put_commit(commit.withColumn("parent", F.lit("gone")), files)
    assert backend.put_commit(commit, files) and not backend.put_commit(commit, files)
    with pytest.raises(NotFastForward):
        backend.update_head("c2", None)
    backend.update_head("c2", head)
    assert backend.get_head() == "c2" and [r["id"] for r in backend.log().collect()] == ["c2", head]
    meta, none = backend.get_commit("c2", metadata_only=True)
    assert meta.first()["files_omitted"] and none.isEmpty()
    assert backend.get_commit("c2")[1].first()["path"] == "code/new.txt"
    with pytest.raises(NotFound):
        backend.get_commit("c9")
    assert {r["path"] for r in backend.get_manifest(head, ("assets/...",)).collect()} == {"assets/b.bin"}
    assert {r["path"] for r in backend.get_manifest(head, hot_only=True).collect()} == {"code/a.txt"}
    assert backend.get_chunks([ident]).first()["data"] == new
    assert {r["id"] for r in backend.stream_chunks(ids.where(F.col("id") == ident)).collect()} == {ident}
    with pytest.raises(NotFound):
        backend.stream_chunks(ids)
    backend.lock_path("code/a.txt", "ann")
    assert backend.list_locks("code").first()["owner"] == "ann"
    backend.unlock_path("code/a.txt", "ann")
    who = spark.createDataFrame([("t1", "ann")], "token string, identity string")
    assert backend.current_identity("Bearer t1", who) == "ann" and backend.current_identity("Bearer t2", who) is None


def test_old_index_is_migrated_once(spark, tmp_path) -> None:
    lines = tmp_path / "index.jsonl"
    folder = str(tmp_path / "index")
    assert load_index(spark, folder, str(lines)).isEmpty()
    lines.write_text("\n".join([json.dumps({"id": f"{n:02x}", "segment_id": 1, "offset": n, "raw_len": 3, "stored_len": 2, "compressed": True}) for n in (9, 1, 5, 1)] + ["broken {", "{}"]))
    assert [r["id"] for r in load_index(spark, folder, str(lines)).orderBy("id").collect()] == ["01", "05", "09"]
    lines.unlink()
    assert load_index(spark, folder, str(lines)).count() == 3


def test_repository_paths_and_credentials(spark) -> None:
    rows = spark.createDataFrame([("/a/b/",), ("a\\b",), ("",), ("/",), ("a/../b",), ("a..b/c",)], "s string")
    got = [tuple(r["p"]) for r in rows.select(fn.repo_path(F.col("s")).alias("p")).collect()]
    assert [g[0] for g in got] == ["a/b", "a/b", None, None, None, "a..b/c"] and [g[1] is None for g in got] == [True, True, False, False, False, True]
    repos = spark.createDataFrame([("org/game",), ("org/film",), ("art/film",)], "repo string")
    asks = spark.createDataFrame([("org/film",), ("film",), ("game",), ("none",), ("../game",)], "asked string")
    found = {r["asked"]: r["repo"] for r in locks.served(asks, repos).collect()}
    assert found == {"org/film": "org/film", "film": None, "game": "org/game", "none": None, "../game": None}
    lines = spark.createDataFrame([(" ann ", "t1"), ("", "t"), ("ann", " "), ("a:b", "t"), ("ann", "t\nx")], "i string, t string")
    assert [r[0] for r in lines.select(fn.credential_line(F.col("i"), F.col("t"))).collect()] == ["ann:t1", None, None, None, None]
    kept = spark.createDataFrame([("http://h", "own"), (None, "any")], "endpoint string, credential string")
    asked = spark.createDataFrame([("http://h",), ("http://x",)], "endpoint string")
    assert {r["endpoint"]: r["credential"] for r in locks.with_credentials(asked, kept).collect()} == {"http://h": "own", "http://x": "any"}
    assert {r["credential"] for r in locks.with_credentials(asked, kept.limit(0)).collect()} == {None}


def test_reports(spark, backend) -> None:
    repo = backend.repository
    assert reporting.said("commit", commit="a" * 64) == "committed " + "a" * 12 and reporting.said("add", count=1) == "1 file staged" and reporting.said("hydrate", count=2) == "2 files hydrated in all"
    assert reporting.error_text(NotFound("no commit x")) == "not found: no commit x"
    text = reporting.stats_text(repo.stats()).first()["text"]
    assert "1 commit, 0 without files" in text and "on disk" in text
    assert reporting.fsck_text(repo.fsck()).first()["text"] == "nothing is wrong"
    put(repo.root, "code/a.txt", b"changed")
    shown = reporting.status_text(repo.status(), ("code/...",), ("x",)).first()["text"]
    assert "in view: code/..., but for x" in shown and "changed:\n  code/a.txt" in shown
    log = reporting.log_text(repo.log().withColumn("n_files", F.lit(2)), repo.head).first()["text"]
    assert log.startswith(f"{repo.head[:12]} (head) by ann, 2 files")
    chain = repo.log().select("id")
    assert reporting.push_text(sync.push_report(chain, chain, repo.head)).first()["text"] == f"head there is now {repo.head[:12]}; sent 1 commit, 1 chunk"
    assert reporting.pull_text(sync.push_report(chain, chain, repo.head)).first()["text"].endswith("fetched 1 commit")
    repo.lock("code/a.txt", "ann")
    assert reporting.lock_lines(repo.locks()).first()["line"] == "code/a.txt is held by ann"

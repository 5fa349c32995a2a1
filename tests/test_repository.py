"""The workflows of a repository, on folders of their own."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import random
import threading

import pytest

from chunkwright.operators import chunking
from chunkwright.sources import files as tree
from chunkwright.sources.repository import ConcurrentChange, Config, DirtyWorkspace, LockConflict, NotFastForward, NotFound, Repository, RepositoryError

SMALL = Config(chunk_min=1024, chunk_avg=4096, chunk_max=16384, small_file=8192)


def put(root, path: str, data: bytes) -> None:
    to = os.path.join(root, path)
    os.makedirs(os.path.dirname(to), exist_ok=True)
    with open(to, "wb") as file:
        file.write(data)


def states(repo: Repository) -> dict[str, str]:
    return {r["path"]: r["state"] for r in repo.refresh().collect()}


@pytest.fixture
def repo(spark, tmp_path) -> Repository:
    root = str(tmp_path / "one")
    made = Repository.init(spark, root, SMALL)
    put(root, "code/plan.txt", b"step one")
    put(root, "config/view.ini", b"wide")
    put(root, "assets/sky.bin", bytes(range(256)) * 200)
    return made


def test_add_commit_open_round_trip(repo) -> None:
    assert repo.add() == 3
    first = repo.commit("first", "ann", 1)
    assert repo.head == first and repo.read("staging").isEmpty()
    put(repo.root, "code/plan.txt", b"step one, step two")
    with pytest.raises(DirtyWorkspace):
        repo.open(first)
    assert repo.add(("code",)) == 1
    second = repo.commit("second", "ann", 2)
    assert [r["id"] for r in repo.log().collect()] == [second, first]
    # a commit has what was staged only
    assert [r["path"] for r in repo.files(second).collect()] == ["code/plan.txt"]
    repo.open(first)
    assert open(f"{repo.root}/code/plan.txt", "rb").read() == b"step one"
    assert [r["id"] for r in repo.log().collect()] == [first]  # opening moves the head
    assert repo.fsck().isEmpty() and repo.fsck(deep=True).isEmpty()
    assert repo.hydrate(("assets",)) == 3
    assert repo.dehydrate(("assets/sky.bin",)) == 1
    assert not os.path.exists(f"{repo.root}/assets/sky.bin")
    assert repo.hydrate() == 3
    assert open(f"{repo.root}/assets/sky.bin", "rb").read() == bytes(range(256)) * 200
    put(repo.root, "assets/sky.bin", b"other")
    with pytest.raises(DirtyWorkspace):
        repo.dehydrate()
    assert repo.status().first()["dirty"] == 1
    # unchanged files are staged without being read; nothing new is stored
    before = repo.read("chunks").count()
    assert repo.add(("code",)) == 1 and repo.read("chunks").count() == before


def ways(repo: Repository) -> dict[str, str]:
    return {r["path"]: r["way"] for r in repo.routes()[0].collect()}


def noise(seed: int, size: int) -> bytes:
    return random.Random(seed).randbytes(size)


def test_router_reads_and_stores_as_little_as_it_can(spark, tmp_path, monkeypatch) -> None:
    """Each way of taking in a file: what is read, what is cut and what is stored."""
    repo = Repository.init(spark, str(tmp_path / "one"), dataclasses.replace(SMALL, large_file=100_000, large_window=1 << 20))
    big, other = noise(1, 400_000), noise(2, 60_000)
    put(repo.root, "a/big.bin", big)
    put(repo.root, "a/other.bin", other)
    put(repo.root, "a/small.txt", b"small")
    assert set(ways(repo).values()) == {"chunked", "small"}
    repo.add()
    stored = repo.read("chunks").count()
    assert ways(repo) == dict.fromkeys(("a/big.bin", "a/other.bin", "a/small.txt"), "unchanged")
    # a copy of known content, a file that was touched, one that has grown, one that is new twice, one that is new
    put(repo.root, "b/copy.bin", other)
    os.utime(f"{repo.root}/a/small.txt", (1, 1))
    os.utime(f"{repo.root}/a/other.bin", (1, 1))
    put(repo.root, "a/big.bin", big + noise(3, 50_000))
    put(repo.root, "c/1.bin", noise(4, 30_000))
    put(repo.root, "c/2.bin", noise(4, 30_000))
    routed = ways(repo)
    assert routed == {"b/copy.bin": "cache_hit", "a/small.txt": "same_content", "a/other.bin": "same_content", "a/big.bin": "boundary_reuse", "c/1.bin": "chunked", "c/2.bin": "cache_hit"}
    cut = []
    real = tree.cut_files
    monkeypatch.setattr(tree, "cut_files", lambda files, *more: cut.extend(r["path"] for r in files.collect()) or real(files, *more))
    assert repo.add() == 6
    assert sorted(cut) == ["a/big.bin", "c/1.bin"]  # nothing else is read to be cut
    former = {r["path"]: r["chunks"] for r in repo.read("manifest_index").collect()}
    assert former["c/1.bin"] == former["c/2.bin"] and former["b/copy.bin"] == former["a/other.bin"]
    grown = sum(c["len"] for c in former["a/big.bin"])
    assert grown == 450_000 and repo.read("chunks").count() - stored <= len(former["c/1.bin"]) + 50_000 // 1024 + 2
    commit = repo.commit("all", "ann", 1)
    other = Repository.clone(spark, repo.root, str(tmp_path / "two"), hydrate_all=True)
    for path in ("a/big.bin", "b/copy.bin", "c/2.bin", "a/small.txt"):
        assert open(f"{other.root}/{path}", "rb").read() == open(f"{repo.root}/{path}", "rb").read()
    assert other.head == commit and other.fsck(deep=True).isEmpty()


def test_files_beyond_the_bounds_of_a_row(spark, tmp_path, monkeypatch) -> None:
    """With bounds lowered a file passes in many windows and batches, and no row holds more than a chunk."""
    monkeypatch.setattr(tree, "BATCH_BYTES", 10_000)
    repo = Repository.init(spark, str(tmp_path / "one"), dataclasses.replace(SMALL, large_file=50_000, large_window=30_000))
    data = noise(5, 300_001)
    put(repo.root, "big.bin", data)
    put(repo.root, "text.txt", b"the same line again\n" * 5000)
    put(repo.root, "empty", b"")
    repo.add()
    repo.commit("c", "ann", 1)
    chunks = {r["path"]: r["chunks"] for r in repo.read("manifest_index").collect()}
    assert {c["offset"] % 30_000 == 0 for c in chunks["big.bin"]} >= {True} and {k * 30_000 for k in range(11)} <= {c["offset"] for c in chunks["big.bin"]}
    assert max(r["raw_len"] for r in repo.read("chunks").collect()) <= 16384
    lines = [r for r in repo.read("chunks").collect() if r["compressed"]]
    assert lines and all(r["stored_len"] == len(r["data"]) < r["raw_len"] for r in lines)
    repo.dehydrate()
    assert repo.hydrate() == 3
    assert open(f"{repo.root}/big.bin", "rb").read() == data and open(f"{repo.root}/empty", "rb").read() == b""
    assert repo.stats().first()["disk_bytes"] > 300_000


def test_chunks_by_id(repo) -> None:
    repo.add()
    put(repo.root, "more.bin", noise(6, 40_000))
    repo.add()
    ids = [r["id"] for r in repo.read("chunks").select("id").collect()]
    got = repo.get_chunks(ids[:5])
    assert {hashlib.sha256(r["data"]).hexdigest() for r in got.collect()} == {r["id"] for r in got.collect()} == set(ids[:5])
    with pytest.raises(NotFound):
        repo.get_chunks([ids[0], "0" * 64])
    assert len(repo._parts("chunks")) == 2
    repo.compact()
    assert len(repo._parts("chunks")) == 1 and sorted(r["id"] for r in repo.read("chunks").collect()) == sorted(ids)
    assert "PushedFilters: [In(id" in repo.read("chunks").where(f"id IN ('{ids[0]}', 'x')")._jdf.queryExecution().toString()
    repo.add()
    repo.commit("c", "ann", 1)
    assert repo.fsck(deep=True).isEmpty()


def test_partial_clone_fetches_what_is_asked_for(spark, repo, tmp_path) -> None:
    """History without files, chunks of hot files only; the rest comes when it is hydrated or opened."""
    repo.add()
    first = repo.commit("first", "ann", 1)
    put(repo.root, "assets/new.bin", noise(7, 30_000))
    repo.add()
    second = repo.commit("second", "ann", 2)
    other = Repository.clone(spark, repo.root, str(tmp_path / "two"), partial=True)
    assert [r["id"] for r in other.log().collect()] == [second, first]
    assert other.files(first).isEmpty() and other.stats().first()["metadata_only"] == 2
    held = other.read("chunks").count()
    assert states(other) == {"code/plan.txt": "Hydrated", "config/view.ini": "Hydrated", "assets/sky.bin": "Virtual", "assets/new.bin": "Virtual"} and held == 2
    with pytest.raises(NotFound):
        other.hydrate(("assets/sky.bin",))
    assert other.hydrate(("assets/sky.bin",), remote=repo.root) == 3
    assert open(f"{other.root}/assets/sky.bin", "rb").read() == bytes(range(256)) * 200
    with pytest.raises(NotFound):
        other.open(first)
    other.open(first, remote=repo.root)
    assert other.head == first and "assets/new.bin" not in states(other) and {r["path"] for r in other.current_files().collect()} == {r["path"] for r in repo.files(first).collect()}
    third_root = repo.root
    put(third_root, "code/fourth.txt", b"third")
    repo.add(("code",))
    third = repo.commit("third", "ann", 3)
    report = other.pull(partial=True).first()
    assert (report["new_head"], report["commit_count"], report["chunk_count"]) == (third, 2, 1) and other.head == third
    import shutil

    shutil.rmtree(f"{repo.home}/chunks")
    with pytest.raises(NotFound):  # what the remote has lost doesn't come in part
        other.fetch_missing(repo.files(second), repo.root)


def test_two_writers_at_once(spark, repo) -> None:
    """Of two that change a lock at once one is told; of two that save a table on the same ground one is."""
    outcomes: list[str] = []

    def take(owner: str) -> None:
        try:
            Repository(spark, repo.root).lock("assets/sky.bin", owner)
            outcomes.append("ok")
        except LockConflict:
            outcomes.append("conflict")

    threads = [threading.Thread(target=take, args=(f"user{n}",)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcomes) == ["conflict"] * 7 + ["ok"] and repo.locks().count() == 1
    other = Repository(spark, repo.root)
    mine, theirs = repo.read("staging"), other.read("staging")
    repo._save("staging", mine)
    with pytest.raises(ConcurrentChange):
        other._save("staging", theirs)
    other.read("staging")
    other._save("staging", theirs)


def test_chunkers(spark) -> None:
    blob = spark.createDataFrame([("f", b"one\ntwo\n\nthree"), ("empty", b"")], "path string, content binary")
    cuts = lambda c: {p: [r["len"] for r in chunking.chunked(blob, c).where(f"path = '{p}'").orderBy("ordinal").collect()] for p in ("f", "empty")}
    assert cuts(chunking.Lines()) == {"f": [4, 4, 1, 5], "empty": [0]}
    assert cuts(chunking.Fixed(6)) == {"f": [6, 6, 2], "empty": [0]}
    assert sum(cuts(chunking.Gear(chunking.Sizes(2, 4, 8)))["f"]) == 14


def test_settings(repo) -> None:
    repo.set_remote("/elsewhere")
    repo.set_view(("code/...",), ("code/x/...",))
    again = Repository(repo.spark, repo.root)
    assert again.remote == "/elsewhere" and again.view == (("code/...",), ("code/x/...",))
    again.config.auto_hydrate = False
    again.add()
    commit = again.commit("c", "ann", 1)
    again.dehydrate()
    again.checkout(commit)
    assert states(again)["code/plan.txt"] == "Virtual"


def test_view_keeps_files_out(repo) -> None:
    repo.set_view(("code/...", "assets/..."), ("assets/excluded/...",))
    put(repo.root, "assets/excluded/x", b"x")
    repo.add()
    commit = repo.commit("c", "ann", 1)
    repo.open(commit)
    assert states(repo)["assets/excluded/x"] == "NotInView" and states(repo)["config/view.ini"] == "NotInView"
    assert states(repo)["code/plan.txt"] == "Hydrated"


def test_clone_push_pull(spark, repo, tmp_path) -> None:
    repo.add()
    first = repo.commit("first", "ann", 1)
    other = Repository.clone(spark, f"file://{repo.root}", str(tmp_path / "two"))
    assert other.head == first and states(other)["assets/sky.bin"] == "Virtual" and states(other)["code/plan.txt"] == "Hydrated"
    put(other.root, "code/other.txt", b"other")
    other.add(("code",))
    second = other.commit("second", "bob", 2)
    report = other.push().first()
    assert (report["new_head"], report["commit_count"], report["chunk_count"]) == (second, 1, 1)
    put(repo.root, "code/mine.txt", b"mine")
    third = Repository.clone(spark, repo.root, str(tmp_path / "three"), hydrate_all=True)
    assert third.head == second
    put(third.root, "code/third.txt", b"third")
    third.add(("code/third.txt",))
    last = third.commit("third", "carl", 3)
    third.push()
    # a writer who hasn't seen that is turned away, and nothing has come over
    put(other.root, "code/later.txt", b"later")
    other.add(("code/later.txt",))
    other.commit("fourth", "bob", 4)
    with pytest.raises(NotFastForward):
        other.push()
    with pytest.raises(NotFastForward):
        other.pull()
    assert repo.head == last
    with pytest.raises(RepositoryError):
        Repository.clone(spark, repo.root, other.root)
    with pytest.raises(NotFound):
        Repository.clone(spark, str(tmp_path / "none"), str(tmp_path / "four"))
    assert not os.path.exists(tmp_path / "four")


def test_locks(repo) -> None:
    repo.lock("assets/sky.bin", "alice")
    repo.lock("assets/sky.bin", "alice")
    with pytest.raises(LockConflict):
        repo.lock("assets/sky.bin", "bob")
    with pytest.raises(LockConflict):
        repo.unlock("assets/sky.bin", "bob")
    assert [r["owner"] for r in repo.locks("assets/sk").collect()] == ["alice"]
    repo.unlock("assets/sky.bin", "alice")
    assert repo.locks().isEmpty()


def test_head_moves_once(repo) -> None:
    repo.set_head("a", None)
    with pytest.raises(NotFastForward):
        repo.set_head("b", None)
    repo.set_head("b", "a")
    assert repo.head == "b"


def test_config_defaults() -> None:
    assert Config.load("{}").hot_paths == () and Config.load("{}").hot_bytes == 0
    assert Config.load('{"workspace": {}}').hot_bytes == 256 * 1024
    assert Config.load(SMALL.dump()) == SMALL


def test_chunks_lost(repo) -> None:
    import shutil

    repo.add()
    repo.commit("first", "ann", 1)
    repo.dehydrate()
    shutil.rmtree(f"{repo.home}/chunks")
    assert not repo.fsck().isEmpty()
    with pytest.raises(NotFound):
        repo.hydrate()

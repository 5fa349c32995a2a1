"""What a repository answers and takes from others: the calls of a remote as a protocol, and a repository that serves them.

Tables come and go as DataFrames. Another store, commit table or transport can stand in for the ones here by having the same methods.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import history, locks, store, sync
from .repository import NotFound, Repository, RepositoryError


class ObjectStore(Protocol):
    """Chunks by id."""

    def has_objects(self, ids: DataFrame) -> DataFrame: ...

    def get_chunks(self, ids: list[str]) -> DataFrame: ...

    def put_chunks(self, chunks: DataFrame) -> DataFrame: ...


class CommitStore(Protocol):
    """Commits, their files, and the head."""

    def get_head(self) -> str | None: ...

    def update_head(self, new: str, expected: str | None) -> None: ...

    def get_commit(self, commit: str, metadata_only: bool = False) -> tuple[DataFrame, DataFrame]: ...

    def put_commit(self, commit: DataFrame, files: DataFrame) -> bool: ...


class Backend(ObjectStore, CommitStore, Protocol):
    """All that a client asks of a remote."""

    def get_config(self) -> dict: ...

    def get_manifest(self, commit: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), hot_only: bool = False) -> DataFrame: ...

    def lock_path(self, path: str, owner: str) -> None: ...

    def unlock_path(self, path: str, owner: str) -> None: ...

    def list_locks(self, prefix: str = "") -> DataFrame: ...


class LocalBackend:
    """A repository in a folder as a backend."""

    def __init__(self, repository: Repository):
        self.repository = repository

    def get_config(self) -> dict:
        """The sizes that chunks are cut to; who clones takes them over."""
        c = self.repository.config
        return {"chunk_min": c.chunk_min, "chunk_avg": c.chunk_avg, "chunk_max": c.chunk_max, "small_file": c.small_file}

    # Chunks

    def has_objects(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (``id``) that are here, each once."""
        return store.present(ids, self.repository.read("chunks"))

    def get_chunks(self, ids: list[str]) -> DataFrame:
        return self.repository.get_chunks(ids)

    def stream_chunks(self, ids: DataFrame) -> DataFrame:
        """``id``, ``raw_len``, ``stored_len``, ``compressed``, ``data`` of ``ids``, as they are stored; one that isn't here is an error before any comes."""
        held = self.repository.read("chunks")
        if lost := store.first_missing(ids, held).collect():
            raise NotFound(f"object not found: {lost[0]['id']}")
        return held.join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])

    def put_chunks(self, chunks: DataFrame) -> DataFrame:
        """Take in what isn't here; ``id``, ``raw_len``, ``was_new`` of each. Chunks that haven't the id of their bytes are refused, all of them."""
        from . import files

        plain = files.plain_chunks(chunks.dropDuplicates(["id"]))
        if wrong := plain.where(fn.blob_id(F.col("data")) != F.col("id")).select("id").limit(1).collect():
            raise RepositoryError(f"bytes of another id: {wrong[0]['id']}")
        held = self.repository.read("chunks")
        results = self.repository.spark.createDataFrame(store.put_results(chunks, held).collect(), "id string, raw_len long, was_new boolean")  # a client's batch
        self.repository._append_chunks(store.new_chunks(chunks, held))
        return results

    # Commits

    def get_head(self) -> str | None:
        return self.repository.head

    def update_head(self, new: str, expected: str | None) -> None:
        """Move the head to a commit that is here."""
        if self.repository.read("commits").where(F.col("id") == new).isEmpty():
            raise NotFound(f"no commit {new}")
        self.repository.set_head(new, expected)

    def get_commit(self, commit: str, metadata_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """The commit (one row) and its files; without its files if only ``metadata_only`` is asked for."""
        found = self.repository.read("commits").where(F.col("id") == commit).dropDuplicates(["id"])
        if found.isEmpty():
            raise NotFound(f"no commit {commit}")
        files = self.repository.files(commit).dropDuplicates(["path"])
        return (sync.metadata_only(found), files.limit(0)) if metadata_only else (found, files)

    def put_commit(self, commit: DataFrame, files: DataFrame) -> bool:
        """Take in a commit whose parent and chunks are here; whether it was new."""
        row = commit.first()
        commits = self.repository.read("commits")
        if not commits.where(F.col("id") == row["id"]).isEmpty():
            return False
        if row["parent"] is not None and commits.where(F.col("id") == row["parent"]).isEmpty():
            raise NotFound(f"no parent {row['parent']}")
        if lost := store.first_missing(files.select(F.explode("chunks.id").alias("id")), self.repository.read("chunks")).collect():
            raise NotFound(f"object not found: {lost[0]['id']}")
        self.repository._append("commit_files", files)
        self.repository._append("commits", commit)
        return True

    def get_manifest(self, commit: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), hot_only: bool = False) -> DataFrame:
        """A commit's files in view, or the hot ones of them."""
        _, files = self.get_commit(commit)
        return sync.visible_manifest(files, include, exclude, hot_only)

    def log(self, head: str | None = None, stop: str | None = None, most: int | None = None) -> DataFrame:
        return history.log(self.repository.read("commits"), head or self.repository.head, stop=stop, most=most)

    # Locks and identity

    def lock_path(self, path: str, owner: str) -> None:
        self.repository.lock(path, owner)

    def unlock_path(self, path: str, owner: str) -> None:
        self.repository.unlock(path, owner)

    def list_locks(self, prefix: str = "") -> DataFrame:
        return self.repository.locks(prefix)

    def current_identity(self, header: str, identities: DataFrame) -> str | None:
        """Who asks, by an authorization header; None where its token is nobody's."""
        asked = self.repository.spark.createDataFrame([(header,)], "header string")
        return locks.whoami(asked, identities).first()["identity"]

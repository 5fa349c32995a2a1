"""A repository: versioned snapshots of a working tree, in Parquet below ``.chunkwright``.

The tree and the repository are in a POSIX folder that driver and executors share. Tables that only grow (chunks, commits,
commit_files, chunk_cache) are appended to, a folder a time. Tables of the working tree are written anew as numbered versions. The head, each
version of a table and each lock are numbered entries, each made by a link that fails if it is there already: that is compare-and-set
without a lock, so of two writers at once one is told. Data come first, the head last, so what breaks off before that is never seen.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chunking, history, ingest, integrity, locks, patterns, store, sync, workspace
from . import files as tree
from .shared import cut_lineage

TABLES = {
    "chunks": "id string, raw_len long, stored_len long, compressed boolean, data binary",
    "chunk_cache": f"file_digest string, chunks array<{schemas.CHUNK_REF}>",
    "commits": schemas.COMMITS,
    "commit_files": schemas.COMMIT_FILES,
    "staging": schemas.COMMIT_FILES.replace("commit_id string, ", ""),
    "manifest_index": schemas.MANIFEST_INDEX,
    "materialized": schemas.MATERIALIZED,
    "workspace_manifest": schemas.COMMIT_FILES,
}
GROWING = ("chunks", "chunk_cache", "commits", "commit_files")
LOCKS = "path string, owner string, number long"
#: Times that a lock is tried anew where others change it at the same moment.
TRIES = 20


class RepositoryError(Exception):
    """An operation that can't be done; nothing has changed."""


class DirtyWorkspace(RepositoryError):
    pass


class NotFound(RepositoryError):
    pass


class NotFastForward(RepositoryError):
    pass


class LockConflict(RepositoryError):
    pass


class ConcurrentChange(RepositoryError):
    """Another writer was first; what was read is out of date."""


@dataclasses.dataclass
class Config:
    chunk_min: int = schemas.CHUNK_MIN
    chunk_avg: int = schemas.CHUNK_AVG
    chunk_max: int = schemas.CHUNK_MAX
    small_file: int = schemas.SMALL_FILE
    hot_paths: tuple[str, ...] = schemas.HOT_PATHS
    hot_bytes: int = schemas.HOT_BYTES
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    remote: str | None = None
    #: Files from this size on are read and cut window by window.
    large_file: int = schemas.LARGE_FILE
    large_window: int = schemas.LARGE_WINDOW
    #: Whether opening a commit hydrates its hot files, and whether bytes are checked when files are written.
    auto_hydrate: bool = True
    verify: bool = True
    #: How hard chunks are compressed; 0 is not at all.
    compression: int = 1

    @classmethod
    def load(cls, text: str) -> Config:
        """From JSON: a ``workspace`` object that is missing gives no hot paths and 0 bytes, missing fields of it give the defaults."""
        given = json.loads(text)
        hot = given.pop("workspace", None)
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in cls.__dataclass_fields__}
        return cls(**own, hot_paths=tuple(hot.get("hot_paths", schemas.HOT_PATHS)) if hot is not None else (), hot_bytes=hot.get("hot_bytes", schemas.HOT_BYTES) if hot is not None else 0)

    def dump(self) -> str:
        rest = dataclasses.asdict(self)
        return json.dumps(rest | {"workspace": {k: rest.pop(k) for k in ("hot_paths", "hot_bytes")}})


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.home = f"{self.root}/{tree.CONTROL}"
        if not os.path.exists(f"{self.home}/config.json"):
            raise NotFound(f"no repository in {root}")
        with open(f"{self.home}/config.json") as file:
            self.config = Config.load(file.read())
        self._seen_versions: dict[str, int] = {}

    @classmethod
    def init(cls, spark: SparkSession, root: str, config: Config | None = None) -> Repository:
        """Make a repository; one that is there already stays as it is."""
        home = f"{root}/{tree.CONTROL}"
        if not os.path.exists(f"{home}/config.json"):
            os.makedirs(f"{home}/head", exist_ok=True)
            with open(f"{home}/config.json", "w") as file:
                file.write((config or Config()).dump())
        return cls(spark, root)

    # Tables

    def _entries(self, folder: str) -> list[str]:
        return sorted(os.listdir(f"{self.home}/{folder}")) if os.path.isdir(f"{self.home}/{folder}") else []

    def _entry(self, folder: str, name: str) -> str:
        with open(f"{self.home}/{folder}/{name}") as file:
            return file.read().strip()

    def _put_entry(self, folder: str, number: int, text: str) -> bool:
        """Make the entry ``number`` of a folder, whole or not at all; False if it is there already."""
        os.makedirs(f"{self.home}/{folder}", exist_ok=True)
        part = f"{self.home}/part.{uuid.uuid4().hex}"
        with open(part, "w") as file:
            file.write(text)
        try:
            os.link(part, f"{self.home}/{folder}/{number:012d}")  # fails if it is there
        except FileExistsError:
            return False
        finally:
            os.remove(part)
        return True

    def _parts(self, name: str) -> list[str]:
        """Folders of a growing table that count: complete ones that no compacted one stands for."""
        folder = f"{self.home}/{name}"
        found = [p for p in sorted(os.listdir(folder)) if os.path.exists(f"{folder}/{p}/_SUCCESS")] if os.path.isdir(folder) else []
        replaced: set[str] = set()
        for entry in self._entries(f"{name}.compacted"):
            new, *old = self._entry(f"{name}.compacted", entry).split()
            replaced.update(old)
        return [p for p in found if p not in replaced]

    def read(self, name: str) -> DataFrame:
        schema = TABLES[name]
        if name in GROWING:
            parts = [f"{self.home}/{name}/{p}" for p in self._parts(name)]
        else:
            versions = self._entries(f"{name}.versions")
            self._seen_versions[name] = int(versions[-1]) if versions else -1
            parts = [f"{self.home}/{name}/{self._entry(f'{name}.versions', versions[-1])}"] if versions else []
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _save(self, name: str, rows: DataFrame) -> None:
        """The next version after the one that was read last here; if another writer has made it, nothing is changed."""
        if name not in self._seen_versions:
            self.read(name)
        number, folder = self._seen_versions[name] + 1, uuid.uuid4().hex
        rows.write.parquet(f"{self.home}/{name}/{folder}")
        if not self._put_entry(f"{name}.versions", number, folder):
            shutil.rmtree(f"{self.home}/{name}/{folder}", ignore_errors=True)
            raise ConcurrentChange(f"{name} has been changed by another writer")
        self._seen_versions[name] = number
        if number >= 2:  # the version before the new one may still be read
            shutil.rmtree(f"{self.home}/{name}/{self._entry(f'{name}.versions', f'{number - 2:012d}')}", ignore_errors=True)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.home}/{name}/{uuid.uuid4().hex}")

    def _append_chunks(self, rows: DataFrame) -> None:
        """New chunks, by ranges of their ids, so that a look-up of an id reads a few row groups."""
        self._append("chunks", store.sorted_by_id(rows.select("id", "raw_len", "stored_len", "compressed", "data")))

    def compact(self) -> None:
        """Write all chunks anew, each once and sorted by id, in place of the folders that appending has made."""
        old, new = self._parts("chunks"), uuid.uuid4().hex
        if len(old) > 1:
            store.sorted_by_id(self.read("chunks").dropDuplicates(["id"])).write.parquet(f"{self.home}/chunks/{new}")
            number = len(self._entries("chunks.compacted"))
            if not self._put_entry("chunks.compacted", number, "\n".join([new, *old])):
                shutil.rmtree(f"{self.home}/chunks/{new}", ignore_errors=True)
                raise ConcurrentChange("the store is being compacted by another writer")
            for part in old:
                shutil.rmtree(f"{self.home}/chunks/{part}", ignore_errors=True)

    def get_chunks(self, ids: list[str]) -> DataFrame:
        """``id``, ``data`` (as it was, not as it is stored) of the chunks asked for, by the scan's own filter; one that the store lacks is an error."""
        rows = store.get(self.read("chunks"), ids).select("id", "data", "compressed")
        lost = sorted(set(ids) - {r["id"] for r in rows.select("id").collect()})
        if lost:
            raise NotFound(f"object not found: {lost[0]}")
        return tree.plain_chunks(rows)

    # Head

    @property
    def head(self) -> str | None:
        entries = self._entries("head")
        return (self._entry("head", entries[-1]) or None) if entries else None

    def set_head(self, new: str, expected: str | None) -> None:
        """Move the head if it is as expected; of two that try at once one makes the next entry."""
        entries = self._entries("head")
        if self.head != expected:
            raise NotFastForward(f"the head is {self.head}, not {expected}")
        if not self._put_entry("head", int(entries[-1]) + 1 if entries else 0, new):
            raise NotFastForward("the head has just moved")

    # Views and settings

    @property
    def view(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.config.include, self.config.exclude

    @property
    def remote(self) -> str | None:
        return self.config.remote

    def set_remote(self, source: str | None) -> None:
        self.config.remote = source
        self._save_config()

    def set_view(self, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> None:
        self.config.include, self.config.exclude = include, exclude
        self._save_config()

    def _save_config(self) -> None:
        part = f"{self.home}/config.part"
        with open(part, "w") as file:
            file.write(self.config.dump())
        os.replace(part, f"{self.home}/config.json")

    def _seen(self):  # noqa: ANN202
        return patterns.in_view(F.col("path"), self.config.include, self.config.exclude)

    # Taking in

    def add(self, paths: tuple[str, ...] = (".",)) -> int:
        """Stage files; returns how many are staged. See ``routes`` for what is read of them."""
        routes, manifest = self.routes(paths)
        former = manifest.select("path", "chunks")
        kept = routes.where(F.col("way").isin(ingest.UNCHANGED, ingest.SAME_CONTENT)).join(former, "path")
        todo = routes.where(F.col("way").isin(ingest.SMALL, ingest.BOUNDARIES, ingest.CHUNKED)).join(former, "path", "left")
        if not todo.isEmpty():
            incoming = f"{self.home}/incoming/{uuid.uuid4().hex}"
            try:
                tree.cut_files(todo, self.root, self.chunker, self.config.large_file, self.config.large_window, self.config.compression).write.parquet(incoming)
                cut = self.spark.read.schema(tree.PIECES).parquet(incoming)
                made = cut_lineage(todo.drop("chunks").join(chunking.refs(cut), "path"))
                self._append_chunks(store.new_chunks(cut.withColumn("raw_len", F.col("len")), self.read("chunks")))
            finally:
                shutil.rmtree(incoming, ignore_errors=True)
            self._append("chunk_cache", made.select("file_digest", "chunks").dropDuplicates(["file_digest"]).join(self.read("chunk_cache"), "file_digest", "left_anti"))
            kept = kept.unionByName(made)
        kept = kept.unionByName(routes.where(F.col("way") == ingest.CACHED).join(self.read("chunk_cache").dropDuplicates(["file_digest"]), "file_digest"))
        kept = cut_lineage(kept.select("path", "size", "modified", "file_digest", "chunks"))
        self._save("manifest_index", ingest.upsert(manifest, kept))
        self._save("staging", ingest.upsert(self.read("staging"), kept.drop("modified")))
        return self.read("staging").count()

    @property
    def chunker(self) -> chunking.Chunker:
        sizes = chunking.Sizes(self.config.chunk_min, self.config.chunk_avg, self.config.chunk_max)
        return chunking.Gear(sizes, self.config.large_file, self.config.large_window)

    def routes(self, paths: tuple[str, ...] = (".",)) -> tuple[DataFrame, DataFrame]:
        """How files will be taken in (``path``, ``size``, ``modified``, ``file_digest``, ``way``), and the manifest index this rests on.

        Files of known size and time aren't read. The others are read once for their digest; only those whose content is nowhere known
        (small, grown or shrunk, or new) will be read again, to be cut.
        """
        listed = ingest.candidates(tree.scan(self.spark, self.root)).where(patterns.in_paths(F.col("path"), paths))
        manifest = self.read("manifest_index")
        split = cut_lineage(ingest.split_unchanged(listed, manifest))
        changed = split.where(F.col("known").isNull()).select("path", "size", "modified")
        hashed = changed.join(tree.digests(changed, self.root), "path").where(F.col("file_digest").isNotNull())
        files = split.where(F.col("known").isNotNull()).select("path", "size", "modified", F.col("known").alias("file_digest")).unionByName(hashed)
        return cut_lineage(ingest.routed(cut_lineage(files), manifest, self.read("chunk_cache"), self.config.small_file, self.config.large_file)), manifest

    def commit(self, message: str, author: str, timestamp: int | None = None) -> str:
        """A commit of what is staged and of nothing else; staging is empty then."""
        staged = self.read("staging")
        if staged.isEmpty():
            raise RepositoryError("nothing is staged")
        timestamp, parent = int(time.time()) if timestamp is None else timestamp, self.head
        named = staged.select(F.lit("").alias("commit"), F.lit(parent).cast("string").alias("parent"), F.lit(message).alias("message"), F.lit(timestamp).alias("timestamp"), "path", "file_digest", "size")
        commit = ingest.commit_ids(named).first()["id"]
        self._append("commit_files", staged.select(F.lit(commit).alias("commit_id"), *staged.columns))
        self._append("commits", self.spark.createDataFrame([(commit, parent, author, message, timestamp, False, 1)], schemas.COMMITS))
        self.set_head(commit, parent)
        index = workspace.after_commit(self.read("materialized"), staged, self._seen(), tree.scan(self.spark, self.root), F.lit(commit))
        self._save("materialized", index)
        self._save("workspace_manifest", staged.where(self._seen()).select(F.lit(commit).alias("commit_id"), *staged.columns))
        self._save("staging", staged.limit(0))
        return commit

    # History

    def log(self) -> DataFrame:
        commits = self.read("commits").dropDuplicates(["id"])
        return history.log(commits, self.head).join(commits.drop("parent"), "id").orderBy("depth")

    def files(self, commit: str) -> DataFrame:
        return self.read("commit_files").where(F.col("commit_id") == commit)

    def stats(self) -> DataFrame:
        """Chunks, their stored bytes, the bytes on disk of the store's files, commits and those without their files."""
        commits = self.read("commits").dropDuplicates(["id"]).agg(F.count("*").alias("commits"), F.count_if("files_omitted").alias("metadata_only"))
        disk = sum(os.path.getsize(os.path.join(at, name)) for part in self._parts("chunks") for at, _, names in os.walk(f"{self.home}/chunks/{part}") for name in names)
        return store.stats(self.read("chunks").select("id", "stored_len")).crossJoin(commits).withColumn("disk_bytes", F.lit(disk).cast("long"))  # single rows

    def _with_data(self, files: DataFrame) -> DataFrame:
        """``files`` (``path``, ``size``, ``file_digest``, ``chunks``) chunk by chunk, with what is stored of each (null: it is missing)."""
        refs = files.select("path", "size", "file_digest", F.explode("chunks").alias("c")).select("path", "size", "file_digest", "c.id", "c.offset")
        return refs.join(self.read("chunks").dropDuplicates(["id"]).select("id", "data", "compressed"), "id", "left")

    def fsck(self, deep: bool = False) -> DataFrame:
        """What is wrong in the history from the head: chunks that are missing or, looked at deeply, files whose bytes differ. Empty if all is well."""
        chain = history.log(self.read("commits"), self.head).select(F.col("id").alias("commit_id"))
        files = self.read("commit_files").join(chain, "commit_id", "left_semi")
        refs = files.select("path", "file_digest", F.explode("chunks").alias("c")).select("path", "file_digest", "c.id", "c.offset")
        if not deep:
            return integrity.missing_chunks(refs, self.read("chunks")).select("path", F.col("id").alias("subject")).distinct()
        once = files.groupBy("file_digest").agg(F.min(F.struct("path", "size", "chunks")).alias("f")).select("file_digest", "f.path", "f.size", "f.chunks")
        found = tree.content_digests(self._with_data(once))
        return found.where(F.col("found") != F.col("file_digest")).select("path", F.col("file_digest").alias("subject"))

    # The working tree

    def _disk(self, index: DataFrame) -> DataFrame:
        """Files there, with the digest of those that the index takes for hydrated or dirty and whose size and time aren't known."""
        there = tree.scan(self.spark, self.root)
        ours = index.where(F.col("state").isin(schemas.HYDRATED, schemas.DIRTY)).select("path")
        known = ingest.split_unchanged(there.join(ours, "path", "left_semi"), self.read("manifest_index"))
        digests = tree.digests(known.where(F.col("known").isNull()), self.root).unionByName(known.where(F.col("known").isNotNull()).select("path", F.col("known").alias("file_digest")))
        return there.join(digests.select("path", F.col("file_digest").alias("digest")), "path", "left")

    def refresh(self) -> DataFrame:
        index = self.read("materialized")
        return cut_lineage(workspace.refreshed(index, self._disk(index), self.read("manifest_index")))

    def status(self) -> DataFrame:
        return workspace.status(self.refresh()).withColumn("commit_id", F.lit(self.head))

    def _clean_index(self) -> DataFrame:
        index = self.refresh()
        if first := workspace.dirty(index).orderBy("path").first():
            raise DirtyWorkspace(f"changed since it was committed: {first['path']}")
        return index

    def current_files(self) -> DataFrame:
        """Files of the workspace's commit: its manifest if that is the head's, else the commit's own."""
        manifest = self.read("workspace_manifest")
        if self.head is None or not manifest.where(F.col("commit_id") != self.head).isEmpty() or manifest.isEmpty():
            return self.files(self.head or "")
        return manifest

    def open(self, commit: str, hydrate: bool | None = None, remote: str | None = None) -> None:
        """Make ``commit`` the workspace's and the head: files that stay alike are kept, others wait to be hydrated.

        With ``remote`` what is missing here (the commit, its files, the chunks of its hot files) is fetched from there first."""
        hydrate = self.config.auto_hydrate if hydrate is None else hydrate
        if commit.lower() == "head":
            commit = self.head or ""
        if remote is not None:
            self._clean_index()
            self.fetch_commit(commit, remote)
        known = self.read("commits").where(F.col("id") == commit).first()
        target = self.files(commit)
        if known is None or known["files_omitted"] and target.isEmpty():
            raise NotFound(f"no commit {commit} with its files")
        index = self._clean_index()
        there = tree.scan(self.spark, self.root)
        visible = target.where(self._seen())
        gone = cut_lineage(workspace.cleanup_paths(index, target, visible, there))
        new = cut_lineage(workspace.opened(index, target, visible, there, F.lit(commit)))
        tree.delete_files(gone.join(there, "path", "left_semi"), self.root)
        self._save("materialized", new)
        self._save("workspace_manifest", visible)
        if self.head != commit:
            self.set_head(commit, self.head)
        hot = new.where((F.col("state") == schemas.VIRTUAL) & patterns.is_hot(F.col("path"), F.col("size"), self.config.hot_paths, self.config.hot_bytes))
        if hydrate and not hot.isEmpty():
            if remote is not None:
                self.fetch_missing(visible.join(hot.select("path"), "path", "left_semi"), remote)
            self._write(hot.select("path"))

    checkout = open

    def _write(self, paths: DataFrame) -> None:
        files = cut_lineage(self.read("workspace_manifest").join(paths, "path", "left_semi"))
        ids = files.select(F.explode("chunks.id").alias("id"))
        lost = integrity.missing_chunks(ids, self.read("chunks")).limit(1).collect()
        if lost:
            raise NotFound(f"object not found: {lost[0]['id']}")
        tree.make_folders(files, self.root)
        tree.write_chunks(self._with_data(files), self.root, self.config.verify)
        self._save("materialized", workspace.hydrated(self.read("materialized"), paths))

    def hydrate(self, paths: tuple[str, ...] = (), remote: str | None = None) -> int:
        """Write the files asked for, with chunks missing here from ``remote`` if one is given; returns how many files are hydrated then in all."""
        index = self._clean_index()
        todo = cut_lineage(workspace.to_hydrate(self.read("workspace_manifest"), index, patterns.in_paths(F.col("path"), paths)).select("path"))
        if remote is not None:
            self.fetch_missing(self.read("workspace_manifest").join(todo, "path", "left_semi"), remote)
        self._save("materialized", index)
        if not todo.isEmpty():
            self._write(todo)
        return workspace.hydrated_count(self.read("materialized")).first()[0]

    def dehydrate(self, paths: tuple[str, ...] = ()) -> int:
        """Take away clean files; with a dirty one among those asked for nothing is done."""
        index, asked = self.refresh(), patterns.in_paths(F.col("path"), paths)
        if first := workspace.dirty(index, asked).orderBy("path").first():
            raise DirtyWorkspace(f"changed since it was committed: {first['path']}")
        gone = cut_lineage(workspace.dehydrate_paths(index, asked))
        count = tree.delete_files(gone, self.root)
        self._save("materialized", workspace.dehydrated(index, asked))
        return count

    # Other roots

    @classmethod
    def clone(cls, spark: SparkSession, source: str, destination: str, hydrate_all: bool = False, partial: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Repository:
        """Copy a repository's commits and chunks and open its head. A destination with anything in it is refused; if it fails, none is left.

        A ``partial`` one has the history without its files, the head's files, and of chunks those of its hot files in view only; others are
        fetched when they are asked for.
        """
        if os.path.exists(destination) and os.listdir(destination):
            raise RepositoryError(f"not empty: {destination}")
        origin = cls(spark, source.removeprefix("file://"))
        try:
            own = cls.init(spark, destination, dataclasses.replace(origin.config, include=include, exclude=exclude, remote=origin.root))
            if origin.head is not None:
                if partial:
                    own._append("commits", sync.metadata_only(origin.read("commits").dropDuplicates(["id"])))
                else:
                    for name in ("chunks", "commit_files", "commits"):
                        own._append(name, origin.read(name))
                own.set_head(origin.head, None)
                own.open(origin.head, remote=origin.root if partial else None)
                if hydrate_all:
                    own.hydrate(remote=origin.root if partial else None)
        except Exception:
            shutil.rmtree(destination, ignore_errors=True)
            raise
        return own

    def fetch_commit(self, commit: str, remote: str | None = None) -> None:
        """The commit and its files, if they aren't here, from the remote."""
        known = self.read("commits").where(F.col("id") == commit)
        if not known.isEmpty() and not self.files(commit).isEmpty():
            return
        origin = self._remote(remote)
        found = origin.read("commits").where(F.col("id") == commit).dropDuplicates(["id"])
        if found.isEmpty():
            raise NotFound(f"no commit {commit} there")
        self._append("commit_files", origin.files(commit).dropDuplicates(["path"]))
        if known.isEmpty():
            self._append("commits", found)

    def fetch_missing(self, files: DataFrame, remote: str | None = None) -> int:
        """The chunks of ``files`` (``chunks``) that aren't here, from the remote; returns how many. All must be there, or nothing comes."""
        origin = self._remote(remote)
        wanted = cut_lineage(store.missing(files.select(F.explode("chunks.id").alias("id")), self.read("chunks")))
        count = wanted.count()
        if count:
            if lost := store.first_missing(wanted, origin.read("chunks")).collect():
                raise NotFound(f"object not found: {lost[0]['id']}")
            self._append_chunks(origin.read("chunks").join(wanted, "id", "left_semi").dropDuplicates(["id"]))
        return count

    def _remote(self, remote: str | None) -> Repository:
        place = remote or self.config.remote
        if place is None:
            raise RepositoryError("no remote is known")
        return Repository(self.spark, place.removeprefix("file://"))

    def _send(self, to: Repository, head: str, stop: str | None) -> DataFrame:
        """Chunks, then commits, that ``to`` lacks."""
        chain = cut_lineage(history.log(self.read("commits"), head, stop=stop))
        files = self.read("commit_files").join(chain.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
        ids = cut_lineage(sync.push_chunks(files, chain, to.read("chunks")))
        if not ids.isEmpty():
            to._append_chunks(store.new_chunks(self.read("chunks").join(ids, "id", "left_semi"), to.read("chunks")))
        new = chain.join(to.read("commits").select("id"), "id", "left_anti").select("id")
        to._append("commit_files", files.join(new.select(F.col("id").alias("commit_id")), "commit_id", "left_semi"))
        to._append("commits", self.read("commits").dropDuplicates(["id"]).join(new, "id", "left_semi"))
        return sync.push_report(chain, ids, head)

    def push(self, remote: str | None = None) -> DataFrame:
        to = self._remote(remote)
        if self.head is None:
            raise RepositoryError("there is nothing to push")
        old = to.head
        if not sync.fast_forward(self.read("commits"), old, self.head):
            raise NotFastForward("the remote has commits that aren't here")
        report = self._send(to, self.head, old)
        if old != self.head:
            to.set_head(self.head, old)
        return report

    def pull(self, remote: str | None = None, partial: bool = False) -> DataFrame:
        """Move to the remote's head. ``partial``: its new commits come without their files, and of chunks those that the workspace needs."""
        origin = self._remote(remote)
        self._clean_index()
        if origin.head is None or not sync.fast_forward(origin.read("commits"), self.head, origin.head):
            raise NotFastForward("the histories have parted")
        if not partial:
            report = origin._send(self, origin.head, self.head)
            self.open(origin.head)
            return report
        chain = cut_lineage(history.log(origin.read("commits"), origin.head, stop=self.head))
        new = chain.join(self.read("commits").select("id"), "id", "left_anti").select("id")
        before = self.read("chunks").select("id").distinct().count()
        self._append("commits", sync.metadata_only(origin.read("commits").dropDuplicates(["id"]).join(new, "id", "left_semi")))
        self.open(origin.head, remote=origin.root)
        came = self.read("chunks").select("id").distinct().count() - before
        return chain.agg(F.count("*").alias("commit_count")).select(F.lit(origin.head).alias("new_head"), "commit_count", F.lit(came).cast("long").alias("chunk_count"))

    # Locks

    def _change_lock(self, op: str, path: str, owner: str) -> None:
        """A lock is a folder of numbered entries, the last of which counts. One who makes the next entry has decided on the last one; another who
        was faster makes it fail, and then it is tried anew."""
        folder = f"locks/{hashlib.sha256(path.encode()).hexdigest()}"
        for _ in range(TRIES):
            entries = self._entries(folder)
            number = int(entries[-1]) + 1 if entries else 0
            outcome, holder = locks.step(json.loads(self._entry(folder, entries[-1]))["owner"] if entries else None, op, owner)
            if outcome != "ok":
                raise LockConflict(f"{path}: {outcome}, held by {holder}")
            if self._put_entry(folder, number, json.dumps({"path": path, "owner": holder, "number": number})):
                return
        raise ConcurrentChange(f"{path}: its lock is changed all the time")

    def lock(self, path: str, owner: str) -> None:
        self._change_lock(locks.LOCK, path, owner)

    def unlock(self, path: str, owner: str) -> None:
        self._change_lock(locks.UNLOCK, path, owner)

    def locks(self, prefix: str = "") -> DataFrame:
        """``path``, ``owner`` of the locks that are held, by path."""
        if not self._entries("locks"):
            return self.spark.createDataFrame([], "path string, owner string")
        entries = self.spark.read.schema(LOCKS).json(f"{self.home}/locks/*")
        held = entries.groupBy("path").agg(F.max_by("owner", "number").alias("owner")).where(F.col("owner").isNotNull())
        return locks.listed(held, prefix).orderBy("path")

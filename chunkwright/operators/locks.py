"""Locks, compare-and-set of a head, and who may do what."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn

LOCK, UNLOCK = "lock", "unlock"
OUTCOMES = "path string, seq long, op string, owner string, outcome string, holder string"


def step(holder: str | None, op: str, owner: str) -> tuple[str, str | None]:
    """Outcome and holder after one operation: a free path or one's own is locked; only the holder unlocks."""
    if op == LOCK:
        return ("ok", owner) if holder in (None, owner) else ("conflict", holder)
    return ("ok", None) if holder is not None and holder == owner else ("mismatch", holder)


def replay(ops: DataFrame) -> DataFrame:
    """The outcome of each of ``ops`` (``path``, ``owner``, ``op``, ``seq``) in order of seq for each path, and the holder after it.

    A path's operations are sorted and pass through a task as a stream; only the last path and holder are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, holder = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, holder = row["path"], None
                outcome, holder = step(holder, row["op"], row["owner"])
                out.append((row["path"], row["seq"], row["op"], row["owner"], outcome, holder))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], ["path", "seq", "op", "owner", "outcome", "holder"])

    return ops.select("path", "owner", "op", "seq").repartition("path").sortWithinPartitions("path", "seq", "owner", "op").mapInArrow(run, OUTCOMES)


def held(outcomes: DataFrame) -> DataFrame:
    """``path``, ``owner`` of the locks that are held in the end."""
    return outcomes.groupBy("path").agg(F.max_by("holder", "seq").alias("owner")).where(F.col("owner").isNotNull())


def listed(locks: DataFrame, prefix: str = "") -> DataFrame:
    """Locks whose path begins with ``prefix``, be that within a name."""
    return locks.where(F.col("path").startswith(prefix)) if prefix else locks


def compare_and_set(attempts: DataFrame) -> DataFrame:
    """``repo``, ``seq``, ``expected``, ``new``, ``ok``, ``head`` after each attempt (``repo``, ``seq``, ``expected``, ``new``): it goes through if
    the head is as expected; empty means none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, head = None, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["repo"] != repo:
                    repo, head = row["repo"], ""
                ok = head == (row["expected"] or "")
                head = row["new"] if ok else head
                out.append((row["repo"], row["seq"], row["expected"], row["new"], ok, head))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], ["repo", "seq", "expected", "new", "ok", "head"])

    return attempts.select("repo", "seq", "expected", "new").repartition("repo").sortWithinPartitions("repo", "seq").mapInArrow(run, "repo string, seq long, expected string, new string, ok boolean, head string")


def authorized(requests: DataFrame, identities: DataFrame, acl: DataFrame) -> DataFrame:
    """``requests`` (``repo``, ``token``, ``access``) with ``identity`` and ``verdict`` (ok, unauthenticated, denied).

    With no access list at all every identity may do all; an unlisted repository is nobody's. Admins may do all, writers may read.
    """
    who = identities.groupBy("token").agg(F.min("identity").alias("identity"))
    rights = acl.groupBy("repo", "identity").agg(F.max(F.col("access") == "admin").alias("admin"), F.max(F.col("access") == "write").alias("write"), F.max(F.col("access") == "read").alias("read"))
    rows = requests.join(who, "token", "left").join(rights, ["repo", "identity"], "left")
    free = acl.isEmpty()
    allowed: Column = F.lit(True) if free else F.coalesce(F.col("admin") | F.col("write") | (F.col("access") == "read") & F.col("read"), F.lit(False))
    verdict = F.when(F.col("identity").isNull(), "unauthenticated").when(allowed, "ok").otherwise("denied")
    return rows.withColumn("verdict", verdict).drop("admin", "write", "read")


def problems(identities: DataFrame, acl: DataFrame) -> DataFrame:
    """``problem``, ``subject``: tokens used twice and users in access lists that have no token."""
    twice = identities.groupBy("token").count().where("count > 1").select(F.lit("duplicate token").alias("problem"), F.col("token").alias("subject"))
    unknown = acl.select("identity").distinct().join(identities.select("identity"), "identity", "left_anti").select(F.lit("unknown user").alias("problem"), F.col("identity").alias("subject"))
    return twice.unionByName(unknown)


def whoami(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """``requests`` (``header``, an authorization header) with ``token`` and the ``identity`` it stands for; null where there is none."""
    who = identities.groupBy("token").agg(F.min("identity").alias("identity"))
    return requests.withColumn("token", fn.bearer(F.col("header"))).join(who, "token", "left")


def with_credentials(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """``requests`` (``endpoint``) with the ``credential`` kept for that endpoint, else the one kept for none (``endpoint`` null)."""
    own = credentials.where(F.col("endpoint").isNotNull()).groupBy("endpoint").agg(F.min("credential").alias("own"))
    default = credentials.where(F.col("endpoint").isNull()).agg(F.min("credential").alias("default"))
    return requests.join(own, "endpoint", "left").crossJoin(default).withColumn("credential", F.coalesce("own", "default")).drop("own", "default")  # a single row


def served(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """``requests`` (``asked``) with the ``repo`` (of ``repositories``) that a server finds for it and the ``error``: a repository's path below the root, or, where that is all that is served, its last name alone."""
    rows = requests.withColumn("p", fn.repo_path(F.col("asked")))
    direct = repositories.select("repo").distinct().withColumn("direct", F.col("repo"))
    named = repositories.select("repo").distinct().groupBy(F.substring_index("repo", "/", -1).alias("name")).agg(F.max("repo").alias("named"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = rows.join(direct.drop("repo"), F.col("p.path") == F.col("direct"), "left").join(named, F.col("p.path") == F.col("name"), "left")
    repo = F.coalesce("direct", "named")
    error = F.when(F.col("p.error").isNotNull(), F.col("p.error")).when(repo.isNull(), F.concat(F.lit("no such repository: "), F.col("p.path")))
    return rows.select(*requests.columns, repo.alias("repo"), error.alias("error"))

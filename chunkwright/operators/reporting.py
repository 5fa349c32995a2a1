"""What is shown of results, as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn


def lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _said(*parts) -> Column:  # noqa: ANN002
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def status_counts(status: DataFrame) -> DataFrame:
    """``text`` of a status row: how many files are in each state."""
    shown = (("virtual", "virtual"), ("hydrated", "hydrated"), ("dirty", "changed"), ("pending", "pending"), ("not_in_view", "outside the view"))
    return status.select(F.concat_ws(", ", *[_said(F.col(name).cast("string"), f" {label}") for name, label in shown]).alias("text"))


def status_text(status: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """``text``: the commit that is open, the view, the counts and, of each state that has any, the first paths."""
    counts = F.concat_ws(", ", *[_said(F.col(n).cast("string"), f" {label}") for n, label in (("virtual", "virtual"), ("hydrated", "hydrated"), ("dirty", "changed"))])
    previews = [F.when(F.col(f"{n}_paths") != "", preview(F.col(n), F.split(f"{n}_paths", ","), label)) for n, label in (("dirty", "changed"), ("pending", "pending"), ("not_in_view", "outside the view"))]
    return status.select(lines(_said("commit ", F.coalesce(fn.short_id(F.col("commit_id")), F.lit("none"))), F.lit(view_text(include, exclude)), counts, *previews).alias("text"))


def preview(count: Column, paths: Column, label: str) -> Column:
    """The first paths of a kind, one a line, and how many more there are."""
    more = count - F.size(paths)
    return _said(f"{label}:\n  ", F.array_join(paths, "\n  "), F.when(more > 0, _said("\n  and ", more.cast("string"), " more")).otherwise(F.lit("")))


def view_text(include: tuple[str, ...], exclude: tuple[str, ...]) -> str:
    shown = f"in view: {' '.join(include)}" if include else "all is in view"
    return f"{shown}, but for {' '.join(exclude)}" if exclude else shown


def log_lines(chain: DataFrame, head: str | None) -> DataFrame:
    """``depth``, ``line``: the short id, and which one is the head."""
    return chain.select("depth", F.concat(fn.short_id(F.col("id")), F.when(F.col("id") == F.lit(head), F.lit(" (head)")).otherwise(F.lit(""))).alias("line"))


def log_text(commits: DataFrame, head: str | None) -> DataFrame:
    """``depth``, ``text`` of each commit (``id``, ``author``, ``message``, ``files_omitted``, ``n_files``, ``depth``)."""
    files = F.when(F.col("files_omitted"), F.lit("files not here")).otherwise(fn.plural(F.col("n_files"), "file"))
    first = F.concat(fn.short_id(F.col("id")), F.when(F.col("id") == F.lit(head), F.lit(" (head)")).otherwise(F.lit("")))
    return commits.select("depth", lines(_said(first, " by ", F.col("author"), ", ", files), F.col("message")).alias("text"))


def push_text(report: DataFrame) -> DataFrame:
    return report.select(_said("head there is now ", fn.short_id(F.col("new_head")), "; sent ", fn.plural(F.col("commit_count"), "commit"), ", ", fn.plural(F.col("chunk_count"), "chunk")).alias("text"))


def pull_text(report: DataFrame) -> DataFrame:
    return report.select(_said("head here is now ", fn.short_id(F.col("new_head")), "; fetched ", fn.plural(F.col("commit_count"), "commit")).alias("text"))


def lock_lines(locks: DataFrame) -> DataFrame:
    return locks.select("path", _said(F.col("path"), " is held by ", F.col("owner")).alias("line"))


def stats_text(stats: DataFrame) -> DataFrame:
    """``text`` of a repository's statistics, with the mean size of a chunk."""
    mean = F.when(F.col("object_count") > 0, F.round(F.col("object_bytes") / F.col("object_count")).cast("long")).otherwise(F.lit(0).cast("long"))
    return stats.select(lines(
        _said(fn.plural(F.col("object_count"), "chunk"), ", ", fn.plural(F.col("object_bytes"), "byte"), " stored, ", fn.plural(mean, "byte"), " a chunk, ", fn.plural(F.col("disk_bytes"), "byte"), " on disk"),
        _said(fn.plural(F.col("commits"), "commit"), ", ", F.col("metadata_only").cast("string"), " without files"),
    ).alias("text"))


def fsck_text(problems: DataFrame) -> DataFrame:
    """``text``: that all is well, or the number of problems and the first by path."""
    found = problems.agg(F.count("*").alias("n"), F.min(F.struct("path", "subject")).alias("first"))
    return found.select(F.when(F.col("n") == 0, F.lit("nothing is wrong")).otherwise(_said(fn.plural(F.col("n"), "problem"), ", first ", F.col("first.path"), ": ", F.col("first.subject"))).alias("text"))


#: What single steps say of themselves, by the step's name; fields are filled in by ``said``.
STEPS = {
    "init": "repository made in {root}",
    "add": "{count} staged",
    "commit": "committed {commit}",
    "open": "{commit} is open",
    "clone": "cloned {source} to {root}, {commit} is open",
    "hydrate": "{count} hydrated in all",
    "dehydrate": "{count} taken away",
    "lock": "{path} is locked",
    "unlock": "{path} is free",
    "whoami": "{identity}",
    "login": "credentials kept for {endpoint}",
}


def said(step: str, **fields: object) -> str:
    """One line about a step; commits are shortened, files counted."""
    shown = {k: str(v)[: fn.SHORT] if k == "commit" else f"{v} file{'' if v == 1 else 's'}" if k == "count" else v for k, v in fields.items()}
    return STEPS[step].format(**shown)


def error_text(error: Exception) -> str:
    """One line about an error: its kind in words, and what it says."""
    kind = "".join(f" {c.lower()}" if c.isupper() else c for c in type(error).__name__).strip()
    return f"{kind}: {error}"


def upper_median(rows: DataFrame, group: str) -> DataFrame:
    """The upper middle ``value`` of each group: ranks are counted from the distinct values' counts, so no group is held in one place."""
    counts = rows.groupBy(group, "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy("value")
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    return counts.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy(group).agg(F.min("value").alias("median"))

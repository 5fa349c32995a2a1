"""Path filters: view rules, path arguments and hot paths, in their local and remote dialects.

A pattern is compiled on the driver to comparisons of the path column, never to a regular expression, so that
equalities and prefixes reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import HOT_BYTES, HOT_PATHS


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def at_or_under(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(f"{folder}/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def glob(pattern: str, name: Column) -> Column:
    """``*`` is any name, ``*.x`` a name whose last dot-separated part is x; all else is literal."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*."):
        return F.substring_index(name, ".", -1) == pattern[2:] if "." not in pattern[2:] else F.lit(False)
    return name == pattern


def matches(pattern: str, path: Column, dialect: str = "local") -> Column:
    """Whether a view rule takes in a path. The remote dialect has no trimming, no globs and no bare folders."""
    if dialect == "local":
        pattern = pattern.strip()
    pattern = pattern.replace("\\", "/").rstrip("/")
    if pattern in ("", "..."):
        return F.lit(True)
    if pattern.endswith("/..."):
        return at_or_under(path, pattern[:-4])
    if dialect == "remote":
        return path == pattern
    if "*" in pattern:
        folder, slash, name = pattern.rpartition("/")
        found = glob(name, basename(path))
        return at_or_under(path, folder) & found if slash else found
    return at_or_under(path, pattern)


def in_view(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), dialect: str = "local") -> Column:
    """No include rule, or one that matches, and no exclude rule that does."""
    include = list(include)
    wanted = any_of(matches(p, path, dialect) for p in include) if include else F.lit(True)
    return wanted & ~any_of(matches(p, path, dialect) for p in exclude)


def in_paths(path: Column, paths: Iterable[str] = (), dialect: str = "local") -> Column:
    """Whether a path is one of, or under one of, those asked for; asking for none is asking for all."""
    paths = [p.replace("\\", "/") for p in paths]
    if not paths:
        return F.lit(True)
    if dialect == "remote":
        return any_of(at_or_under(path, p) for p in paths)
    paths = [p.rstrip("/") for p in paths]
    return F.lit(True) if {"", "."} & set(paths) else any_of(at_or_under(path, p) for p in paths)


def is_hot(path: Column, size: Column, patterns: Iterable[str] = HOT_PATHS, most: int = HOT_BYTES) -> Column:
    return (size <= most) & any_of(matches(p, path) for p in patterns)


def to_fetch(path: Column, size: Column, paths: Iterable[str] = (), default_only: bool = False) -> Column:
    """Hot files, or the files asked for."""
    return is_hot(path, size) if default_only else in_paths(path, paths, "remote")


def include_patterns(paths: DataFrame) -> DataFrame:
    """View rules (``pattern``, sorted, each once) that take in the paths (``path``) asked for and all under them."""
    plain = F.regexp_replace(F.rtrim(F.translate("path", "\\", "/"), F.lit("/")), r"^(\./)+", "")
    rows = paths.select(plain.alias("p")).where((F.col("p") != "") & (F.col("p") != "."))
    return rows.select(F.explode(F.array("p", F.concat("p", F.lit("/...")))).alias("pattern")).distinct().orderBy("pattern")


def view_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` that rules kept in a table (``kind``, ``pattern`` of the forms folder/... and plain path, remote dialect) let
    through. A path is looked up by itself and its folders, which are few, so rules join by equality."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = files.select("path", F.explode(ups).alias("up")).distinct()
    rule = rules.select("kind", F.rtrim(F.translate("pattern", "\\", "/"), F.lit("/")).alias("rule"))
    rule = rule.select("kind", F.col("rule").isin("", "...").alias("all"), F.regexp_replace("rule", r"/\.\.\.$", "").alias("up"), F.col("rule").endswith("/...").alias("deep")).distinct()
    hits = keys.join(rule.where(~F.col("all")), "up").where(F.col("deep") | (F.col("path") == F.col("up"))).groupBy("path").agg(F.max(F.col("kind") == "include").alias("inc"), F.max(F.col("kind") == "exclude").alias("exc"))
    sums = rule.agg(F.coalesce(F.max(F.col("all") & (F.col("kind") == "include")), F.lit(False)).alias("all_inc"), F.coalesce(F.max(F.col("all") & (F.col("kind") == "exclude")), F.lit(False)).alias("all_exc"), F.count_if(F.col("kind") == "include").alias("n_inc")).first()
    wanted = F.lit(True) if sums["n_inc"] == 0 or sums["all_inc"] else F.coalesce("inc", F.lit(False))
    return files.join(hits, "path", "left").where(wanted & ~F.coalesce("exc", F.lit(False)) & ~F.lit(sums["all_exc"])).select(*files.columns)

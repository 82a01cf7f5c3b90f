"""Unified diffs and blame output as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(source, path, lo, hi) of diffs (source, text): the lines of the new side of each hunk; a pure deletion marks one line."""
    lines = diffs.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    name = F.trim(F.split(F.expr("substring(line, 5)"), "\t")[0])
    path = F.when(F.col("line").startswith("+++ "), F.when(name == "/dev/null", "").otherwise(F.regexp_replace(name, r"^[ab]/", "")))
    placed = lines.withColumn("path", F.last(path, ignorenulls=True).over(Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    hunk = r"^@@[^@]*?\+(\d+)(?:,(\d+))?[^@]*@@"
    rows = placed.where(F.col("line").rlike(hunk) & (F.col("path") != ""))
    start, count = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    return rows.select("source", "path", F.greatest(start, F.lit(1)).alias("lo"), F.when(n == 0, F.greatest(start, F.lit(1))).otherwise(start + n - 1).alias("hi"))


def _blamed(blames: DataFrame) -> DataFrame:
    """(source, sha, author, time) of each blamed line of porcelain output (source, text)."""
    lines = blames.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    up = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike(r"^[0-9a-f]{40} \d+ \d+"), F.substring("line", 1, 40))
    placed = lines.withColumn("sha", F.last(header, ignorenulls=True).over(up))
    facts = placed.groupBy("source", "sha").agg(
        F.max(F.when(F.col("line").startswith("author "), F.expr("substring(line, 8)"))).alias("author"),
        F.max(F.when(F.col("line").startswith("author-time "), F.expr("try_cast(trim(substring(line, 13)) as bigint)"))).alias("time"),
    )
    return placed.where(F.col("line").startswith("\t")).select("source", "sha").join(facts, ["source", "sha"])


def blame(blames: DataFrame) -> DataFrame:
    """(source, author, lines) by lines descending and name."""
    return _blamed(blames).groupBy("source", F.coalesce("author", F.lit("")).alias("author")).agg(F.count("*").alias("lines")).orderBy("source", F.desc("lines"), "author")


def last_author(blames: DataFrame) -> DataFrame:
    return _blamed(blames).groupBy("source").agg(F.max_by("author", "time").alias("author"), F.max("time").alias("time"), F.count("*").alias("lines"))


def staleness(cached: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo_url, branch, state): clones (repo_url, branch, sha) against the remote heads (repo_url, branch, head): current, stale, new, or unknown where no head is known."""
    c = cached.select(F.col("repo_url").alias("_u"), F.col("branch").alias("_b"), "sha")
    j = heads.join(c, F.col("repo_url").eqNullSafe(F.col("_u")) & F.col("branch").eqNullSafe(F.col("_b")), "full_outer")
    state = F.when(F.col("head").isNull(), "unknown").when(F.col("sha").isNull(), "new").when(F.col("sha") == F.col("head"), "current").otherwise("stale")
    return j.select(F.coalesce("repo_url", "_u").alias("repo_url"), F.coalesce("branch", "_b").alias("branch"), state.alias("state"))

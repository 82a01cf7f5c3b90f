"""Bundles: a folder with one Parquet table each and a manifest; and the export of sessions as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of a session that don't travel in a bundle.
SESSION_TABLES = ["sessions", "session_deliveries", "section_memory_states", "answer_cache", "answer_cache_sources", "embedding_cache"]


def version_hash(roots: DataFrame) -> str:
    """A hash of the roots (root_id, root_hash), over 4,096 buckets by id, so no list grows with their number."""
    entry = roots.select(F.substring(F.sha2(F.coalesce("root_id", F.lit("")), 256), 1, 3).alias("bucket"), F.concat_ws(":", "root_id", "root_hash").alias("entry"))
    hashed = entry.select("bucket", F.sha2("entry", 256).alias("h")).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    row = hashed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "h"))), "\n"), 256)).collect()  # at most 4,096 entries
    return row[0][0]


def write_bundle(tables: dict[str, DataFrame], roots: DataFrame, target: str) -> None:
    """Write tables, then the manifest; a bundle without a manifest is unfinished."""
    kept = {n: t for n, t in tables.items() if n not in SESSION_TABLES}
    for name, t in kept.items():
        t.write.mode("overwrite").parquet(f"{target}/{name}")
    spark = roots.sparkSession
    spark.createDataFrame([(version_hash(roots), sorted(kept))], "version string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{target}/manifest")


def read_bundle(spark: SparkSession, source: str) -> tuple[str, dict[str, DataFrame]]:
    row = spark.read.schema("version string, tables array<string>").json(f"{source}/manifest").collect()[0]
    return row.version, {n: spark.read.parquet(f"{source}/{n}") for n in row.tables}


def export_sessions(deliveries: DataFrame, drops: DataFrame, target: str) -> None:
    """Delivered and dropped items as JSON lines, each session's together and in order, and a line a session with its sums."""
    for name, rows in (("delivered", deliveries), ("drops", drops)):
        order = [c for c in ("session_id", "turn") if c in rows.columns]
        rows.repartition("session_id").sortWithinPartitions(*order).write.mode("overwrite").json(f"{target}/{name}")
    deliveries.groupBy("session_id").agg(F.count("*").alias("deliveries"), F.sum("tokens").alias("tokens")).write.mode("overwrite").json(f"{target}/summary")


def read_session(spark: SparkSession, target: str, session: str) -> DataFrame:
    """The delivered items of one exported session."""
    return spark.read.json(f"{target}/delivered").where(F.col("session_id") == session)

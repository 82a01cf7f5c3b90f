"""File events as a stream: micro-batches are coalesced per path, the last event wins.

The state is a stream aggregation keyed by path with one entry each; no event
time is needed, as order is given by the sequence number.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import checkpoint_dir


def changes(events: DataFrame) -> DataFrame:
    """(path, kind, seq): of the events (path, kind, seq) of a path the last one; for batches and streams alike."""
    return events.groupBy("path").agg(F.max(F.struct("seq", "kind")).alias("e")).select("path", "e.kind", "e.seq")


def file_events(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return raw.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Read the event files as a stream, run it to the end of what is there, and give the last event of each path.

    Each micro-batch is coalesced, and appended to the shared folder; the result
    is coalesced once more, so a batch that is run again changes nothing.
    """
    import uuid

    shared = os.path.join(checkpoint_dir(spark), f"coherence-{uuid.uuid4().hex}")
    schema = spark.read.parquet(path).schema
    # a file source reads a folder; a single file is named by a pattern in its folder
    folder, name = os.path.split(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if path.endswith(".parquet") and not _is_folder(spark, path) else "*.parquet").parquet(folder if not _is_folder(spark, path) else path)

    def write(batch: DataFrame, number: int) -> None:
        changes(batch).write.mode("overwrite").parquet(f"{shared}/out/batch={number}")

    query = file_events(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{shared}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return changes(spark.read.parquet(f"{shared}/out").select("path", "kind", "seq"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()

"""Change detection, freshness, coherence and cached answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S


def latest_hashes(hashes: DataFrame) -> DataFrame:
    """One row a path: the newest by mtime, then by versions and hash; a null mtime is the oldest."""
    order = F.struct(F.coalesce("mtime_ns", F.lit(-1)).alias("m"), "extractor_version", "resolver_version", "content_hash")
    return hashes.groupBy("path").agg(F.max(order).alias("k")).select("path", "k.content_hash", F.when(F.col("k.m") >= 0, F.col("k.m")).alias("mtime_ns"), "k.extractor_version", "k.resolver_version")


def freshness(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): current, stale, new or missing, by content hash alone; a full outer join on the path."""
    now = files.select("path", S.content_hash(F.col("content")).alias("now"))
    j = now.join(latest_hashes(stored).select("path", "content_hash"), "path", "full_outer")
    state = F.when(F.col("content_hash").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("content_hash"), "current").otherwise("stale")
    return j.select("path", state.alias("state"))


def changes(files: DataFrame, stored: DataFrame, extractor: int, resolver: int) -> DataFrame:
    """(path, action): skip, reindex or resolve; content first, then the extractor's and the resolver's versions.

    Where files have a column ``mtime_ns`` and it is the stored one, the content
    counts as unchanged and isn't hashed.
    """
    j = files.join(latest_hashes(stored).withColumnRenamed("mtime_ns", "_mtime"), "path", "left")
    same = F.col("_mtime").isNotNull() & (F.col("mtime_ns") == F.col("_mtime")) if "mtime_ns" in files.columns else F.lit(False)
    content = F.coalesce(same, F.lit(False)) | (S.content_hash(F.col("content")) == F.col("content_hash"))
    action = F.when(F.col("content_hash").isNull() | ~F.coalesce(content, F.lit(False)) | (F.col("extractor_version") < extractor), "reindex").when(F.col("resolver_version") < resolver, "resolve").otherwise("skip")
    return j.select("path", action.alias("action"))


def short_circuit(now: DataFrame, stored: DataFrame, extractor: int) -> DataFrame:
    """(root_id, files, skipped): roots (root_id, files, root_hash) whose stored hash and extractor version are the same are skipped whole."""
    j = now.join(stored.select("root_id", F.col("root_hash").alias("_hash"), "extractor_version"), "root_id", "left")
    same = (F.col("root_hash") == F.col("_hash")) & (F.col("extractor_version") == extractor)
    return j.select("root_id", "files", F.when(same, F.col("files")).otherwise(0).alias("skipped"))


def rebinds(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(old_path, new_path): paths that went away and came back under another name with the same content; each at most once, least to least."""
    now = files.select("path", S.content_hash(F.col("content")).alias("content_hash")).where("content_hash is not null")
    before = latest_hashes(stored).select("path", "content_hash")
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))
    gone = before.join(now.select("path"), "path", "left_anti").withColumn("n", nth)
    came = now.join(before.select("path"), "path", "left_anti").withColumn("n", nth)
    return gone.withColumnRenamed("path", "old_path").join(came.withColumnRenamed("path", "new_path"), ["content_hash", "n"]).select("old_path", "new_path")


def rebound(rows: DataFrame, moves: DataFrame, path_col: str) -> DataFrame:
    """Rows with the new path where theirs was rebound; ids and vectors stay."""
    m = moves.select(F.col("old_path").alias("_old"), F.col("new_path").alias("_new"))
    return rows.join(m, F.col(path_col) == F.col("_old"), "left").withColumn(path_col, F.coalesce("_new", path_col)).drop("_old", "_new")


def rollback(rows: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Rows without those of failed runs (run_id, state); rows without a run stay."""
    failed = runs.where("state = 'failed'").select(F.col("run_id").alias("_run"))
    return rows.join(failed, F.col(run_col) == F.col("_run"), "left_anti")


def throughput(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(begin, events, per_second) in windows of so many seconds of events (ts)."""
    w = events.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("begin"), "events", F.round(F.col("events") / seconds, 6).alias("per_second"))


def backlog(submitted: DataFrame, done: DataFrame) -> DataFrame:
    """(waiting): how many submitted ids aren't done."""
    return submitted.select("id").distinct().join(done.select("id"), "id", "left_anti").agg(F.count("*").alias("waiting"))


def recent(events: DataFrame, most: int, keys: list[str] | None = None, where: dict[str, str] | None = None, order: str = "seq") -> DataFrame:
    """The last so many events, of each key where there are keys, that have the given values: a ring buffer's content."""
    for column, value in (where or {}).items():
        events = events.where(F.col(column) == value)
    if not keys:
        return events.orderBy(F.desc(order)).limit(most)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def sweep(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored paths that are no longer there; none if nothing was discovered at all."""
    gone = stored.select("path").distinct().join(discovered.select("path"), "path", "left_anti")
    some = discovered.limit(1).select(F.lit(1).alias("_some"))
    return gone.crossJoin(F.broadcast(some)).drop("_some")  # one row at most


def fingerprint(files: DataFrame) -> DataFrame:
    """(root_id, files, root_hash) over the sorted paths and hashes of a root.

    Files are hashed to 4,096 buckets by path first, so no root's listing is one
    unbounded group; the root hash is over its bucket hashes.
    """
    bucket = F.substring(F.sha2("path", 256), 1, 3)
    one = files.select("root_id", bucket.alias("bucket"), F.concat_ws("\u0001", "path", S.content_hash(F.col("content"))).alias("entry"))
    buckets = one.groupBy("root_id", "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("h"))
    return buckets.groupBy("root_id").agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "h"))), "\n"), 256).alias("root_hash"))  # at most 4,096 entries


def coalesce_events(events: DataFrame) -> DataFrame:
    """(path, kind, seq): of the events of a path the last one."""
    return events.groupBy("path").agg(F.max(F.struct("seq", "kind")).alias("e")).select("path", "e.kind", "e.seq")


def apply_events(rows: DataFrame, events: DataFrame, fresh: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows after the last event of each path: those of removed paths go, those of created and modified ones are replaced by the fresh ones."""
    last = coalesce_events(events).select(F.col("path").alias("_path"), "kind")
    kept = rows.join(last, F.col(path_col) == F.col("_path"), "left_anti")
    return kept.unionByName(fresh.join(last.where("kind <> 'removed'"), F.col(path_col) == F.col("_path"), "left_semi"))


def affected_sections(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Old and new section ids of changed documents (path)."""
    ids = before.select("document_id", "id").unionByName(after.select("document_id", "id")).distinct()
    return ids.join(changed.select(F.col("path").alias("document_id")), "document_id", "left_semi")


def stale_deliveries(delivered: DataFrame, affected: DataFrame) -> DataFrame:
    """Deliveries (session_id, content_id) of sections that changed."""
    return delivered.join(affected.select(F.col("id").alias("content_id")), "content_id", "left_semi")


def valid_answers(sources: DataFrame, current: DataFrame) -> DataFrame:
    """(query_hash, valid): sources (query_hash, section_id, section_hash) all as they were; sources that are gone don't count."""
    j = sources.join(current.select(F.col("id").alias("section_id"), F.col("hash").alias("now")), "section_id")
    return sources.select("query_hash").distinct().join(j.groupBy("query_hash").agg(F.min(F.col("now") == F.col("section_hash")).alias("ok")), "query_hash", "left").select("query_hash", F.coalesce("ok", F.lit(True)).alias("valid"))


def kept_answers(cache: DataFrame, sources: DataFrame, current: DataFrame) -> DataFrame:
    """Cached answers (query_hash, …) without those whose sources have changed."""
    return cache.join(valid_answers(sources, current).where("not valid").select("query_hash"), "query_hash", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` without those that ``new`` replaces, and ``new``; for writing to a new version of a table."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)

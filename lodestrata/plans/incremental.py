"""Queries of change detection, coherence and cached answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators import incremental as I
from lodestrata.session import table
from lodestrata.streaming import coherence


def freshness(s, d):
    return I.freshness(table(s, d, "source_files"), table(s, d, "file_hashes"))


def latest_hashes(s, d):
    return I.latest_hashes(table(s, d, "file_hashes")).withColumn("mtime_ns", F.col("mtime_ns").cast("string"))


def change_actions(s, d):
    return I.changes(table(s, d, "source_files"), table(s, d, "file_hashes"), extractor=4, resolver=2)


def stale_sweep(s, d):
    return I.sweep(table(s, d, "file_hashes"), table(s, d, "source_files"))


def fingerprint(s, d):
    return I.fingerprint(table(s, d, "source_files"))


def _file_events(s, d):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return table(s, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"))


def coalesced_events(s, d):
    return I.coalesce_events(_file_events(s, d))


def coherence_stream(s, d):
    """The same by Structured Streaming over the event files, in micro-batches."""
    return coherence.replay(s, f"{d}/events.parquet")


def answer_cache(s, d):
    """Cached answers of documents over their sections; a hash with an odd first figure has changed since."""
    x = table(s, d, "sections").where("text is not null").dropDuplicates(["id"])
    h = S.content_hash(F.col("text"))
    sources = x.select(F.col("document_id").alias("query_hash"), F.col("id").alias("section_id"), F.when(F.substring(h, 1, 1).isin("1", "3"), F.lit("old")).otherwise(h).alias("section_hash"))
    return I.valid_answers(sources, x.where("depth > 0").select("id", h.alias("hash")))


def affected_sections(s, d):
    """Sections of the documents that came in within the week before the newest one."""
    sec, docs = table(s, d, "sections"), table(s, d, "documents")
    newest = docs.agg(F.max("ingested_at").alias("newest"))
    changed = docs.crossJoin(F.broadcast(newest)).where("ingested_at > newest - interval 7 days").select(F.col("source_path").alias("path"))  # one row
    return I.affected_sections(sec, sec.where("position < 3"), changed).select("document_id", "id")


def _stored_roots(s, d):
    """What was stored of the roots: hashes of those with an even number of letters are as they are, others are older; versions by the first letter."""
    f = fingerprint(s, d)
    return f.select("root_id", F.when(F.length("root_id") % 2 == 0, F.col("root_hash")).otherwise("older").alias("root_hash"), F.when(F.substring("root_id", 1, 1) < "n", 4).otherwise(3).alias("extractor_version"))


def stale_deliveries(s, d):
    """Deliveries of sections to ten sessions, by position, that have changed since."""
    sec = table(s, d, "sections").dropDuplicates(["id"]).where("position is not null")
    delivered = sec.select((F.col("position") % 10).alias("session_id"), F.col("id").alias("content_id"))
    return I.stale_deliveries(delivered, affected_sections(s, d).select("id"))


def short_circuit(s, d):
    return I.short_circuit(fingerprint(s, d), _stored_roots(s, d), extractor=4)


def rebinds(s, d):
    """Files of today against the hashes of themselves under other names, for all whose path holds a ``g``."""
    f = table(s, d, "source_files")
    before = f.select(F.when(F.col("path").contains("g"), F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path")).alias("path"), S.content_hash(F.col("content")).alias("content_hash"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(4).cast("long").alias("extractor_version"), F.lit(2).cast("long").alias("resolver_version"))
    return I.rebinds(f, before)


def rollback(s, d):
    """Documents but for those of the runs that failed; a source is a run, and it failed if its name ends in 3."""
    docs = table(s, d, "documents")
    runs = docs.select(F.col("source").alias("run_id")).distinct().withColumn("state", F.when(F.col("run_id").endswith("3"), "failed").otherwise("done"))
    return I.rollback(docs, runs, "source").groupBy("source").agg(F.count("*").alias("documents"))


def throughput(s, d):
    return I.throughput(table(s, d, "events"), 3600)


def recent_activity(s, d):
    """The last five events of each user."""
    return I.recent(table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq")), 5, ["user_id"])


def recent_errors(s, d):
    """The last hundred errors of all users."""
    return I.recent(table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq")), 100, where={"event_type": "error"})


def backlog(s, d):
    """Files with a hash but without a current one."""
    f = freshness(s, d)
    return I.backlog(f.select(F.col("path").alias("id")), f.where("state = 'current'").select(F.col("path").alias("id")))


QUERIES = {f.__name__: f for f in (stale_deliveries, short_circuit, rebinds, rollback, throughput, recent_activity, recent_errors, backlog, freshness, latest_hashes, change_actions, stale_sweep, fingerprint, coalesced_events, coherence_stream, answer_cache, affected_sections)}

_H = "h AS (SELECT path, max({'m': coalesce(mtime_ns, -1), 'e': extractor_version, 'r': resolver_version, 'c': content_hash}) AS k FROM file_hashes GROUP BY 1)"
_EV = """ev AS (SELECT user_id::VARCHAR || '/' || json_extract_string(props, '$.k') AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS kind, event_id AS seq FROM events)"""

ORACLE = {
    "freshness": f"""WITH {_H} SELECT coalesce(f.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'missing' WHEN sha256(f.content) = k.c THEN 'current' ELSE 'stale' END AS state FROM source_files f FULL JOIN h ON h.path = f.path""",
    "latest_hashes": f"WITH {_H} SELECT path, k.c AS content_hash, CASE WHEN k.m >= 0 THEN k.m::VARCHAR END AS mtime_ns, k.e AS extractor_version, k.r AS resolver_version FROM h",
    "change_actions": f"""WITH {_H} SELECT f.path, CASE WHEN h.path IS NULL OR sha256(f.content) <> k.c OR k.e < 4 THEN 'reindex' WHEN k.r < 2 THEN 'resolve' ELSE 'skip' END AS action FROM source_files f LEFT JOIN h ON h.path = f.path""",
    "stale_sweep": "SELECT DISTINCT path FROM file_hashes WHERE path NOT IN (SELECT path FROM source_files) AND (SELECT count(*) FROM source_files) > 0",
    "fingerprint": """WITH o AS (SELECT root_id, sha256(path)[1:3] AS b, path || chr(1) || sha256(content) AS e FROM source_files), g AS (SELECT root_id, b, count(*) AS n, sha256(string_agg(e, chr(10) ORDER BY e)) AS h FROM o GROUP BY 1, 2)
        SELECT root_id, sum(n)::BIGINT AS files, sha256(string_agg(b || h, chr(10) ORDER BY b || h)) AS root_hash FROM g GROUP BY 1""",
    "coalesced_events": f"WITH {_EV} SELECT path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM ev GROUP BY 1",
    "coherence_stream": f"WITH {_EV} SELECT path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM ev GROUP BY 1",
    "answer_cache": """WITH x AS (SELECT DISTINCT id, document_id, depth, text, sha256(text) AS h FROM sections WHERE text IS NOT NULL), s AS (SELECT document_id AS q, id, CASE WHEN h[1] IN ('1', '3') THEN 'old' ELSE h END AS sh FROM x),
        j AS (SELECT q, bool_and(h = sh) AS ok FROM s JOIN x ON x.id = s.id AND x.depth > 0 GROUP BY 1) SELECT DISTINCT s.q AS query_hash, coalesce(ok, true) AS valid FROM s LEFT JOIN j ON j.q = s.q""",
    "affected_sections": "SELECT DISTINCT document_id, id FROM sections WHERE document_id IN (SELECT source_path FROM documents WHERE ingested_at > (SELECT max(ingested_at) FROM documents) - INTERVAL 7 DAY)",
}
_FP = ORACLE["fingerprint"]
ORACLE |= {
    "short_circuit": f"WITH fp AS ({_FP}) SELECT root_id, files, CASE WHEN length(root_id) % 2 = 0 AND root_id[1] < 'n' THEN files ELSE 0 END AS skipped FROM fp",
    "rebinds": """WITH f AS (SELECT path, sha256(content) AS h FROM source_files WHERE content IS NOT NULL AND contains(path, 'g')), n AS (SELECT h, 'old/' || path AS p, row_number() OVER (PARTITION BY h ORDER BY 'old/' || path) AS k FROM f), m AS (SELECT h, path AS p, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM f)
        SELECT n.p AS old_path, m.p AS new_path FROM n JOIN m ON n.h = m.h AND n.k = m.k""",
    "rollback": "SELECT source, count(*) AS documents FROM documents WHERE source IS NULL OR NOT ends_with(source, '3') GROUP BY 1",
    "throughput": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, count(*) AS events, round(count(*) / 3600::DOUBLE, 6) AS per_second FROM events GROUP BY 1",
    "recent_activity": "SELECT user_id, event_type, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "recent_errors": "SELECT user_id, event_type, event_id AS seq FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100",
    "backlog": f"WITH st AS ({ORACLE['freshness']}) SELECT count(*) FILTER (state <> 'current') AS waiting FROM st",
}
ORACLE["stale_deliveries"] = f"WITH a AS ({ORACLE['affected_sections']}) SELECT position % 10 AS session_id, id AS content_id FROM (SELECT DISTINCT id, position FROM sections WHERE position IS NOT NULL) x WHERE id IN (SELECT id FROM a)"

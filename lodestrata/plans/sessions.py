"""Queries over sessions.

Deliveries come from the event table: a user is a session, event_type and the
JSON key are the content, the order of events gives the turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.operators import sessions as X
from lodestrata.session import table

CAPACITY = 2000


def deliveries(s, d):
    e = table(s, d, "events")
    content = F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    resolution = F.create_map(*[F.lit(x) for p in (("view", "section"), ("click", "claim"), ("signup", "summary"), ("purchase", "symbol-full"), ("error", "symbol-stub")) for x in p])[F.col("event_type")]
    base = e.select(F.col("user_id").alias("session_id"), content.alias("content_id"), turn.cast("long").alias("turn"), F.ceil("value").cast("int").alias("tokens"), resolution.alias("resolution"))
    return base.withColumn("content_hash", F.sha2(F.concat("content_id", F.expr("cast(turn div 20 as string)")), 256))


def read_protocol(s, d):
    return X.read_protocol(deliveries(s, d)).select("session_id", "turn", "content_id", "action")


def session_metrics(s, d):
    return X.metrics(deliveries(s, d))


def usage_level(s, d):
    return X.usage(deliveries(s, d), CAPACITY).select("session_id", "turn", "used", "fraction", "level")


def drop_ranking(s, d):
    return X.drop_ranking(deliveries(s, d))


def drop_ranking_salient(s, d):
    """With the two event types of a user that are most frequent as task words."""
    c = table(s, d, "events").groupBy(F.col("user_id").alias("session_id"), "event_type").agg(F.count("*").alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "event_type"))).where("r <= 2")
    words = top.groupBy("session_id").agg(F.array_sort(F.collect_list("event_type")).alias("keywords"))  # two entries
    return X.drop_ranking(deliveries(s, d), words)


def tier_promotion(s, d):
    u = X.usage(deliveries(s, d), CAPACITY)
    tier = F.element_at(F.array(*[F.lit(t) for t in ("full", "extractive", "abstractive", "bookmark")]), (F.col("turn") % 4 + 1).cast("int"))
    return X.promotions(u.withColumn("tier", tier).withColumn("current_turn", F.max("turn").over(Window.partitionBy("session_id"))))


def fsrs_memory(s, d):
    rating = F.element_at(F.array(*[F.lit(t) for t in ("again", "good", "easy")]), (F.col("turn") % 3 + 1).cast("int"))
    return X.memory_states(deliveries(s, d).select("session_id", F.split("content_id", "/")[0].alias("content_id"), "turn", rating.alias("rating")))


def window_fifo(s, d):
    return X.window_simulation(deliveries(s, d), CAPACITY, "fifo")


def window_lru(s, d):
    return X.window_simulation(deliveries(s, d), CAPACITY, "lru")


def window_fsrs(s, d):
    return X.window_simulation(deliveries(s, d), CAPACITY, "fsrs")


def _typed(s, d, kind):
    return deliveries(s, d).where(F.col("content_id").startswith(kind + "/")).select("session_id", F.split("content_id", "/")[1].alias("path"), "turn")


def outcomes(s, d):
    return X.outcomes(_typed(s, d, "view"), _typed(s, d, "purchase"))


def top_sections(s, d):
    """The ten most accessed parts."""
    a = X.access_counts(table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("section_id")))
    return a.orderBy(F.desc("accesses"), "section_id").limit(10)


def co_access(s, d):
    c = X.co_access(table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("section_id")))
    return c.where("sessions >= 2")


def prefetch_priority(s, d):
    """Priorities of each user's contents: confidence by share, age in turns, hits by count."""
    v = deliveries(s, d)
    g = v.groupBy("session_id", "content_id").agg(F.count("*").alias("hits"), F.max("turn").alias("last"), F.first("resolution").alias("resolution"))
    w = Window.partitionBy("session_id")
    weight = F.coalesce(F.create_map(*[x for k, b in S.AUTHORITY.items() for x in (F.lit(k), F.lit(b))])[F.col("resolution")], F.lit(1.0))
    p = S.prefetch_priority(F.col("hits") / F.sum("hits").over(w), weight, F.max("last").over(w) - F.col("last"), F.col("hits"))
    return g.select("session_id", "content_id", F.round(p, 6).alias("priority"))


def prefetch_candidates(s, d):
    """Candidates for readers that open each document's sections in order."""
    sec = table(s, d, "sections").dropDuplicates(["id"])
    a = sec.select(F.col("document_id").alias("session_id"), F.col("position").alias("turn"), F.col("id").alias("section_id"))
    return X.prefetch_candidates(a, sec).groupBy("strategy").agg(F.count("*").alias("candidates"), F.countDistinct("candidate").alias("different"))


def topic_vectors(s, d):
    e = table(s, d, "embeddings")
    a = e.select(F.col("label").alias("session_id"), F.col("vec_id").alias("turn"), F.col("embedding").alias("vector"))
    t = X.topic_vectors(a)
    return t.select("session_id", "turn", F.transform("topic", lambda x: F.round(x, 5)).alias("topic"))


def hit_rates(s, d):
    e = table(s, d, "events")
    return X.hit_rates(e.select(F.col("event_type").alias("strategy"), (F.col("value") > 50).alias("hit")))


def _orders(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("section_id"), F.col("l_linenumber").alias("turn"))


def co_access_flush(s, d):
    """The second flush of each session: lines from the third on, against the first two, which were counted."""
    o = _orders(s, d)
    return X.co_access_incremental(o.where("turn > 2"), o.where("turn <= 2")).where("sessions >= 2")


def co_accessed(s, d):
    return X.co_accessed(co_access(s, d), 3)


def prefetch_cross_session(s, d):
    """Parts bought together in two or more orders, as candidates for each line of an order."""
    both = X.co_accessed(co_access(s, d), 1_000_000).select("section_id", F.col("partner").alias("candidate"), F.col("sessions").alias("score"))
    return X.prefetch_related(_orders(s, d), both, "cross_session", 2)


def prefetch_planned(s, d):
    """Users that begin to read the results of a search: signups and errors are searches with the next four keys as results."""
    v = deliveries(s, d)
    key = F.split("content_id", "/")[1].cast("int")
    searches = v.where(F.col("content_id").startswith("signup/") | F.col("content_id").startswith("error/"))
    surveys = searches.select("session_id", "turn", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("rank"), key.alias("k")).select("session_id", "turn", ((F.col("k") + F.col("rank")) % 100).cast("string").alias("section_id"), "rank")
    calls = v.where(F.col("content_id").startswith("view/")).select("session_id", "turn", key.cast("string").alias("section_id"))
    return X.prefetch_planned(calls, surveys)


def priority_cache(s, d):
    """A cache of five entries that every delivery asks for and then puts."""
    v = deliveries(s, d).select("session_id", "turn", F.split("content_id", "/")[1].alias("key"), F.when(F.col("resolution") == "section", "sequential").otherwise("structural").alias("strategy"), (F.col("tokens") / 500).alias("confidence"))
    asked = v.select("session_id", (2 * F.col("turn")).alias("turn"), F.lit("get").alias("op"), "key", "strategy", "confidence")
    return X.priority_cache(asked.unionByName(v.select("session_id", (2 * F.col("turn") + 1).alias("turn"), F.lit("put").alias("op"), "key", "strategy", "confidence")), 5)


def session_totals(s, d):
    return X.totals(deliveries(s, d), window_lru(s, d), tier_promotion(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        co_access_flush, co_accessed, prefetch_cross_session, prefetch_planned, priority_cache, session_totals, read_protocol, session_metrics, usage_level, drop_ranking, drop_ranking_salient, tier_promotion, fsrs_memory, window_fifo, window_lru, window_fsrs, outcomes, top_sections, co_access,
        prefetch_priority, prefetch_candidates, topic_vectors, hit_rates,
    )
}

_D = """d AS (SELECT user_id AS session_id, event_type || '/' || json_extract_string(props, '$.k') AS content_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, ceil(value)::INT AS tokens,
 CASE event_type WHEN 'view' THEN 'section' WHEN 'click' THEN 'claim' WHEN 'signup' THEN 'summary' WHEN 'purchase' THEN 'symbol-full' ELSE 'symbol-stub' END AS resolution FROM events),
 h AS (SELECT *, sha256(content_id || (turn // 20)::VARCHAR) AS content_hash FROM d)"""
_A = """a AS (SELECT *, lag(content_hash) OVER (PARTITION BY session_id, content_id ORDER BY turn) AS last_ FROM h), ac AS (SELECT *, CASE WHEN last_ IS NULL THEN 'new' WHEN last_ = content_hash THEN 'unchanged' ELSE 'changed' END AS action FROM a)"""
_U = f"""u AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn) AS used FROM h), uf AS (SELECT *, round(least(1.0, used / {CAPACITY}::DOUBLE), 6) AS fraction FROM u),
 ul AS (SELECT *, CASE WHEN fraction >= 0.95 THEN 'critical' WHEN fraction >= 0.80 THEN 'elevated' ELSE 'normal' END AS level FROM uf)"""
_DROP = """w AS (SELECT *, max(turn) OVER s AS now_, min(turn) OVER s AS low, max(tokens) OVER s AS most FROM {src} WINDOW s AS (PARTITION BY session_id)),
 pl AS (SELECT *, CASE WHEN now_ > low THEN (turn - low) / (now_ - low)::DOUBLE ELSE 0.0 END AS p FROM w),
 bs AS (SELECT *, 0.30::DOUBLE * (now_ - turn) / now_ + 0.15::DOUBLE * tokens / greatest(most, 1) + 0.15::DOUBLE * 4 * p * (1 - p) + 0.10::DOUBLE * CASE resolution WHEN 'summary' THEN 1.0 WHEN 'section' THEN 0.5 WHEN 'claim' THEN 0.2 WHEN 'symbol-stub' THEN 0.8 ELSE 0.4 END + 0.20::DOUBLE * (1 - salience) AS base FROM pl),
 nb AS (SELECT *, lag(base) OVER o AS b1, lead(base) OVER o AS b2 FROM bs WINDOW o AS (PARTITION BY session_id ORDER BY turn)),
 sc AS (SELECT session_id, content_id, turn, round(base + 0.1::DOUBLE * CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN (b1 + b2) / 2 ELSE coalesce(b1, b2, 0.0) END, 6) AS score FROM nb)
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn)::INT AS rank FROM sc"""

ORACLE = {
    "read_protocol": f"WITH {_D}, {_A} SELECT session_id, turn, content_id, action FROM ac",
    "session_metrics": f"""WITH {_D}, {_A}, m AS (SELECT session_id, count(*) AS deliveries, sum(tokens)::BIGINT AS tokens, sum((action = 'unchanged')::INT)::BIGINT AS dedup_hits, sum((action = 'changed')::INT)::BIGINT AS redeliveries, sum(CASE WHEN action = 'unchanged' THEN tokens ELSE 0 END)::BIGINT AS saved FROM ac GROUP BY 1)
        SELECT *, round(CASE WHEN tokens > 0 THEN saved / tokens::DOUBLE ELSE 0.0 END, 6) AS saved_ratio FROM m""",
    "usage_level": f"WITH {_D}, {_U} SELECT session_id, turn, used::BIGINT AS used, fraction, level FROM ul",
    "drop_ranking": f"WITH {_D}, z AS (SELECT *, 0.0::DOUBLE AS salience FROM h), " + _DROP.format(src="z"),
    "drop_ranking_salient": f"""WITH {_D}, k AS (SELECT user_id AS session_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2), kw AS (SELECT session_id, list(event_type) AS ks FROM k WHERE r <= 2 GROUP BY 1),
        z AS (SELECT h.*, coalesce(CASE WHEN len(ks) > 0 THEN least(1.0::DOUBLE, len(list_filter(ks, lambda x: contains(lower(content_id), x))) / least(3, len(ks))::DOUBLE) END, 0.0) AS salience FROM h LEFT JOIN kw USING (session_id)), """ + _DROP.format(src="z"),
    "tier_promotion": f"""WITH {_D}, {_U}, t AS (SELECT *, (['full', 'extractive', 'abstractive', 'bookmark'])[turn % 4 + 1] AS tier, max(turn) OVER (PARTITION BY session_id) AS now_ FROM ul),
        n AS (SELECT *, CASE WHEN level = 'elevated' AND tier = 'full' THEN 'extractive' WHEN level = 'critical' AND tier = 'full' THEN 'abstractive' WHEN level IN ('elevated', 'critical') AND tier IN ('extractive', 'abstractive') THEN 'bookmark' WHEN level = 'critical' AND tier = 'bookmark' THEN 'evicted' END AS next_tier FROM t)
        SELECT session_id, content_id, turn, tier, next_tier, greatest(0, tokens - CASE next_tier WHEN 'bookmark' THEN 5 WHEN 'evicted' THEN 0 WHEN 'extractive' THEN floor(tokens * 0.3::DOUBLE) ELSE floor(tokens * 0.1::DOUBLE) END)::BIGINT AS freed
        FROM n WHERE next_tier IS NOT NULL AND NOT (level = 'elevated' AND now_ - turn < 3)""",
    "fsrs_memory": f"""WITH RECURSIVE {_D}, x AS (SELECT session_id, string_split(content_id, '/')[1] AS content_id, turn, (['again', 'good', 'easy'])[turn % 3 + 1] AS rating FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, content_id ORDER BY turn) AS i FROM x),
        m AS (SELECT session_id, content_id, turn, i, 1.0::DOUBLE AS s, 0.3::DOUBLE AS d FROM n WHERE i = 1
          UNION ALL SELECT session_id, content_id, turn, i, CASE WHEN rating = 'again' THEN greatest(0.1, s * 0.5) ELSE s * greatest(1.01, 1 + exp(0.1) * greatest(1.0, 11 - d2 * 10) * pow(s, -0.2) * (exp(0.05 * (1 - r)) - 1)) END, d2 FROM
          (SELECT n.*, m.s, 1 / (1 + (n.turn - m.turn)::DOUBLE / (9 * greatest(m.s, 0.1))) AS r, CASE n.rating WHEN 'again' THEN least(1.0, m.d + 0.2) WHEN 'easy' THEN greatest(0.0, m.d - 0.1) ELSE m.d END AS d2 FROM m JOIN n ON n.session_id = m.session_id AND n.content_id = m.content_id AND n.i = m.i + 1))
        SELECT session_id, content_id, round(arg_max(s, i), 6) AS stability, round(arg_max(d, i), 6) AS difficulty, arg_max(turn, i) AS last_turn, max(i)::INT AS accesses FROM m GROUP BY 1, 2""",
    "outcomes": f"""WITH {_D}, r AS (SELECT session_id, string_split(content_id, '/')[2] AS path, min(turn) AS rt FROM h WHERE starts_with(content_id, 'view/') GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rt, path) AS touch FROM r),
        e AS (SELECT session_id, string_split(content_id, '/')[2] AS path, max(turn) AS et FROM h WHERE starts_with(content_id, 'purchase/') GROUP BY 1, 2)
        SELECT f.session_id, count(*) AS reads, sum(coalesce(et > rt, false)::INT)::BIGINT AS joined, sum((coalesce(et > rt, false) AND touch = 1)::INT)::BIGINT AS first_touch FROM f LEFT JOIN e ON e.session_id = f.session_id AND e.path = f.path GROUP BY 1""",
    "top_sections": "SELECT l_partkey AS section_id, count(*) AS accesses FROM lineitem GROUP BY 1 ORDER BY accesses DESC, section_id LIMIT 10",
    "co_access": "WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT a.p AS a, b.p AS b, count(*) AS sessions FROM x a JOIN x b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2",
    "prefetch_priority": f"""WITH {_D}, g AS (SELECT session_id, content_id, count(*) AS hits, max(turn) AS last_, any_value(resolution) AS resolution FROM h GROUP BY 1, 2)
        SELECT session_id, content_id, round(hits / sum(hits) OVER w * CASE resolution WHEN 'section' THEN 1.5 WHEN 'symbol-full' THEN 1.3 WHEN 'symbol-stub' THEN 1.15 WHEN 'claim' THEN 0.9 ELSE 0.85 END::DOUBLE * pow(0.95, max(last_) OVER w - last_) * (1 + log2(1 + hits)), 6) AS priority FROM g WINDOW w AS (PARTITION BY session_id)""",
    "prefetch_candidates": """WITH s AS (SELECT DISTINCT id, document_id, position FROM sections), x AS (SELECT id, lead(id) OVER o AS nx, list(id) OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ar FROM s WINDOW o AS (PARTITION BY document_id ORDER BY position)),
        c AS (SELECT 'sequential' AS strategy, nx AS candidate FROM x WHERE nx IS NOT NULL UNION ALL SELECT 'structural', unnest(list_filter(ar, lambda z: z <> id)[1:3]) FROM x)
        SELECT strategy, count(*) AS candidates, count(DISTINCT candidate) AS different FROM c GROUP BY 1""",
    "topic_vectors": """WITH v AS (SELECT label AS session_id, vec_id AS turn, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT session_id, turn, list(v) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hs FROM v),
        t AS (SELECT session_id, turn, [list_sum([hs[i][j] * pow(0.7, len(hs) - i) FOR i IN range(1, len(hs) + 1)]) FOR j IN range(1, 65)] AS t FROM h), n AS (SELECT *, sqrt(list_sum([x * x FOR x IN t])) AS n FROM t)
        SELECT session_id, turn, [round(x / n, 5) FOR x IN t] AS topic FROM n""",
    "hit_rates": "SELECT event_type AS strategy, sum((value > 50)::INT)::BIGINT AS hits, round(sum((value > 50)::INT) / (SELECT count(*) FROM events)::DOUBLE, 6) AS rate FROM events GROUP BY 1",
}
_CO = ORACLE["co_access"]
ORACLE |= {
    "co_access_flush": """WITH n AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber > 2), q AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2),
        pr AS (SELECT a.o, a.p AS a, b.p AS b FROM n a JOIN n b ON a.o = b.o AND a.p < b.p UNION SELECT n.o, least(n.p, q.p), greatest(n.p, q.p) FROM n JOIN q ON n.o = q.o AND n.p <> q.p) SELECT a, b, count(*) AS sessions FROM pr GROUP BY 1, 2 HAVING count(*) >= 2""",
    "co_accessed": f"WITH c AS ({_CO}), d AS (SELECT a AS section_id, b AS partner, sessions FROM c UNION ALL SELECT b, a, sessions FROM c) SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY sessions DESC, partner)::INT AS rank FROM d QUALIFY rank <= 3",
    "prefetch_cross_session": f"""WITH c AS ({_CO}), r AS (SELECT a AS section_id, b AS candidate, sessions FROM c UNION ALL SELECT b, a, sessions FROM c), a AS (SELECT l_orderkey AS s, l_partkey AS p, l_linenumber AS t FROM lineitem),
        f AS (SELECT s, p, min(t) AS ft FROM a GROUP BY 1, 2), j AS (SELECT a.s, a.t, candidate, sessions FROM a JOIN r ON r.section_id = a.p LEFT JOIN f ON f.s = a.s AND f.p = candidate WHERE ft IS NULL OR ft > a.t)
        SELECT s AS session_id, t AS turn, candidate, 'cross_session' AS strategy FROM j QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY sessions DESC, candidate) <= 2""",
    "prefetch_planned": f"""WITH {_D}, k AS (SELECT session_id, turn, content_id, string_split(content_id, '/')[2]::INT AS k FROM h), sv AS (SELECT session_id, turn AS asked, (k + r) % 100 AS c, r FROM k, range(1, 5) t(r) WHERE starts_with(content_id, 'signup/') OR starts_with(content_id, 'error/')),
        rd AS (SELECT session_id, turn, k AS c FROM k WHERE starts_with(content_id, 'view/')), nw AS (SELECT rd.session_id, rd.turn, rd.c, max(asked) AS asked FROM rd JOIN (SELECT DISTINCT session_id, asked FROM sv) q ON q.session_id = rd.session_id AND asked < rd.turn GROUP BY 1, 2, 3),
        bg AS (SELECT * FROM nw WHERE EXISTS (SELECT 1 FROM sv WHERE sv.session_id = nw.session_id AND sv.asked = nw.asked AND sv.c = nw.c)), fr AS (SELECT session_id, c, min(turn) AS ft FROM rd GROUP BY 1, 2),
        op AS (SELECT bg.session_id, bg.turn, sv.c, sv.r FROM bg JOIN sv ON sv.session_id = bg.session_id AND sv.asked = bg.asked AND sv.c <> bg.c LEFT JOIN fr ON fr.session_id = bg.session_id AND fr.c = sv.c WHERE ft IS NULL OR ft > bg.turn)
        SELECT session_id, turn, c::VARCHAR AS candidate, 'agent_plan' AS strategy FROM op QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY r, c::VARCHAR) <= 3""",
}

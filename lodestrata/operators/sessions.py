"""Delivery sessions: ledger, budgets, eviction, memory, prefetch and outcomes.

Deliveries: session_id, content_id, resolution, tokens, turn, content_hash.
Turns are unique within a session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S

# Weights of the drop ranking and what each resolution scores in it.
DROP_WEIGHTS = {"recency": 0.30, "tokens": 0.15, "position": 0.15, "resolution": 0.10, "salience": 0.20}
RESOLUTION_SCORES = {"summary": 1.0, "section": 0.5, "claim": 0.2, "symbol-stub": 0.8, "symbol-full": 0.4}
CONTIGUITY = 0.1
# What each compression tier keeps.
RETENTION = {"full": 1.0, "extractive": 0.30, "abstractive": 0.10}
BOOKMARK_TOKENS = 5
# What a prefetch of each strategy weighs.
STRATEGY_WEIGHTS = {"sequential": 1.0, "topical": 0.7, "structural": 0.8, "cross_session": 0.6, "survey_expand": 0.9, "agent_plan": 0.5}


def _map(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key], F.lit(default))


def read_protocol(deliveries: DataFrame) -> DataFrame:
    """Deliveries with an action: new, unchanged (a stub is enough) or changed, by the hash of the last delivery of the content in the session."""
    last = F.lag("content_hash").over(Window.partitionBy("session_id", "content_id").orderBy("turn"))
    return deliveries.withColumn("action", F.when(last.isNull(), "new").when(last == F.col("content_hash"), "unchanged").otherwise("changed"))


def metrics(deliveries: DataFrame) -> DataFrame:
    """(session_id, deliveries, tokens, dedup_hits, redeliveries, saved, saved_ratio)."""
    a = read_protocol(deliveries)
    is_ = lambda x: F.col("action") == x
    out = a.groupBy("session_id").agg(
        F.count("*").alias("deliveries"), F.sum("tokens").alias("tokens"), F.sum(is_("unchanged").cast("int")).alias("dedup_hits"), F.sum(is_("changed").cast("int")).alias("redeliveries"),
        F.sum(F.when(is_("unchanged"), F.col("tokens")).otherwise(0)).alias("saved"),
    )
    return out.withColumn("saved_ratio", F.round(F.when(F.col("tokens") > 0, F.col("saved") / F.col("tokens")).otherwise(0.0), 6))


def usage(deliveries: DataFrame, capacity: int) -> DataFrame:
    """Deliveries with used tokens so far, the fraction of the capacity, and the level."""
    used = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    fraction = F.lit(1.0) if capacity <= 0 else F.least(F.lit(1.0), F.col("used") / capacity)
    return deliveries.withColumn("used", used).withColumn("fraction", F.round(fraction, 6)).withColumn("level", S.usage_level(F.col("fraction")))


def drop_ranking(deliveries: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(session_id, content_id, turn, score, rank): what to drop first.

    Recency, size, place (the middle goes first), resolution and salience, plus a
    tenth of the neighbours' mean.  ``keywords``: session_id, keywords.
    """
    s = Window.partitionBy("session_id")
    d = deliveries
    if keywords is not None:
        d = d.join(keywords, "session_id", "left")
        hits = F.size(F.filter("keywords", lambda k: F.lower("content_id").contains(k)))
        salience = F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, F.least(F.lit(1.0), hits / F.least(F.lit(3), F.size("keywords")))).otherwise(0.0)
    else:
        salience = F.lit(0.0)
    now, low, high, most = F.max("turn").over(s), F.min("turn").over(s), F.max("turn").over(s), F.greatest(F.max("tokens").over(s), F.lit(1))
    place = F.when(high > low, (F.col("turn") - low) / (high - low)).otherwise(0.0)
    w = DROP_WEIGHTS
    base = (
        w["recency"] * F.when(now > 0, (now - F.col("turn")) / now).otherwise(0.0) + w["tokens"] * F.col("tokens") / most + w["position"] * 4 * place * (1 - place)
        + w["resolution"] * _map(RESOLUTION_SCORES, F.col("resolution"), 0.5) + w["salience"] * (1 - salience)
    )
    b = d.withColumn("base", base)
    order = Window.partitionBy("session_id").orderBy("turn")
    before, after = F.lag("base").over(order), F.lead("base").over(order)
    neighbours = F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2).otherwise(F.coalesce(before, after, F.lit(0.0)))
    scored = b.withColumn("score", F.round(F.col("base") + CONTIGUITY * neighbours, 6))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "turn"))
    return scored.select("session_id", "content_id", "turn", "score", rank.alias("rank"))


def promotions(items: DataFrame, protect_turns: int = 3) -> DataFrame:
    """(session_id, content_id, turn, tier, next_tier, freed) of items (… tier, level, current_turn) under pressure."""
    tier, level = F.col("tier"), F.col("level")
    squeezed = tier.isin("extractive", "abstractive")
    nxt = F.when((level == "elevated") & (tier == "full"), "extractive").when((level == "critical") & (tier == "full"), "abstractive").when(level.isin("elevated", "critical") & squeezed, "bookmark").when((level == "critical") & (tier == "bookmark"), "evicted")
    out = items.withColumn("next_tier", nxt).where(F.col("next_tier").isNotNull() & ~((level == "elevated") & (F.col("current_turn") - F.col("turn") < protect_turns)))
    scale = F.least(F.lit(1.0), _map(RETENTION, F.col("next_tier"), 1.0) / _map(RETENTION, tier, 1.0))
    left = F.when(F.col("next_tier") == "bookmark", BOOKMARK_TOKENS).when(F.col("next_tier") == "evicted", 0).otherwise(F.floor(F.col("tokens") * scale))
    return out.withColumn("freed", F.greatest(F.lit(0), F.col("tokens") - left).cast("long")).select("session_id", "content_id", "turn", "tier", "next_tier", "freed")


def memory_states(accesses: DataFrame) -> DataFrame:
    """(session_id, content_id, stability, difficulty, last_turn, accesses) after the accesses (… turn, rating: again, good, easy) in order.

    An ordered fold per key; the difficulty is updated before the growth.
    """
    rows = F.array_sort(F.collect_list(F.struct("turn", "rating")))
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.3).alias("d"), F.lit(-1).cast("long").alias("t"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        r = S.retrievability((x["turn"] - acc["t"]).cast("double"), acc["s"])
        d = F.when(x["rating"] == "again", F.least(F.lit(1.0), acc["d"] + 0.2)).when(x["rating"] == "easy", F.greatest(F.lit(0.0), acc["d"] - 0.1)).otherwise(acc["d"])
        growth = 1 + F.exp(F.lit(0.1)) * F.greatest(F.lit(1.0), 11 - d * 10) * F.pow(acc["s"], F.lit(-0.2)) * (F.exp(0.05 * (1 - r)) - 1)
        s = F.when(x["rating"] == "again", F.greatest(F.lit(0.1), acc["s"] * 0.5)).otherwise(acc["s"] * F.greatest(F.lit(1.01), growth))
        first = acc["n"] == 0
        return F.struct(F.when(first, acc["s"]).otherwise(s).alias("s"), F.when(first, acc["d"]).otherwise(d).alias("d"), x["turn"].cast("long").alias("t"), (acc["n"] + 1).alias("n"))

    folded = accesses.groupBy("session_id", "content_id").agg(rows.alias("rows")).withColumn("m", F.aggregate("rows", start, step))
    return folded.select("session_id", "content_id", F.round("m.s", 6).alias("stability"), F.round("m.d", 6).alias("difficulty"), F.col("m.t").alias("last_turn"), F.col("m.n").alias("accesses"))


class _Memory:
    """The memory state of one content; the same rules as ``memory_states``."""

    def __init__(self, turn: int) -> None:
        self.stability, self.difficulty, self.turn = 1.0, 0.3, turn

    def recall(self, turn: int) -> float:
        return 1 / (1 + (turn - self.turn) / (9 * max(self.stability, 0.1)))

    def accessed(self, turn: int, rating: str) -> None:
        r = self.recall(turn)
        if rating == "again":
            self.difficulty = min(1.0, self.difficulty + 0.2)
            self.stability = max(0.1, self.stability * 0.5)
        else:
            self.difficulty = max(0.0, self.difficulty - 0.1) if rating == "easy" else self.difficulty
            growth = 1 + math.exp(0.1) * max(1.0, 11 - self.difficulty * 10) * self.stability**-0.2 * (math.exp(0.05 * (1 - r)) - 1)
            self.stability *= max(1.01, growth)
        self.turn = turn


def _by_session(rows: DataFrame, order: str = "turn") -> DataFrame:
    """Rows with each session in one partition, in order, so a fold can stream over it with nothing but its state held."""
    return rows.repartition("session_id").sortWithinPartitions("session_id", order)


def window_simulation(deliveries: DataFrame, capacity: int, policy: str = "fifo") -> DataFrame:
    """(session_id, content_id, evicted_turn): evictions of a context window of limited tokens; policies fifo, lru, fsrs.

    A content that comes again leaves its place and goes to the end, whatever the
    policy.  fifo and lru evict from the front, the fresh content too if it alone
    exceeds the window; fsrs evicts what is recalled least, the earliest of equals,
    the fresh content counting as wholly recalled.  A column ``rating`` (again, good,
    easy) is used where there is one.  Rows are streamed by session; what is held is
    the window and, for fsrs, one state a content.
    """
    if "rating" not in deliveries.columns:
        deliveries = deliveries.withColumn("rating", F.lit("good"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held, memory, used = None, {}, {}, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.session_id != session:
                    session, held, memory, used = r.session_id, {}, {}, 0
                used += int(r.tokens) - held.pop(r.content_id, 0)
                held[r.content_id] = int(r.tokens)
                if policy == "fsrs":
                    if r.content_id in memory:
                        memory[r.content_id].accessed(r.turn, r.rating)
                    else:
                        memory[r.content_id] = _Memory(r.turn)
                while used > capacity and held:
                    victim = next(iter(held)) if policy != "fsrs" else min(held, key=lambda c: 1.0 if c == r.content_id else memory[c].recall(r.turn))
                    used -= held.pop(victim)
                    out.append((session, victim, r.turn))
            yield pd.DataFrame(out, columns=["session_id", "content_id", "evicted_turn"])

    kind = deliveries.schema["session_id"].dataType.simpleString()
    rows = _by_session(deliveries.select("session_id", "content_id", F.col("tokens").cast("long").alias("tokens"), F.col("turn").cast("long").alias("turn"), "rating"))
    return rows.mapInPandas(run, f"session_id {kind}, content_id string, evicted_turn long")


def priority_cache(requests: DataFrame, capacity: int = 50) -> DataFrame:
    """(session_id, requests, hits, misses, evictions) of a prefetch cache over requests (session_id, turn, op, key, strategy, confidence), op being get or put.

    A put of a new key evicts the key of the least priority once the cache is full,
    recomputed at that turn; of equals the least key.  A get raises the count of its key.
    """

    def priority(e: tuple[int, int, float, float], turn: int) -> float:
        entered, hits, confidence, weight = e
        return confidence * weight * 0.95 ** (turn - entered) * (1 + math.log2(1 + hits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, cache, counts = None, {}, [0, 0, 0, 0]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.session_id != session:
                    out += [(session, *counts)] if session is not None else []
                    session, cache, counts = r.session_id, {}, [0, 0, 0, 0]
                counts[0] += 1
                held = cache.get(r.key)
                if r.op == "get":
                    counts[1 if held else 2] += 1
                    if held:
                        cache[r.key] = (held[0], held[1] + 1, held[2], held[3])
                elif held:
                    cache[r.key] = (held[0], held[1], r.confidence, r.weight)
                elif capacity > 0:
                    if len(cache) >= capacity:
                        del cache[min(cache, key=lambda k: (priority(cache[k], r.turn), k))]
                        counts[3] += 1
                    cache[r.key] = (r.turn, 0, r.confidence, r.weight)
            yield pd.DataFrame(out, columns=["session_id", "requests", "hits", "misses", "evictions"])
        if session is not None:
            yield pd.DataFrame([(session, *counts)], columns=["session_id", "requests", "hits", "misses", "evictions"])

    kind = requests.schema["session_id"].dataType.simpleString()
    weight = _map(STRATEGY_WEIGHTS, F.col("strategy"), 1.0)
    rows = _by_session(requests.select("session_id", F.col("turn").cast("long").alias("turn"), "op", "key", F.col("confidence").cast("double").alias("confidence"), weight.alias("weight")))
    return rows.mapInPandas(run, f"session_id {kind}, requests long, hits long, misses long, evictions long")


def outcomes(reads: DataFrame, edits: DataFrame) -> DataFrame:
    """(session_id, reads, joined, first_touch): files read, of them edited later on, and whether the first one read was.

    ``reads`` and ``edits``: session_id, path, turn.
    """
    first = reads.groupBy("session_id", "path").agg(F.min("turn").alias("read_turn")).withColumn("touch", F.row_number().over(Window.partitionBy("session_id").orderBy("read_turn", "path")))
    last = edits.groupBy("session_id", "path").agg(F.max("turn").alias("edit_turn"))
    j = first.join(last, ["session_id", "path"], "left").withColumn("hit", F.coalesce(F.col("edit_turn") > F.col("read_turn"), F.lit(False)))
    return j.groupBy("session_id").agg(F.count("*").alias("reads"), F.sum(F.col("hit").cast("int")).alias("joined"), F.sum((F.col("hit") & (F.col("touch") == 1)).cast("int")).alias("first_touch"))


def access_counts(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("section_id").agg(F.count("*").alias("accesses"))


def co_access(accesses: DataFrame) -> DataFrame:
    """(a, b, sessions): how many sessions hold both sections, a < b; one join on the session."""
    d = accesses.select("session_id", "section_id").distinct()
    x, y = d.alias("x"), d.alias("y")
    return x.join(y, (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.section_id") < F.col("y.section_id"))).groupBy(F.col("x.section_id").alias("a"), F.col("y.section_id").alias("b")).agg(F.count("*").alias("sessions"))


def co_access_incremental(new: DataFrame, previous: DataFrame) -> DataFrame:
    """(a, b, sessions), a < b: pairs among the new sections of a session, and of new with previously counted ones; so each pair counts once a session however often this runs."""
    fresh, known = new.select("session_id", "section_id").distinct(), previous.select("session_id", "section_id").distinct()
    x, y, z = fresh.alias("x"), fresh.alias("y"), known.alias("z")
    inner = x.join(y, (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.section_id") < F.col("y.section_id"))).select(F.col("x.session_id").alias("s"), F.col("x.section_id").alias("p"), F.col("y.section_id").alias("q"))
    across = x.join(z, (F.col("x.session_id") == F.col("z.session_id")) & (F.col("x.section_id") != F.col("z.section_id"))).select(F.col("x.session_id").alias("s"), F.col("x.section_id").alias("p"), F.col("z.section_id").alias("q"))
    pairs = inner.unionByName(across).select("s", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("sessions"))


def co_accessed(pairs: DataFrame, k: int) -> DataFrame:
    """(section_id, partner, sessions, rank): of each section the k others that it shares the most sessions with."""
    both = pairs.select(F.col("a").alias("section_id"), F.col("b").alias("partner"), "sessions").unionByName(pairs.select(F.col("b").alias("section_id"), F.col("a").alias("partner"), "sessions"))
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("sessions"), "partner"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def totals(deliveries: DataFrame, evictions: DataFrame, compressions: DataFrame) -> DataFrame:
    """The metrics of sessions with their evictions and compressions (both: session_id)."""
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    out = metrics(deliveries).join(count(evictions, "evictions"), "session_id", "left").join(count(compressions, "compressions"), "session_id", "left")
    return out.withColumn("evictions", F.coalesce("evictions", F.lit(0))).withColumn("compressions", F.coalesce("compressions", F.lit(0)))


def topic_vectors(accesses: DataFrame, decay: float = 0.3, last: int = 5) -> DataFrame:
    """(session_id, turn, topic): of the last accesses, the normalised sum of vectors weighted by (1 - decay) ** age."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-(last - 1), 0)
    held = accesses.withColumn("held", F.collect_list(F.struct("turn", S.as_double(F.col("vector")).alias("v"))).over(w))  # at most `last` entries
    n = F.size("held")
    weighted = F.transform("held", lambda x, i: F.transform(x["v"], lambda y: y * F.pow(F.lit(1 - decay), n - 1 - i)))
    zero = F.transform(F.element_at("held", 1)["v"], lambda x: F.lit(0.0))
    total = F.aggregate(weighted, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return held.select("session_id", "turn", S.l2_normalise(total).alias("topic"))


def prefetch_candidates(accesses: DataFrame, sections: DataFrame, siblings: int = 3) -> DataFrame:
    """(session_id, turn, candidate, strategy): the next section and the nearest siblings of the same document."""
    order = Window.partitionBy("document_id").orderBy("position")
    s = sections.dropDuplicates(["id"]).withColumn("next", F.lead("id").over(order)).withColumn("around", F.collect_list("id").over(order.rowsBetween(-siblings, siblings)))
    j = accesses.join(s.select(F.col("id").alias("section_id"), "next", "around"), "section_id")
    sequential = j.where("next is not null").select("session_id", "turn", F.col("next").alias("candidate"), F.lit("sequential").alias("strategy"))
    near = j.select("session_id", "turn", F.explode(F.slice(F.filter("around", lambda x: x != F.col("section_id")), 1, siblings)).alias("candidate"), F.lit("structural").alias("strategy"))
    return sequential.unionByName(near)


def prefetch_related(accesses: DataFrame, related: DataFrame, strategy: str, most: int) -> DataFrame:
    """(session_id, turn, candidate, strategy): of related sections (section_id, candidate, score) the best so many of each access, but for those that the session has seen.

    Topical candidates come from section similarities, cross-session ones from
    co-accesses, survey expansions from results of the session's own surveys.
    """
    j = accesses.join(related, "section_id").where("candidate <> section_id")
    seen = accesses.select("session_id", F.col("section_id").alias("candidate"), F.col("turn").alias("_t"))
    fresh = j.join(seen.groupBy("session_id", "candidate").agg(F.min("_t").alias("_t")), ["session_id", "candidate"], "left").where(F.col("_t").isNull() | (F.col("_t") > F.col("turn")))
    rank = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy(F.desc("score"), "candidate"))
    return fresh.withColumn("_r", rank).where(F.col("_r") <= most).select("session_id", "turn", "candidate", F.lit(strategy).alias("strategy"))


def prefetch_planned(calls: DataFrame, surveys: DataFrame, most: int = 3) -> DataFrame:
    """(session_id, turn, candidate, strategy): after a survey (session_id, turn, section_id, rank) whose results the session begins to read (calls: session_id, turn, section_id), the best results not yet read."""
    last = surveys.select("session_id", F.col("turn").alias("asked"), F.col("section_id").alias("candidate"), "rank")
    read = calls.select("session_id", "turn", "section_id")
    newest = read.join(last.select("session_id", "asked").distinct(), "session_id").where("asked < turn").groupBy("session_id", "turn", "section_id").agg(F.max("asked").alias("asked"))
    begun = newest.join(last.select("session_id", "asked", F.col("candidate").alias("section_id")), ["session_id", "asked", "section_id"], "left_semi")
    open_ = begun.join(last, ["session_id", "asked"]).where("candidate <> section_id")
    before = read.select("session_id", F.col("section_id").alias("candidate"), F.col("turn").alias("_t")).groupBy("session_id", "candidate").agg(F.min("_t").alias("_t"))
    fresh = open_.join(before, ["session_id", "candidate"], "left").where(F.col("_t").isNull() | (F.col("_t") > F.col("turn")))
    order = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("rank", "candidate"))
    return fresh.withColumn("_r", order).where(F.col("_r") <= most).select("session_id", "turn", "candidate", F.lit("agent_plan").alias("strategy"))


def hit_rates(prefetches: DataFrame) -> DataFrame:
    """(strategy, hits, rate): hits of each strategy over all prefetches (strategy, hit)."""
    total = prefetches.agg(F.count("*").alias("all"))
    return prefetches.groupBy("strategy").agg(F.sum(F.col("hit").cast("int")).alias("hits")).crossJoin(F.broadcast(total)).select("strategy", "hits", F.round(F.col("hits") / F.col("all"), 6).alias("rate"))  # one row

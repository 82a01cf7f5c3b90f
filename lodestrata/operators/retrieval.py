"""Dense and sparse search, fusion, rescoring, exclusion, merging and evaluation; batches of queries by ``query_id``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.session import spread

#: Queries that are compared at once; their vectors are sent with the tasks, so the block is the size bound.
QUERY_BLOCK = 4096


def knn_exact(points: DataFrame, queries: DataFrame, k: int, pool: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest points of each query by cosine distance, ties by id.

    ``points``: id, vector and, with ``pool``, a column content, of which only
    the best point counts.  Queries go through in blocks of ``QUERY_BLOCK``; each
    task keeps only its own best k of a query, so what is shuffled is
    tasks x queries x k rows.  Degenerate vectors aren't compared.
    """
    out = None
    key = "string" if pool else points.schema["id"].dataType.simpleString()
    use = points.where(~S.degenerate(S.as_double(F.col("vector"))))
    use = spread(use.select(F.col("content").cast("string").alias("content") if pool else F.lit("").alias("content"), "id", "vector"))
    block: list = []

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        wide = max(len(r[1]) for r in rows)
        q = np.array([[*r[1], *[0.0] * (wide - len(r[1]))] for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # a content among the k nearest of all is among the k nearest of its task, so each task holds and gives k a query
            held = pd.DataFrame({"q": pd.Series(dtype="int64"), "content": pd.Series(dtype=object), "id": pd.Series(dtype=object), "distance": pd.Series(dtype="float64")})
            for batch in batches:
                own = batch[batch["vector"].map(len) == wide]
                for at in range(0, len(own), 2048):
                    part = own.iloc[at : at + 2048]
                    x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    d = np.round(1 - q @ x.T, 9)
                    if pool:  # the best point of each content in the part
                        codes, contents = pd.factorize(part["content"])
                        order = np.lexsort((part["id"].to_numpy(), codes))
                        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                        d, names = d[:, order], part["id"].to_numpy()[order]
                        best = np.minimum.reduceat(d, starts, axis=1)
                    else:
                        best, names, contents = d, part["id"].to_numpy(), None
                    keep = min(k, best.shape[1])
                    limit = np.partition(best, keep - 1, axis=1)[:, keep - 1]
                    r, c = np.nonzero(best <= limit[:, None])
                    if pool:
                        first = [starts[j] + int(np.argmax(d[i, starts[j] : (starts[j + 1] if j + 1 < len(starts) else d.shape[1])] == best[i, j])) for i, j in zip(r, c)]
                        found = pd.DataFrame({"q": r, "content": np.asarray(contents, dtype=object)[codes[order][starts[c]]], "id": names[first], "distance": best[r, c]})
                    else:
                        found = pd.DataFrame({"q": r, "content": "", "id": names[c], "distance": best[r, c]})
                    held = pd.concat([held, found]) if len(held) else found
                    held = held.sort_values(["q", "distance", "content", "id"] if pool else ["q", "distance", "id"], kind="stable")
                    if pool:
                        held = held.drop_duplicates(["q", "content"])
                    held = held[held.groupby("q").cumcount() < k]
            yield pd.DataFrame({"query_id": ids[held["q"].to_numpy(dtype=np.int64)], "content": held["content"] if pool else held["id"], "id": held["id"], "distance": held["distance"]})

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, content {key}, id {points.schema['id'].dataType.simpleString()}, distance double"
        return use.mapInPandas(run, kinds)

    for row in queries.select("query_id", S.as_double(F.col("vector")).alias("v")).where("size(v) > 0").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            part = search(block)
            out = part if out is None else out.unionAll(part)
            block = []
    if block or out is None:
        part = search(block) if block else use.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, content {key}, id {points.schema['id'].dataType.simpleString()}, distance double")
        out = part if out is None else out.unionAll(part)
    own = out.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "content").orderBy("distance", "id"))).where("r = 1")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "content", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", *(["content"] if pool else []), "id", "distance", "rank")


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, term, weight) of documents (doc_id, name, doc, sig, body): saturated term counts, weighted by field.

    Names are counted first and taken apart once each, as in ``scalar.analyze``.
    """
    fields = F.array(*[F.struct(F.lit(w).alias("w"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f, w in S.FIELD_WEIGHTS.items()])
    names = spread(documents.select("doc_id", *S.FIELD_WEIGHTS)).select("doc_id", F.explode(fields).alias("f")).where("f.text <> ''").select("doc_id", F.col("f.w").alias("w"), F.explode(F.split("f.text", r"[^\p{L}\p{N}_]+")).alias("name"))
    counted = names.where("name <> ''").groupBy("doc_id", "w", "name").agg(F.count("*").alias("n"))
    parts = counted.select("doc_id", "w", "n", F.expr(r"concat(array(lower(name)), transform(filter(split(regexp_replace(name, '([\\p{Ll}0-9])(\\p{Lu})', '$1_$2'), '_'), p -> p <> ''), p -> lower(p)))").alias("parts"))
    terms = parts.select("doc_id", "w", "n", F.explode(F.expr("filter(parts, (x, i) -> (i = 0 or x <> parts[i - 1]) and octet_length(x) > 1)")).alias("term"))
    tf = terms.groupBy("doc_id", "w", "term").agg(F.sum("n").alias("tf"))
    return tf.groupBy("doc_id", "term").agg(F.sum(F.col("w") * F.col("tf") / (1 + F.col("tf"))).alias("weight"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def query_terms(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, term, weight): the idf of each distinct term of a query; unseen terms count as in no document."""
    n = index.select("doc_id").distinct().count()
    terms = queries.select("query_id", F.explode(F.array_distinct(S.analyze(F.col("query")))).alias("term"))
    return terms.join(document_frequencies(index), "term", "left").select("query_id", "term", S.idf(F.lit(float(n)), F.coalesce("df", F.lit(0))).alias("weight"))


def sparse_search(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by the dot product over common terms; score descending, id ascending."""
    hits = index.join(terms.withColumnRenamed("weight", "qw"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, sparse_weight: float, k: int) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal rank fusion of (query_id, id, rank) lists; ranks begin at 1."""
    parts = dense.select("query_id", "id", S.rrf(1 - sparse_weight, F.col("rank") - 1).alias("s")).unionByName(sparse.select("query_id", "id", S.rrf(sparse_weight, F.col("rank") - 1).alias("s")))
    total = parts.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def excluding(results: DataFrame, delivered: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(results without what was delivered, number left out) of (query_id, id, score); the exclusion comes before the cut."""
    kept = results.join(delivered, ["query_id", "id"], "left_anti")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked, results.join(delivered, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("deduplicated"))


def rescore(candidates: DataFrame, full: DataFrame, queries: DataFrame, depth: int, blend: float = 0.7) -> DataFrame:
    """(query_id, id, score, rank): candidates cut to the depth, then full-dimension cosine blended with the prior, both scaled by min and max."""
    cut = candidates.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= depth)
    j = cut.join(full.select("id", S.as_double(F.col("vector")).alias("v")), "id", "left").join(queries.select("query_id", S.as_double(F.col("vector")).alias("q")), "query_id")
    w = Window.partitionBy("query_id")
    j = j.withColumn("cos", F.when(F.col("v").isNotNull(), F.round(S.cosine(F.col("v"), F.col("q")), 9)))
    prior = S.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    dense = S.min_max(F.col("cos"), F.min("cos").over(w), F.max("cos").over(w))
    scored = j.select("query_id", "id", F.round(F.when(F.col("cos").isNull(), prior).otherwise(blend * dense + (1 - blend) * prior), 9).alias("new"))
    return scored.select("query_id", "id", F.col("new").alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("new"), "id")).alias("rank"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int, blend: float = 0.8) -> DataFrame:
    """(query_id, id, score, rank): prior scores blended with those of a cross-encoder (query_id, id, rerank), both scaled by min and max; without such a score the prior counts alone."""
    j = candidates.select("query_id", "id", "score").join(scores, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id")
    prior = S.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    own = S.min_max(F.col("rerank"), F.min("rerank").over(w), F.max("rerank").over(w))
    blended = j.select("query_id", "id", F.round(F.when(F.col("rerank").isNull(), prior).otherwise(blend * own + (1 - blend) * prior), 9).alias("new"))
    ranked = blended.select("query_id", "id", F.col("new").alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("new"), "id")).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def resolved(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (query_id, id, …) with their text (id, text), without those that have none or only a placeholder for it."""
    return candidates.join(texts.select("id", "text"), "id").where(F.col("text").isNotNull() & ~S.is_placeholder(F.col("text")))


def survey(dense: DataFrame, sparse: DataFrame, texts: DataFrame, scores: DataFrame | None, k: int, sparse_weight: float = 0.5, over_fetch: int = 3) -> DataFrame:
    """(query_id, id, score, rank, text): both lists fused, more than asked for; texts resolved and placeholders dropped; then reranked and cut."""
    found = resolved(fuse(dense, sparse, sparse_weight, over_fetch * k), texts)
    if scores is not None:
        return rerank(found, scores, k).join(found.select("query_id", "id", "text"), ["query_id", "id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank", "text")


def uncovered(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, question) of the sub-questions that no kept source (query_id, text) answers; they are asked in a second round."""
    held = kept.groupBy("query_id").agg(F.collect_list("text").alias("texts"))  # at most the kept sources of a question
    return questions.join(held, "query_id", "left").where(~S.covered(F.col("question"), F.coalesce("texts", F.array().cast("array<string>")))).select("query_id", "question")


def second_round(first: DataFrame, second: DataFrame, least: float = 3.0, most: int = 8) -> DataFrame:
    """Kept sources (query_id, id, score) of both rounds, the better score of what both found."""
    return kept_sources(first.unionByName(second).groupBy("query_id", "id").agg(F.max("score").alias("score")), least, most)


def merge_corpora(results: DataFrame, boosts: dict[str, float], k: int) -> DataFrame:
    """(query_id, corpus_id, id, score, rank): scores times the corpus's boost, held within 0..10; a boost that is no number is 1."""
    clean = {c: 1.0 if b != b or b in (float("inf"), float("-inf")) else max(0.0, min(10.0, b)) for c, b in boosts.items()}
    pairs = [x for c, b in clean.items() for x in (F.lit(c), F.lit(b))]
    boost = F.coalesce(F.create_map(*pairs)[F.col("corpus_id")], F.lit(1.0)) if pairs else F.lit(1.0)
    scored = results.withColumn("score", F.round(F.col("score") * boost, 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def expand(results: DataFrame, edges: DataFrame, max_expand: int, decay: float = 0.5) -> DataFrame:
    """Results with their neighbours at a lowered score; the best source of a neighbour counts, results themselves aren't repeated."""
    near = results.join(edges.select(F.col("source").alias("id"), "target"), "id").select("query_id", F.col("target").alias("id"), (F.col("score") * decay).alias("score"))
    fresh = near.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    cut = fresh.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= max_expand).drop("r")
    return results.select("query_id", "id", "score").unionByName(cut)


def merge_ranked(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score) of ranked lists (query_id, id, rank, resolution): fused and weighted by the authority of the resolution."""
    pairs = [x for c, b in S.AUTHORITY.items() for x in (F.lit(c), F.lit(b))]
    weight = F.coalesce(F.create_map(*pairs)[F.col("resolution")], F.lit(1.0))
    return lists.groupBy("query_id", "id", "resolution").agg(F.sum(1 / (k + F.col("rank"))).alias("s")).select("query_id", "id", F.round(F.col("s") * weight, 9).alias("score"))


def kept_sources(scored: DataFrame, least: float = 3.0, most: int = 8) -> DataFrame:
    return scored.where(F.col("score") >= least).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= most).drop("r")


def metrics(results: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr, ndcg) of results (query_id, id, rank) against grades (query_id, id, grade)."""
    graded = results.join(relevance, ["query_id", "id"], "left")
    top = F.col("rank") <= k
    hit = F.col("grade").isNotNull()
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    found = graded.groupBy("query_id").agg(
        F.sum((top & hit).cast("int")).alias("hits"), F.least(F.lit(k), F.sum(top.cast("int"))).alias("shown"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(top & hit, gain).otherwise(0.0)).alias("dcg")
    )
    order = relevance.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    ideal = order.groupBy("query_id").agg(F.count("*").alias("expected"), F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"))
    j = ideal.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id", F.round(zero(F.col("hits") / F.col("shown")), 6).alias("precision"), F.round(zero(F.col("hits") / F.col("expected")), 6).alias("recall"),
        F.round(zero(1 / F.col("first")), 6).alias("rr"), F.round(zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 6).alias("ndcg"),
    )


def vector_health(vectors: DataFrame) -> DataFrame:
    """(total, degenerate, live, collapsed): collapsed if two or more live vectors are all parallel to the first."""
    v = vectors.select("id", S.as_double(F.col("vector")).alias("v"))
    flagged = v.withColumn("bad", S.degenerate(F.col("v")))
    first = flagged.where("not bad").agg(F.min_by("v", "id").alias("first"))
    every = flagged.crossJoin(F.broadcast(first))  # one row
    parallel = S.cosine(F.col("v"), F.col("first")) >= 1 - 1e-6
    out = every.agg(F.count("*").alias("total"), F.sum(F.col("bad").cast("int")).alias("degenerate"), F.sum((~F.col("bad")).cast("int")).alias("live"), F.min(F.when(~F.col("bad"), parallel)).alias("par"))
    return out.select("total", F.coalesce("degenerate", F.lit(0)).alias("degenerate"), F.coalesce("live", F.lit(0)).alias("live"), (F.coalesce("par", F.lit(False)) & (F.col("live") >= 2)).alias("collapsed"))


def needed_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts (id, text) to embed: one row a content hash, without what the cache (hash) holds."""
    return texts.select(S.content_hash(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")


def grounded(answers: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """(answer_id, unsupported): figures, versions and hex marks of an answer that no kept source has."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(0x[0-9a-fA-F]+|v?\d+(?:\.\d+)+|\d{2,})"), 0))
    pooled = sources.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("pool"))  # the kept sources of one answer are at most eight
    j = answers.select("answer_id", marks.alias("marks")).join(pooled, "answer_id", "left")
    return j.select("answer_id", F.slice(F.filter("marks", lambda m: ~F.coalesce(F.col("pool"), F.lit("")).contains(m)), 1, most).alias("unsupported"))

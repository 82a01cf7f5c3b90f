"""Queries of dense, sparse and hybrid retrieval.

Search queries take as their query side every row whose id is divisible by 100,
against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.operators import cells
from lodestrata.operators import embedding as E
from lodestrata.operators import retrieval as R
from lodestrata.operators import text as T
from lodestrata.plans.lookups import SYMBOLS
from lodestrata.session import settle, table


def _points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("content"))


def _asked(points):
    return points.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def _knn(s, d, k=10):
    p = _points(s, d)
    return R.knn_exact(p, _asked(p), k)


def knn_exact(s, d):
    return _knn(s, d).select("query_id", "id", F.round("distance", 6).alias("distance"))


def knn_scores(s, d):
    return _knn(s, d).select("query_id", "id", F.round(S.similarity_score(1 - F.col("distance")), 5).alias("score"), "rank")


def knn_maxpool(s, d):
    p = _points(s, d)
    return R.knn_exact(p, _asked(p), 5, pool=True).select("query_id", F.col("content").cast("int").alias("label"), "id", F.round("distance", 6).alias("distance"))


def matryoshka_rescore(s, d):
    """Candidates by the first 16 entries, rescored with all 64."""
    p = _points(s, d)
    short = p.select("id", S.truncate_vector(S.as_double(F.col("vector")), 16).alias("vector"))
    first = R.knn_exact(short, _asked(short), 30).select("query_id", "id", (1 - F.col("distance") / 2).alias("score"))
    return R.rescore(first, p, _asked(p), 20).select("query_id", "id", F.round("score", 5).alias("score"))


def _of_index(s, d):
    """The vectors that have the length of the index's configuration."""
    config = table(s, d, "hnsw_config").select("dimension").limit(1)  # one row
    return table(s, d, "vectors").join(F.broadcast(config), F.size("vector") == F.col("dimension")).drop("dimension")


def vector_health(s, d):
    v = _of_index(s, d).select(F.concat_ws("::", "resolution", "content_id").alias("id"), "vector").dropDuplicates(["id"])
    return R.vector_health(v)


def _documents(s, d):
    return table(s, d, "symbols").dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "name", F.col("doc_comment").alias("doc"), F.col("signature").alias("sig"), F.lit("").alias("body"))


def _queries(s, d):
    ids = table(s, d, "id_map").where("not deleted and int_id % 100 = 0 and vector_id like 'symbol-%'").select(F.regexp_replace("vector_id", "^[a-z-]+::", "").alias("id")).distinct()
    y = table(s, d, "symbols").dropDuplicates(["id"])
    return y.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("name").alias("query"))


def term_df(s, d):
    return R.document_frequencies(R.postings(_documents(s, d)))


def postings(s, d):
    return R.postings(_documents(s, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _sparse(s, d, k=20):
    index = settle(R.postings(_documents(s, d)))  # read three times: size, frequencies, search
    return R.sparse_search(index, R.query_terms(_queries(s, d), index), k)


def sparse_search(s, d):
    return _sparse(s, d).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _vectors(s, d):
    m = table(s, d, "id_map").where("not deleted").select("vector_id")
    v = _of_index(s, d).where("resolution in ('symbol-stub', 'symbol-full')").select(F.concat_ws("::", "resolution", "content_id").alias("vector_id"), "content_id", "vector").dropDuplicates(["vector_id"])
    good = v.join(m, "vector_id", "left_semi").where(~S.degenerate(S.as_double(F.col("vector"))))
    return good.select(F.col("vector_id").alias("id"), F.col("content_id").alias("content"), "vector")


def _hybrid(s, d, k=10):
    p = _vectors(s, d)
    asked = p.join(_queries(s, d), p["content"] == F.col("query_id"), "inner").groupBy("query_id").agg(F.min_by("vector", "id").alias("vector"))
    dense = R.knn_exact(p, asked, 30, pool=True).select("query_id", F.col("content").alias("id"), "rank")
    return R.fuse(dense, _sparse(s, d, 30).select("query_id", F.col("doc_id").alias("id"), "rank"), 0.5, k)


def hybrid_survey(s, d):
    """The flagship: dense and sparse lists of symbols, fused by reciprocal rank."""
    return _hybrid(s, d).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _rerank_scores(results, s, d):
    """Stand-ins for a cross-encoder's scores: the length of the name over that of the query; none for constants."""
    y = table(s, d, "symbols").dropDuplicates(["id"]).where("lower(trim(kind)) <> 'constant'").select("id", F.length("name").alias("n"))
    q = _queries(s, d).select("query_id", F.length("query").alias("m"))
    return results.select("query_id", "id").join(y, "id").join(q, "query_id").select("query_id", "id", (F.col("n") / F.col("m")).alias("rerank"))


def reranked(s, d):
    r = _sparse(s, d, 30).select("query_id", F.col("doc_id").alias("id"), "score")
    return R.rerank(r, _rerank_scores(r, s, d), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def survey_chain(s, d):
    """The whole chain: both lists fused beyond what is asked for, texts resolved, placeholders dropped, reranked, cut."""
    p = settle(_vectors(s, d))
    asked = p.join(_queries(s, d), p["content"] == F.col("query_id"), "inner").groupBy("query_id").agg(F.min_by("vector", "id").alias("vector"))
    dense = R.knn_exact(p, asked, 30, pool=True).select("query_id", F.col("content").alias("id"), "rank")
    sparse = _sparse(s, d, 30).select("query_id", F.col("doc_id").alias("id"), "rank")
    texts = table(s, d, "symbols").dropDuplicates(["id"]).select("id", F.when(F.col("doc_comment").isNull(), F.concat(F.lit("[symbol not found: "), F.col("id"), F.lit("]"))).otherwise(F.concat_ws("\n", "signature", "doc_comment")).alias("text"))
    found = settle(R.fuse(dense, sparse, 0.5, 30))
    out = R.survey(dense, sparse, texts, _rerank_scores(found, s, d), 10)
    return out.select("query_id", "id", F.round("score", 5).alias("score"), "rank", F.length("text").alias("chars"))


def follow_ups(s, d):
    """What to do with the first result of each search, scores being shares of the query's best."""
    r = _sparse(s, d, 2).withColumn("share", F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).where("rank = 2")
    act = S.next_action(F.col("share"), F.lit("symbol-stub"), F.col("doc_id"))
    return r.select("query_id", act.alias("a")).select("query_id", "a.action", "a.id")


def merged_sources(s, d):
    """Sparse and dense results as lists of their resolutions, fused with the authority of each."""
    dense = R.knn_exact(_vectors(s, d), _asked_vectors(s, d), 10, pool=True).select("query_id", F.col("content").alias("id"), "rank", F.lit("symbol-full").alias("resolution"))
    sparse = _sparse(s, d, 10).select("query_id", F.col("doc_id").alias("id"), "rank", F.lit("summary").alias("resolution"))
    return R.merge_ranked(dense.unionByName(sparse)).withColumn("score", F.round("score", 7))


def _asked_vectors(s, d):
    p = _vectors(s, d)
    return p.join(_queries(s, d), p["content"] == F.col("query_id"), "inner").groupBy("query_id").agg(F.min_by("vector", "id").alias("vector"))


def knn_cells(s, d):
    """Approximate search in stored cells, over-fetched for what was deleted since: every id that ends in 7."""
    p = _points(s, d)
    centres = cells.fit_cells(p, 32)
    return cells.search_cells(cells.index_cells(p, centres), centres, _asked(p), 10, 22, p.where("id % 10 = 7"))


def embedded_claims(s, d):
    """The three claims of a section that are most like its heading, by the default embedder."""
    sec = table(s, d, "sections").where("text is not null").dropDuplicates(["id"])
    asked = sec.select(F.col("id").alias("query_id"), F.col("id").alias("section_id"), F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ").alias("query"))
    return E.claims_by_similarity(settle(T.claims(sec)), asked, 3).withColumn("similarity", F.round("similarity", 5))


def survey_excluding(s, d):
    """The same without what was delivered: the symbols that the query's symbol refers to."""
    refs = table(s, d, "symbol_refs").select(F.col("from_symbol_id").alias("query_id"), F.col("to_symbol_id").alias("id")).distinct()
    kept, _ = R.excluding(_sparse(s, d, 30).select("query_id", F.col("doc_id").alias("id"), "score"), refs, 10)
    return kept.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def cross_corpus(s, d):
    """Sparse results of all repositories merged, one of them boosted."""
    r = _sparse(s, d, 30).select("query_id", F.col("doc_id").alias("id"), F.regexp_extract("doc_id", "^sym-([^/]*)/", 1).alias("corpus_id"), "score")
    return R.merge_corpora(r, {"birch-notes": 1.5, "amber-engine": float("nan"), "delta-runner": 20.0}, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def ir_metrics(s, d):
    """Exact search graded by equal labels; the grade is 1 to 3."""
    p = _points(s, d)
    q = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), "content")
    relevant = q.join(p.select("id", "content"), "content").select("query_id", "id", (1 + F.col("id") % 3).alias("grade"))
    return R.metrics(_knn(s, d).select("query_id", "id", "rank"), relevant, 5)


def mean_metrics(s, d):
    m = ir_metrics(s, d)
    return m.agg(*[F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "rr", "ndcg")])


def embedding_needs(s, d):
    """Section texts to embed: one a hash, without those of sections that have a vector."""
    t = table(s, d, "sections").where("text is not null").dropDuplicates(["id"]).select("id", "text")
    cached = t.join(table(s, d, "vectors").where("resolution = 'section'").select(F.col("content_id").alias("id")), "id", "left_semi").select(S.content_hash(F.col("text")).alias("hash")).distinct()
    return R.needed_embeddings(t, cached).select("hash")


def graph_expansion(s, d):
    r = _sparse(s, d, 5).select("query_id", F.col("doc_id").alias("id"), "score")
    e = table(s, d, "symbol_refs").where("ref_kind = 'calls'").select(F.col("from_symbol_id").alias("source"), F.col("to_symbol_id").alias("target")).distinct()
    return R.expand(r, e, 5).select("query_id", "id", F.round("score", 4).alias("score"))


QUERIES = {f.__name__: f for f in (reranked, survey_chain, follow_ups, merged_sources, knn_cells, embedded_claims, knn_exact, knn_scores, knn_maxpool, matryoshka_rescore, vector_health, term_df, postings, sparse_search, hybrid_survey, survey_excluding, cross_corpus, ir_metrics, mean_metrics, embedding_needs, graph_expansion)}

_KNN = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS query_id, v AS qv, label AS ql FROM e WHERE id % 100 = 0),
 dd AS (SELECT query_id, ql, id, label, round(1 - list_cosine_similarity(qv, v), 9) AS distance FROM q, e),
 nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dd QUALIFY rank <= 10)"""
_ANALYZE = r"""list_filter(flatten(list_transform(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''),
 lambda w: list_filter([lower(w)] || list_transform(list_filter(string_split(regexp_replace(w, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '_'), lambda p: p <> ''), lambda p: lower(p)), lambda x, i: i = 1
   OR x <> ([lower(w)] || list_transform(list_filter(string_split(regexp_replace(w, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '_'), lambda p: p <> ''), lambda p: lower(p)))[i - 1]))), lambda t: strlen(t) > 1)"""
_POST = f"""f AS (SELECT id AS doc_id, unnest([{{'w': 3.0, 't': coalesce(name, '')}}, {{'w': 2.0, 't': coalesce(doc_comment, '')}}, {{'w': 1.5, 't': coalesce(signature, '')}}]) AS x FROM {SYMBOLS}),
 tm AS (SELECT doc_id, x.w AS w, unnest({_ANALYZE.format('x.t')}) AS term FROM f),
 tf AS (SELECT doc_id, w, term, count(*) AS n FROM tm GROUP BY ALL),
 post AS (SELECT doc_id, term, sum((w * n / (1 + n))::DOUBLE) AS weight FROM tf GROUP BY ALL)"""
_ASKED = f"""asked AS (SELECT id AS query_id, name AS query FROM {SYMBOLS} WHERE id IN (SELECT regexp_replace(vector_id, '^[a-z-]+::', '') FROM id_map WHERE NOT deleted AND int_id % 100 = 0 AND vector_id LIKE 'symbol-%')),
 qt AS (SELECT query_id, unnest(list_distinct({_ANALYZE.format('query')})) AS term FROM asked),
 nd AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM post), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY 1),
 qw AS (SELECT query_id, qt.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS qw FROM qt CROSS JOIN nd LEFT JOIN df ON df.term = qt.term),
 hit AS (SELECT query_id, doc_id, round(sum(weight * qw), 9) AS score FROM post JOIN qw USING (term) GROUP BY 1, 2),
 sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 30)"""
_DENSE = """vv AS (SELECT DISTINCT resolution || '::' || content_id AS vid, content_id, vector::DOUBLE[] AS v FROM vectors WHERE resolution IN ('symbol-stub', 'symbol-full') AND len(vector) = (SELECT dimension FROM hnsw_config)
   AND resolution || '::' || content_id IN (SELECT vector_id FROM id_map WHERE NOT deleted)),
 ok AS (SELECT * FROM vv WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) >= 1e-12),
 dq AS (SELECT query_id, arg_min(v, vid) AS qv FROM ok JOIN asked ON asked.query_id = ok.content_id GROUP BY 1),
 d1 AS (SELECT query_id, content_id, vid, round(1 - list_cosine_similarity(qv, v), 9) AS distance FROM dq, ok),
 d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_id ORDER BY distance, vid) AS r FROM d1 QUALIFY r = 1),
 dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, content_id, vid) AS rank FROM d2 QUALIFY rank <= 30)"""
_METRICS = f"""WITH {_KNN}, rel AS (SELECT q.query_id, e.id, 1 + e.id % 3 AS grade FROM q JOIN e ON e.label = q.ql),
 fo AS (SELECT n.query_id, sum(CASE WHEN rank <= 5 AND grade IS NOT NULL THEN 1 ELSE 0 END) AS hits, least(5, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)) AS shown, min(CASE WHEN grade IS NOT NULL THEN rank END) AS first_,
   sum(CASE WHEN rank <= 5 AND grade IS NOT NULL THEN (pow(2.0, grade) - 1) / log2(rank + 1) ELSE 0.0 END) AS dcg FROM nn n LEFT JOIN rel ON rel.query_id = n.query_id AND rel.id = n.id GROUP BY 1),
 io AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS i FROM rel),
 il AS (SELECT query_id, count(*) AS expected, sum(CASE WHEN i <= 5 THEN (pow(2.0, grade) - 1) / log2(i + 1) ELSE 0.0 END) AS idcg FROM io GROUP BY 1),
 m AS (SELECT il.query_id, round(coalesce(hits / shown, 0.0), 6) AS precision, round(coalesce(hits / expected, 0.0), 6) AS recall, round(coalesce(1 / first_, 0.0), 6) AS rr, round(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0.0), 6) AS ndcg FROM il LEFT JOIN fo USING (query_id))"""

ORACLE = {
    "knn_exact": f"WITH {_KNN} SELECT query_id, id, round(distance, 6) AS distance FROM nn",
    "knn_scores": f"WITH {_KNN} SELECT query_id, id, round(1 - (1 - (1 - distance)) / 2, 5) AS score, rank::INT AS rank FROM nn",
    "knn_maxpool": f"""WITH {_KNN}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, id) AS r FROM dd QUALIFY r = 1)
        SELECT query_id, label, id, round(distance, 6) AS distance FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, label::VARCHAR, id) <= 5""",
    "matryoshka_rescore": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, embedding[1:16]::DOUBLE[] AS sv FROM embeddings), q AS (SELECT id AS query_id, v AS qv, sv AS sq FROM e WHERE id % 100 = 0),
        c AS (SELECT query_id, qv, id, v, 1 - round(1 - list_cosine_similarity(sq, sv), 9) / 2 AS score FROM q, e), c30 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
        s AS (SELECT *, round(list_cosine_similarity(qv, v), 9) AS cos FROM c30),
        w AS (SELECT *, min(score) OVER p AS l1, max(score) OVER p AS h1, min(cos) OVER p AS l2, max(cos) OVER p AS h2 FROM s WINDOW p AS (PARTITION BY query_id))
        SELECT query_id, id, round(round(0.7 * CASE WHEN h2 - l2 < 1.1920929e-07 THEN 0.5 ELSE (cos - l2) / (h2 - l2) END + 0.3 * CASE WHEN h1 - l1 < 1.1920929e-07 THEN 0.5 ELSE (score - l1) / (h1 - l1) END, 9), 5) AS score FROM w""",
    "vector_health": """WITH v AS (SELECT DISTINCT resolution || '::' || content_id AS id, vector::DOUBLE[] AS v FROM vectors WHERE len(vector) = (SELECT dimension FROM hnsw_config)),
        f AS (SELECT id, v, len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR list_sum(list_transform(v, lambda x: x * x)) < 1e-12 AS bad FROM v),
        o AS (SELECT arg_min(v, id) AS first_ FROM f WHERE NOT bad)
        SELECT count(*) AS total, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS degenerate, sum(CASE WHEN bad THEN 0 ELSE 1 END)::BIGINT AS live,
        coalesce(bool_and(CASE WHEN NOT bad THEN list_cosine_similarity(v, first_) >= 1 - 1e-6 END), false) AND sum(CASE WHEN bad THEN 0 ELSE 1 END) >= 2 AS collapsed FROM f, o""",
    "term_df": f"WITH {_POST} SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY 1",
    "postings": f"WITH {_POST} SELECT doc_id, term, round(weight, 6) AS weight FROM post",
    "sparse_search": f"WITH {_POST}, {_ASKED} SELECT query_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM sp WHERE rank <= 20",
    "hybrid_survey": f"""WITH {_POST}, {_ASKED}, {_DENSE}, u AS (SELECT query_id, content_id AS id, 0.5 / (60 + rank - 1 + 1) AS s FROM dn UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank - 1 + 1) FROM sp),
        t AS (SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t QUALIFY rank <= 10)
        SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM k""",
    "survey_excluding": f"""WITH {_POST}, {_ASKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sp
        WHERE NOT EXISTS (SELECT 1 FROM symbol_refs x WHERE x.from_symbol_id = sp.query_id AND x.to_symbol_id = sp.doc_id))
        SELECT query_id, doc_id AS id, round(score, 5) AS score, r::INT AS rank FROM k WHERE r <= 10""",
    "cross_corpus": f"""WITH {_POST}, {_ASKED}, b AS (SELECT query_id, doc_id AS id, round(score * CASE regexp_extract(doc_id, '^sym-([^/]*)/', 1) WHEN 'birch-notes' THEN 1.5 WHEN 'delta-runner' THEN 10.0 ELSE 1.0 END::DOUBLE, 9) AS score FROM sp),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM b) SELECT query_id, id, round(score, 4) AS score, r::INT AS rank FROM k WHERE r <= 10""",
    "ir_metrics": _METRICS + " SELECT * FROM m",
    "mean_metrics": _METRICS + " SELECT round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(rr), 5) AS rr, round(avg(ndcg), 5) AS ndcg FROM m",
    "embedding_needs": """SELECT DISTINCT sha256(text) AS hash FROM sections WHERE text IS NOT NULL AND sha256(text) NOT IN
        (SELECT sha256(text) FROM sections WHERE text IS NOT NULL AND id IN (SELECT content_id FROM vectors WHERE resolution = 'section'))""",
    "graph_expansion": f"""WITH {_POST}, {_ASKED}, r AS (SELECT query_id, doc_id AS id, score FROM sp WHERE rank <= 5),
        n AS (SELECT query_id, to_symbol_id AS id, max(score * 0.5) AS score FROM r JOIN (SELECT DISTINCT from_symbol_id, to_symbol_id FROM symbol_refs WHERE ref_kind = 'calls') x ON x.from_symbol_id = r.id
          WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.query_id = r.query_id AND y.id = x.to_symbol_id) GROUP BY 1, 2),
        c AS (SELECT query_id, id, score FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)
        SELECT query_id, id, round(score, 4) AS score FROM r UNION ALL SELECT query_id, id, round(score, 4) FROM c""",
}
_SCORES = f"rs AS (SELECT x.query_id, x.id, length(y.name) / length(q.query)::DOUBLE AS rerank FROM cand x JOIN {SYMBOLS} y ON y.id = x.id AND lower(trim(y.kind)) <> 'constant' JOIN asked q ON q.query_id = x.query_id)"
_BLEND = """w AS (SELECT c.query_id, c.id, score, rerank, min(score) OVER p AS l1, max(score) OVER p AS h1, min(rerank) OVER p AS l2, max(rerank) OVER p AS h2 FROM cand c LEFT JOIN rs ON rs.query_id = c.query_id AND rs.id = c.id WINDOW p AS (PARTITION BY c.query_id)),
 n AS (SELECT query_id, id, CASE WHEN h1 - l1 < 1.1920929e-07 THEN 0.5 ELSE (score - l1) / (h1 - l1) END AS a, CASE WHEN rerank IS NULL THEN NULL WHEN h2 - l2 < 1.1920929e-07 THEN 0.5 ELSE (rerank - l2) / (h2 - l2) END AS b FROM w),
 z AS (SELECT query_id, id, round(CASE WHEN b IS NULL THEN a ELSE 0.8 * b + 0.2 * a END, 9) AS score FROM n), fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z QUALIFY rank <= 10)"""
ORACLE |= {
    "reranked": f"WITH {_POST}, {_ASKED}, cand AS (SELECT query_id, doc_id AS id, score FROM sp), {_SCORES}, {_BLEND} SELECT query_id, id, round(score, 5) AS score, rank::INT AS rank FROM fin",
    "survey_chain": f"""WITH {_POST}, {_ASKED}, {_DENSE}, u AS (SELECT query_id, content_id AS id, 0.5 / (60 + rank - 1 + 1) AS s FROM dn UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank - 1 + 1) FROM sp),
        t AS (SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY 1, 2), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30),
        cand AS (SELECT query_id, k.id, score, concat_ws(chr(10), signature, doc_comment) AS text FROM k JOIN {SYMBOLS} y ON y.id = k.id WHERE doc_comment IS NOT NULL), {_SCORES}, {_BLEND}
        SELECT fin.query_id, fin.id, round(fin.score, 5) AS score, rank::INT AS rank, length(text)::INT AS chars FROM fin JOIN cand ON cand.query_id = fin.query_id AND cand.id = fin.id""",
    "follow_ups": f"WITH {_POST}, {_ASKED}, s2 AS (SELECT query_id, doc_id, rank, score / max(score) OVER (PARTITION BY query_id) AS share FROM sp WHERE rank <= 2) SELECT query_id, CASE WHEN share >= 0.5 THEN 'definition' END AS action, CASE WHEN share >= 0.5 THEN doc_id END AS id FROM s2 WHERE rank = 2",
    "merged_sources": f"""WITH {_POST}, {_ASKED}, {_DENSE}, u AS (SELECT query_id, content_id AS id, 'symbol-full' AS resolution, 1.3 / (60 + rank)::DOUBLE AS s FROM dn WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'summary', 0.85 / (60 + rank)::DOUBLE FROM sp WHERE rank <= 10)
        SELECT query_id, id, round(s, 7) AS score FROM u""",
}

"""Embedders by name, embedding of text columns, and routing of code and prose to their own embedders.

The default embedder needs no model: entry ``i % dimension`` sums the bytes of the
text at places ``i``, each divided by 255, and the vector is normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators.text import looks_like_code

#: Texts that go to an embedder in one call.
BATCH = 64


class Embedder(Protocol):
    """Dense vectors of texts; called with at most ``BATCH`` texts."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """Scores of texts for a query."""

    def score(self, query: str, texts: list[str]) -> np.ndarray: ...


class ByteEmbedder:
    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            row += np.bincount(np.arange(len(data)) % self.dimension, weights=data / 255.0, minlength=self.dimension)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


class OverlapReranker:
    """The share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> np.ndarray:
        words = set(query.lower().split())
        return np.array([len(words & set(t.lower().split())) / max(1, len(words)) for t in texts])


_EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"bytes": ByteEmbedder}
_RERANKERS: dict[str, Callable[[], Reranker]] = {"overlap": OverlapReranker}


def register_embedder(name: str, make: Callable[[int], Embedder]) -> None:
    _EMBEDDERS[name] = make


def create_embedder(name: str = "bytes", dimension: int = 64) -> Embedder:
    if name not in _EMBEDDERS:
        raise ValueError(f"no embedder {name}; there are {sorted(_EMBEDDERS)}")
    return _EMBEDDERS[name](dimension)


def create_reranker(name: str = "overlap") -> Reranker:
    if name not in _RERANKERS:
        raise ValueError(f"no reranker {name}; there are {sorted(_RERANKERS)}")
    return _RERANKERS[name]()


def batched(texts: list[str], size: int = BATCH) -> Iterator[list[str]]:
    for at in range(0, len(texts), size):
        yield texts[at : at + size]


def embed(rows: DataFrame, text_col: str = "text", embedder: Embedder | None = None) -> DataFrame:
    """``rows`` with a column ``vector``; null texts have none.  Arrow batches are cut to the embedder's batch."""
    own = embedder or create_embedder()

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        found = [v for part in batched(texts.fillna("").tolist()) for v in own.embed(part)]
        return pd.Series([None if t is None else v for t, v in zip(texts, found)], dtype=object)

    return rows.withColumn("vector", run(F.col(text_col)))


def embed_by_kind(rows: DataFrame, code: Embedder, prose: Embedder, text_col: str = "text") -> DataFrame:
    """``rows`` with a column ``vector`` by the code or the prose embedder, by what the text looks like."""
    kinds = rows.withColumn("_code", F.coalesce(looks_like_code(F.col(text_col)), F.lit(False)))
    return embed(kinds.where("_code"), text_col, code).unionByName(embed(kinds.where("not _code"), text_col, prose)).drop("_code")


def union_back(texts: DataFrame, cache: DataFrame, made: DataFrame) -> DataFrame:
    """(id, vector): texts (id, hash) with the vector of their hash, from the cache or from what was made anew (hash, vector)."""
    both = cache.select("hash", "vector").unionByName(made.select("hash", "vector").join(cache.select("hash"), "hash", "left_anti"))
    return texts.join(both, "hash").select("id", "vector")


def rerank_scores(results: DataFrame, queries: DataFrame, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, id, rerank) of results (query_id, id, text) for queries (query_id, query)."""
    own = reranker or create_reranker()

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=text.index)
        for q, places in query.groupby(query).groups.items():
            out.loc[places] = own.score(q, text.loc[places].fillna("").tolist())
        return out

    return results.join(queries.select("query_id", "query"), "query_id").select("query_id", "id", run("query", "text").alias("rerank"))


def claims_by_similarity(claims: DataFrame, queries: DataFrame, k: int, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, claim_id, similarity, rank): claims (section_id, claim_id, text) of the sections asked for (query_id, section_id, query), by cosine to the query."""
    from lodestrata.functions import scalar as S

    asked = embed(queries.select("query_id", "query").distinct(), "query", embedder).withColumnRenamed("vector", "q")
    own = embed(claims.join(queries.select("section_id").distinct(), "section_id", "left_semi"), "text", embedder)
    scored = own.join(queries.select("query_id", "section_id"), "section_id").join(asked.select("query_id", "q"), "query_id").withColumn("similarity", F.round(S.cosine(F.col("vector"), F.col("q")), 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "claim_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "claim_id", "similarity", "rank")

"""Approximate nearest neighbours by cells: an index that is stored by cell, so a search reads only the cells it probes.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors); every vector is
indexed.  A search probes the cells nearest to each query and compares exactly
within them; ids that were deleted since are left out after fetching more than
asked for, and the queries that fall short are asked again over all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.session import spread

#: Vectors on which centroids are fitted, at most.
SAMPLE = 20_000
#: Queries whose vectors are sent with the tasks at once.
QUERY_BLOCK = 4096


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_cells(points: DataFrame, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of about so many cells, by spherical k-means on at most ``SAMPLE`` vectors, those of the least hashed ids."""
    rows = points.where(~S.degenerate(S.as_double(F.col("vector")))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit([r[0] for r in rows])
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def index_cells(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, id, vector) of every point that isn't degenerate; write it partitioned by cell to let searches skip files."""
    held = points.sparkSession.sparkContext.broadcast(centres)  # at most a few thousand vectors

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(_unit(vectors.tolist()) @ held.value.T, axis=1), dtype="int32") if len(vectors) else pd.Series([], dtype="int32")

    use = points.where(~S.degenerate(S.as_double(F.col("vector"))) & (F.size("vector") == centres.shape[1]))
    return spread(use.select("id", "vector")).select(cell("vector").alias("cell"), "id", "vector")


def search_cells(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, deleted: DataFrame | None = None, over_fetch: int = 2) -> DataFrame:
    """(query_id, id, distance, rank): about the k nearest points of each query (query_id, vector), ties by id; ``deleted``: id."""
    near = _probe(index, centres, queries, k * over_fetch if deleted is not None else k, probes)
    if deleted is not None:
        near = near.join(deleted.select("id").distinct(), "id", "left_anti")
        short = queries.join(near.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "vector")
        again = _probe(index.join(deleted.select("id").distinct(), "id", "left_anti"), centres, short, k, len(centres))
        near = near.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "distance", "rank")


def _probe(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    key, name = queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    kinds = f"query_id {key}, id {name}, distance double"
    out, block = None, []

    def search(rows: list) -> DataFrame:
        ids, q = np.array([r[0] for r in rows]), _unit([r[1] for r in rows])
        order = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
        asking = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}
        held = index.sparkSession.sparkContext.broadcast((ids, q, asking))  # a block of queries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own_ids, own_q, by_cell = held.value
            best: dict[int, pd.DataFrame] = {}
            for batch in batches:
                for cell, part in batch.groupby("cell", sort=False):
                    rows_of = by_cell.get(int(cell))
                    if rows_of is None:
                        continue
                    names = part["id"].to_numpy()
                    d = np.round(1 - own_q[rows_of] @ _unit(part["vector"].tolist()).T, 9)
                    keep = min(k, d.shape[1])
                    limit = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    r, c = np.nonzero(d <= limit[:, None])
                    found = pd.DataFrame({"q": rows_of[r], "id": names[c], "distance": d[r, c]})
                    for qn, rows_ in found.groupby("q", sort=False):
                        both = rows_ if qn not in best else pd.concat([best[qn], rows_])
                        best[qn] = both.sort_values(["distance", "id"]).head(k)
            every = pd.concat(best.values()) if best else pd.DataFrame({"q": [], "id": [], "distance": []})
            yield pd.DataFrame({"query_id": own_ids[every["q"].astype(int)], "id": every["id"].to_numpy(), "distance": every["distance"].to_numpy()})

        return index.where(F.col("cell").isin([int(c) for c in asking])).mapInPandas(run, kinds)

    for row in queries.select("query_id", "vector").where(F.size("vector") == (centres.shape[1] if centres.size else 0)).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            out = search(block) if out is None else out.unionAll(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionAll(search(block))
    return out if out is not None else index.sparkSession.createDataFrame([], kinds)

"""The k most similar vectors of every vector (problem 3).

Multiprobe p-stable hashing: each table cuts ``functions`` Gaussian projections
of the unit vectors into cells of ``width``; a vector is stored in its own cell
and looks into the ``probes`` perturbed cells most likely to hold its
neighbours, in the order of estimated success.  Candidates carry a sign sketch
of 128 bits, so all but the promising ones are dropped inside the join; the
rest are merged over the tables and reranked by exact cosine.

Cells that hold more than ``cell_cap`` vectors are taken out of the join; all
that look into one are compared exactly, in blocks by matrix products, with all
that are in one, so no cell is ever one task and none is dropped.  Exact copies
are one class from the start: only its least ids are ever compared and listed.

Defined results: null, empty, wrongly long, zero or non-finite vectors aren't
live; repeated rows of a vector count once; of different vectors under one id
the least array counts; ties, at twelve digits of the cosine, go to the lesser id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import settle, spread

TABLES, FUNCTIONS, WIDTH, PROBES = 16, 16, 2.0, 10
CELL_CAP = 2000
#: Entries of the vectors of one side that a task compares: 131,072 vectors of 64.
BLOCK_ENTRIES = 1 << 23
#: What a product in single precision of unit vectors is off by, at most.
MARGIN = 2e-5
#: Cosines that are equal when rounded so are ties: one direction at different norms differs by less.
TIE_DIGITS = 12
SEED = 20


def live_vectors(vectors: DataFrame, id_map: DataFrame, dimension: int) -> DataFrame:
    """(id, vector) of the live vectors, one row each."""
    v = vectors.select(F.concat_ws("::", "resolution", "content_id").alias("vector_id"), "vector").where(
        (F.size("vector") == dimension)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    m = id_map.where(~F.coalesce("deleted", F.lit(False))).select("vector_id", F.col("int_id").alias("id")).where("id is not null")
    return v.join(m, "vector_id").groupBy("id").agg(F.min("vector").alias("vector"))


def probing_sequence(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The perturbation sets in order of expected score; members are ranks among the 2M distances to cell borders, nearest first."""
    m, e = functions, np.zeros(2 * functions)
    for j in range(1, m + 1):
        e[j - 1] = j * (j + 1) / (4 * (m + 1) * (m + 2))
        e[2 * m - j] = 1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2))
    out: list[tuple[int, ...]] = []
    heap = [(e[0], (0,))]
    while heap and len(out) < probes:
        score, members = heapq.heappop(heap)
        if all(2 * m - 1 - k not in members for k in members):
            out.append(members)
        last = members[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - e[last] + e[last + 1], (*members[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*members, last + 1)))
    return out


class Hashing:
    """The hash tables; every task builds the same ones from the seed."""

    def __init__(self, dimension: int, tables: int, functions: int, width: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width = tables, functions, width
        self.a = rng.normal(size=(dimension, tables * functions))
        self.b = rng.random(tables * functions) * width
        self.r = rng.integers(1, 2**62, size=tables * functions, dtype=np.int64) | 1
        self.table = rng.integers(1, 2**62, size=tables, dtype=np.int64)
        self.signs = rng.normal(size=(dimension, 128))
        self.sequence = probing_sequence(functions, probes)

    def keys(self, unit: np.ndarray, probing: bool) -> np.ndarray:
        """One row a vector: its own cell in each table, or, when probing, its own and the perturbed ones."""
        m = self.functions
        f = (unit @ self.a + self.b) / self.width
        cell = np.floor(f).astype(np.int64)
        x = (f - cell).reshape(len(unit), self.tables, m)
        own = (cell * self.r).reshape(len(unit), self.tables, m).sum(axis=2) + self.table
        if not probing:
            return own
        out = [own]
        border = np.concatenate((x, 1 - x), axis=2)
        order = np.argsort(border, axis=2)[:, :, : m + 8]
        step = np.where(order < m, -1, 1) * self.r.reshape(self.tables, m)[np.arange(self.tables)[None, :, None], order % m]
        for members in self.sequence:
            out.append(own + step[:, :, list(members)].sum(axis=2))
        return np.concatenate(out, axis=1)

    def sketch(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.packbits((unit @ self.signs > 0).astype(np.uint8), axis=1)
        words = np.ascontiguousarray(bits).view(np.int64)
        return words[:, 0], words[:, 1]


def _unit(batch: pd.Series) -> np.ndarray:
    v = np.stack(batch.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cells(points: DataFrame, make: dict, probing: bool) -> DataFrame:
    """(key, id, s1, s2), one row a cell that a point is in or looks into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = Hashing(**make)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                unit = _unit(part["vector"])
                keys = hashing.keys(unit, probing)
                s1, s2 = hashing.sketch(unit)
                n = keys.shape[1]
                yield pd.DataFrame({"key": keys.reshape(-1), "id": np.repeat(part["id"].to_numpy(), n), "s1": np.repeat(s1, n), "s2": np.repeat(s2, n)})

    return points.mapInPandas(run, "key bigint, id bigint, s1 bigint, s2 bigint")


def _most_bits(min_cosine: float) -> int:
    """Differing sketch bits that a pair of the least cosine stays under but for four deviations."""
    p = float(np.arccos(min_cosine) / np.pi)
    return int(128 * p + 4 * np.sqrt(128 * p * (1 - p))) + 1


def _pairs(own: DataFrame, looks: DataFrame, bits: int) -> DataFrame:
    a, b = own.alias("a"), looks.alias("b")
    near = F.expr(f"a.id <> b.id and bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {bits}")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y"))


def _nearest(asking: np.ndarray, asked: np.ndarray, keep: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asking, row of asked, cosine) of each asking unit vector's best; ties go to the earlier row of asked.

    Products in single precision pass only what may be among the best so far; that is scored in double precision.
    """
    small_q, small_c = asking.astype(np.float32), asked.astype(np.float32)
    out = []
    for at in range(0, len(asking), 1024):
        q32 = small_q[at : at + 1024]
        floor = np.full(len(q32), least - MARGIN, dtype=np.float32)
        q, c, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for ct in range(0, len(asked), 4096):
            s = q32 @ small_c[ct : ct + 4096].T
            if ct == 0 and keep < s.shape[1]:
                floor = np.maximum(floor, np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] - MARGIN)
            i, j = np.divmod(np.flatnonzero(s >= floor[:, None]), s.shape[1])
            exact = [np.einsum("ij,ij->i", asking[at + i[x : x + 100_000]], asked[ct + j[x : x + 100_000]]) for x in range(0, len(i), 100_000)]
            q, c, score = np.concatenate((q, i)), np.concatenate((c, ct + j)), np.concatenate((score, *(np.round(e, TIE_DIGITS) for e in exact)))
            order = np.lexsort((c, -score, q))
            q, c, score = q[order], c[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == keep - 1
            floor[q[last]] = np.maximum(floor[q[last]], score[last] - MARGIN)
            q, c, score = q[place < keep], c[place < keep], score[place < keep]
        good = score >= least
        out.append((at + q[good], c[good], score[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _block_pairs(asking: DataFrame, asked: DataFrame, dimension: int, k: int, min_cosine: float) -> DataFrame:
    """(x, y) of exact comparisons of all points that ask with all that are asked, in blocks by matrix products."""
    cores = asking.sparkSession.sparkContext.defaultParallelism
    block = max(1024, BLOCK_ENTRIES // dimension)
    blocks = lambda n: max(1, min(n, max(-(-n // block), math.isqrt(2 * cores))))
    na, nb = blocks(asking.count()), blocks(asked.count())
    part = "cast(pmod(xxhash64(id), {0}) as int)"
    left = asking.select(F.expr(part.format(na)).alias("i"), F.explode(F.expr(f"sequence(0, {nb - 1})")).alias("j"), F.lit(0).alias("side"), "id", "vector")
    right = asked.select(F.explode(F.expr(f"sequence(0, {na - 1})")).alias("i"), F.expr(part.format(nb)).alias("j"), F.lit(1).alias("side"), "id", "vector")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        unit = _unit(rows["vector"])
        asks, others = ids[side == 0], ids[side == 1]
        q, c, score = _nearest(unit[side == 0], unit[side == 1], k + 1, min_cosine)  # one may be the point itself
        x, y = asks[q], others[c]
        q, x, y, score = q[x != y], x[x != y], y[x != y], score[x != y]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pd.DataFrame({"x": x[first], "y": y[first], "s": score[first]})

    found = left.unionByName(right).repartition(na * nb, "i", "j").groupBy("i", "j").applyInPandas(compare, "x bigint, y bigint, s double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("s"), "y"))).where(F.col("r") <= k)
    return best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def tuning(n: int) -> tuple[int, int]:
    """(functions, tables) for so many points: cells stay as full as they are at a million, and the tables make up for the narrower cut."""
    more = max(0, int(np.ceil(1.4 * np.log(max(n, 1) / 1e6))))
    return FUNCTIONS + more, int(np.ceil(TABLES * 0.82**-more))


def similar_pairs(points: DataFrame, dimension: int, k: int = 5, min_cosine: float = 0.85, tables: int | None = None, functions: int | None = None, width: float = WIDTH, probes: int = PROBES, cell_cap: int = CELL_CAP) -> DataFrame:
    """(x, y, cosine) with x < y and at least the least cosine, of distinct points (id, vector)."""
    by_size = tuning(points.count())
    make = dict(dimension=dimension, functions=functions or by_size[0], tables=tables or by_size[1], width=width, probes=probes, seed=SEED)
    bits = _most_bits(min_cosine)
    own, looks = _cells(points, make, False), _cells(points, make, True)
    hot = settle(own.groupBy("key").count().where(F.col("count") > cell_cap).select("key"))
    n_hot = hot.count()
    if not n_hot:
        found = _pairs(own, looks, bits)
    else:
        side = F.broadcast(hot) if n_hot <= 1_000_000 else hot  # at most tables * points / cell_cap keys
        found = _pairs(own.join(side, "key", "left_anti"), looks.join(side, "key", "left_anti"), bits)
        asked = settle(own.join(side, "key", "left_semi").select("id").distinct().join(points, "id"))
        asking = settle(looks.join(side, "key", "left_semi").select("id").distinct().join(points, "id"))
        found = found.unionAll(_block_pairs(asking, asked, dimension, k, min_cosine))
    return _scored(points, found).where(F.col("cosine") >= min_cosine)


def _scored(points: DataFrame, found: DataFrame) -> DataFrame:
    """(x, y, cosine) of the distinct pairs found."""
    pairs = found.distinct()
    left = points.select(F.col("id").alias("x"), F.col("vector").alias("u"))
    right = points.select(F.col("id").alias("y"), F.col("vector").alias("v"))
    dot = "aggregate(zip_with(u, v, (p, q) -> double(p) * double(q)), 0D, (s, p) -> s + p)"
    norm = "sqrt(aggregate({0}, 0D, (s, p) -> s + double(p) * double(p)))"
    return pairs.join(left, "x").join(right, "y").select("x", "y", F.expr(f"{dot} / ({norm.format('u')} * {norm.format('v')})").alias("cosine"))

def neighbours(points: DataFrame, dimension: int, k: int = 5, min_cosine: float = 0.85, whole: bool = False, **hashing) -> DataFrame:
    """(id, rank, neighbour, cosine): each point's k most similar others of at least the least cosine.

    With ``whole``, points that have fewer such others than k get their k most similar of any cosine: hashing finds the
    near ones, and those whose list stays short are compared with all points in exact blocks.
    """
    points = settle(points)
    # a class of exact copies is represented by its least id; of its members only the k + 1 least are ever listed
    classes = points.groupBy("vector").agg(F.min("id").alias("class"))
    copies = points.join(classes, "vector").select("id", "class", "vector")
    member = settle(copies.select("id", "class"))
    first = member.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("k") <= k + 1).select("class", F.col("id").alias("neighbour"))
    reps = settle(spread(classes.select(F.col("class").alias("id"), "vector")))
    near = similar_pairs(reps, dimension, k, min_cosine, **hashing)
    if whole:
        near = settle(near)
        full = near.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").count().where(F.col("count") >= k)
        short = settle(reps.join(full.select("id"), "id", "left_anti"))
        near = near.unionByName(_scored(reps, _block_pairs(short, reps, dimension, k, -2.0).join(near, ["x", "y"], "left_anti")))
    both = settle(near.select(F.col("x").alias("class"), F.col("y").alias("other"), "cosine").unionAll(near.select(F.col("y").alias("class"), F.col("x").alias("other"), "cosine")))
    tied = F.round("cosine", TIE_DIGITS).desc()
    order = Window.partitionBy("class").orderBy(tied, "other")
    best = both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")
    own = reps.select(F.col("id").alias("class"), F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    listed = best.unionByName(own).join(first.withColumnRenamed("class", "other"), "other").select("class", "neighbour", "cosine")
    by_class = Window.partitionBy("class").orderBy(tied, "neighbour")
    top = listed.withColumn("k", F.row_number().over(by_class)).where(F.col("k") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("k", "neighbour", "cosine"))).alias("list"))  # at most k + 1 entries
    others = F.expr(f"slice(filter(list, e -> e.neighbour <> id), 1, {k})")
    return member.join(top, "class").select("id", F.posexplode(others).alias("r", "e")).select("id", (F.col("r") + 1).alias("rank"), F.col("e.neighbour").alias("neighbour"), F.col("e.cosine").alias("cosine"))


def found_pairs(vectors: DataFrame, id_map: DataFrame, config: DataFrame, k: int = 5, min_cosine: float = 0.85, **hashing) -> DataFrame:
    """(int_a, int_b): pairs of live vectors, one among the k most similar of the other."""
    near = live_neighbours(vectors, id_map, config, k, min_cosine, **hashing)
    return near.select(F.least("id", "neighbour").alias("int_a"), F.greatest("id", "neighbour").alias("int_b")).distinct()


def live_neighbours(vectors: DataFrame, id_map: DataFrame, config: DataFrame, k: int = 5, min_cosine: float = 0.85, whole: bool = False, **hashing) -> DataFrame:
    row = config.select("dimension").where("dimension is not null").limit(1).collect()  # a configuration of one row
    dimension = row[0][0] if row else 0
    return neighbours(live_vectors(vectors, id_map, dimension), max(1, dimension), k, min_cosine, whole, **hashing)

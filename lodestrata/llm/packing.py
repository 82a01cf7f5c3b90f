"""Texts into token containers of fixed capacity (problem 7).

A text is never split unless it alone exceeds the capacity; then its full
pieces are containers of their own and its rest is an item like any other.

Packing works on the histogram of item lengths, which has at most ``capacity``
rows however many texts there are: exact complements (single, pair and triple
sums of lengths still available) close a container without room left, each
combination being consumed as often as its counts allow; what no combination
closes is packed best-fit.  The plan is joined back to the items by length and
rank, and ranks are taken in salted groups, so one frequent length is never
one task.

Defined results: null and empty texts have no tokens and go into no container;
repeated rows are separate items; texts of any length are measured whole.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.session import settle, spread

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
CAPACITY = 4096
#: Items of one length that are ranked in one group.
RANK_GROUP = 200_000
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _pieces(encoder, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text in characters; one piece unless it exceeds the capacity."""
    tokens = encoder.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    out, start, window = [], 0, 8 * capacity
    while start < len(text):
        tokens = encoder.encode_ordinary(text[start : start + window])
        if len(tokens) <= capacity:
            if start + window < len(text):
                window *= 2
                continue
            out.append((start, len(text), len(tokens)))
            break
        take = capacity
        while True:  # the cut mustn't fall inside a character, and the piece must hold on its own
            head = encoder.decode_bytes(tokens[:take]).decode("utf-8", errors="ignore")
            n = len(encoder.encode_ordinary(head))
            if head and n <= capacity:
                break
            take -= 1
        out.append((start, start + len(head), n))
        start += len(head)
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Items (``id_col``, piece, n_pieces, start_char, end_char, n_tokens) of the texts."""
    with open(os.path.join(tokenizer_dir, tokenizer), "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size, under 2 MB
    source = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("length(_text) > 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"]):
                found = _pieces(encoder, text, capacity)
                rows += [(key, k, len(found), a, b, n) for k, (a, b, n) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["_id", "piece", "n_pieces", "start_char", "end_char", "n_tokens"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInPandas(run, f"_id {kind}, piece int, n_pieces int, start_char int, end_char int, n_tokens int").withColumnRenamed("_id", id_col)


class _Lengths:
    """Availability counts of lengths, with lookups of single, pair and triple sums."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.capacity = len(counts) - 1
        self.pair = np.zeros(self.capacity + 1, dtype=np.int64)  # sum -> the greater length of a pair, 0 for none
        self.present = counts > 0
        for total in range(2, self.capacity + 1):
            self._refresh(total)

    def _refresh(self, total: int) -> int:
        """Index the pair for one sum anew; the greatest length of a valid pair, or 0."""
        half = (total + 1) // 2
        greater = self.present[half:total]
        lesser = self.present[total - half : 0 : -1] if total > half else greater[:0]
        ok = np.flatnonzero(greater & lesser)
        if len(ok) and total % 2 == 0 and ok[0] == 0 and self.counts[half] < 2:
            ok = ok[1:]
        self.pair[total] = half + ok[-1] if len(ok) else 0
        return int(self.pair[total])

    def _holds(self, combination: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= n for x, n in Counter(combination).items())

    def _pair(self, total: int) -> tuple[int, ...] | None:
        a = int(self.pair[total]) if total >= 2 else 0
        if a and not self._holds((a, total - a)):
            a = self._refresh(total)
        return (a, total - a) if a else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Lengths still available that fill the gap exactly: one, two or three."""
        if gap <= 0 or gap > self.capacity:
            return None
        if self.present[gap]:
            return (gap,)
        if two := self._pair(gap):
            return two
        for a in np.flatnonzero(self.present[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            two = self._pair(gap - a)
            if two and self._holds((a, *two)):
                return (a, *two)
        return None

    def largest(self, gap: int) -> int:
        """The greatest available length that fits, or 0."""
        at = np.flatnonzero(self.present[: gap + 1])
        return int(at[-1]) if len(at) else 0

    def take(self, lengths: Counter, times: int) -> None:
        for x, n in lengths.items():
            self.counts[x] -= n * times
            self.present[x] = self.counts[x] > 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths of one container) for a histogram of item lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.items():
        left[x] = n
    lengths, out = _Lengths(left), []

    def use(combination: tuple[int, ...]) -> None:
        need = Counter(combination)
        times = int(min(lengths.counts[x] // n for x, n in need.items()))
        lengths.take(need, times)
        out.append((times, combination))

    while top := lengths.largest(capacity):
        held, gap = [top], capacity - top
        lengths.take(Counter([top]), 1)
        while gap:
            closing = lengths.exact(gap)
            if closing:
                held += closing
                lengths.take(Counter(closing), 1)
                gap = 0
                break
            more = lengths.largest(gap)
            if not more:
                break
            held.append(more)
            lengths.take(Counter([more]), 1)
            gap -= more
        lengths.take(Counter(held), -1)
        use(tuple(held))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **tokenizer: str) -> DataFrame:
    """Rows (container, position, ``id_col``, piece, n_pieces, start_char, end_char, n_tokens).

    Two passes over the measured items, which are written once to the shared
    checkpoint folder: their histogram (at most ``capacity`` rows) goes to the
    driver, the plan comes back as a table of at most a few rows per pattern.
    """
    spark = df.sparkSession
    items = settle(measure(df, id_col, text_col, capacity, **tokenizer).where("n_tokens > 0"))
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    taken: Counter = Counter()
    rows, base = [], 0
    for times, combination in plan(histogram, capacity):
        position = 0
        for x, n in sorted(Counter(combination).items(), reverse=True):
            rows.append((x, taken[x], taken[x] + n * times, n, base, position))
            taken[x] += n * times
            position += n
        base += times
    shape = T.StructType([T.StructField(n, T.LongType() if n != "n_tokens" else T.IntegerType()) for n in ("n_tokens", "rank_from", "rank_to", "per", "base", "first")])
    plan_rows = spark.createDataFrame(rows, shape)
    salts = spark.createDataFrame([(x, 1 + n // RANK_GROUP) for x, n in histogram.items()], "n_tokens int, salts long")
    salted = items.join(F.broadcast(salts), "n_tokens").withColumn("salt", F.expr(f"pmod(xxhash64(`{id_col}`, piece), salts)"))  # at most `capacity` rows
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "salt").orderBy(id_col, "piece")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("k") + F.col("offset"))
    side = F.broadcast(plan_rows) if len(rows) <= 500_000 else plan_rows
    at = ranked.join(side, "n_tokens").where("rank >= rank_from and rank < rank_to")
    return at.select(
        F.expr("base + (rank - rank_from) div per").alias("container"),
        F.expr("cast(first + (rank - rank_from) % per as int)").alias("position"),
        id_col, "piece", "n_pieces", "start_char", "end_char", "n_tokens",
    )


def oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **tokenizer: str) -> DataFrame:
    """Ids of the texts of which the packing holds more than one piece."""
    return pack(df, id_col, text_col, capacity, **tokenizer).where("n_pieces > 1").select(id_col).distinct()

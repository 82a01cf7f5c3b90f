"""Vectors as little-endian single precision blobs: load, store, batch upsert."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.incremental import upsert


@F.pandas_udf(T.BinaryType())
def _pack(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unpack(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: np.frombuffer(b, dtype="<f4", count=len(b) // 4), na_action="ignore")


def to_blob(vector: Column) -> Column:
    """Four bytes an entry, the lowest first; null stays null."""
    return _pack(vector)


def from_blob(blob: Column) -> Column:
    """The entries of a blob; bytes after the last whole entry don't count."""
    return _unpack(blob)


def store_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, blob) after new vectors (id, vector) have taken the place of those with their ids."""
    return upsert(stored.select("id", "blob"), new.select("id", to_blob(F.col("vector")).alias("blob")), ["id"])


def load_vectors(stored: DataFrame) -> DataFrame:
    return stored.select("id", from_blob(F.col("blob")).alias("vector"))

"""Vector columns as bytes for numpy inside tasks, and which of them take part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parted(df: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v) whose id and components are not null, finite and not all zero; (id) of the rows that are not so.

    Vectors of another length than ``size``, or than most have, are left out: no distance to the others is defined.
    """
    kind = df.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector_col} is not an array")
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    number = F.col(id_col).cast("long")
    good = F.coalesce(number.isNotNull() & fine, F.lit(False))
    if size is None:
        sizes = df.filter(good).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        size = sizes[0]["n"] if sizes else 0
    good &= F.coalesce(F.size(vector_col) == size, F.lit(False))
    return df.filter(good).select(number.alias("id"), F.col(vector_col).alias("v")), df.filter(~good).select(number.alias("id"))


def usable(df: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """The rows (id, v) that take part, see ``parted``."""
    return parted(df, id_col, vector_col, size)[0]


def packed(df: DataFrame) -> DataFrame:
    """(v, ...) with v as the bytes of its components as little-endian doubles."""
    others = [c for c in df.columns if c != "v"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != "v"), "v binary"])

    def run(batches):
        for b in batches:
            out = b[others].copy()
            out["v"] = [np.asarray(x, dtype="<f8").tobytes() for x in b["v"]]
            yield out

    return df.mapInPandas(run, schema)


def matrix(column: pd.Series, dtype: str = "<f8") -> np.ndarray:
    rows = len(column)
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(rows, -1) if rows else np.empty((0, 0), dtype=dtype)


def sample(df: DataFrame, n: int) -> np.ndarray:
    """At most n distinct vectors of (v), by a hash of their bytes: a bounded sample for pivots or centroids."""
    rows = df.select("v").orderBy(F.xxhash64("v"), "v").limit(n).collect()
    return np.stack([np.frombuffer(bytes(r["v"]), dtype="<f8") for r in rows]) if rows else np.empty((0, 0))

"""Seeded samples of an exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.exprs import row_hash

SEED = 42
PROFILE_ROWS = 100_000


def exact_sample(df: DataFrame, n: int = PROFILE_ROWS, seed: int = SEED, total: int | None = None) -> DataFrame:
    """``n`` rows without replacement, all where there are fewer, the same rows every time.

    Rows are drawn in the order of a hash of their values.  Hashes are uniform,
    so only those under a threshold with slack go to the one task that takes
    the first ``n``: a few more than ``n`` rows in all, however many partitions
    there are.  Where equal rows upset the count, every task keeps its own
    first ``n`` instead.  ``total`` is the number of rows, if known.
    """
    rows = df.withColumn("_h", row_hash(df, seed))
    total = df.count() if total is None else total
    share = (n + 8 * n**0.5 + 32) / max(total, 1)
    if share < 0.5:
        few = rows.filter(F.col("_h") < int(-(2**63) + share * 2**64))
        if n <= few.count() <= 2 * n + 64:
            rows = few
    return rows.orderBy("_h", *df.columns).limit(n).drop("_h")


def exact_sample_by(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows of every value of ``key``."""
    w = W.partitionBy(key).orderBy("_h")
    return df.withColumn("_h", row_hash(df, seed)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")

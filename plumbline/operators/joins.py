"""Joins with lookup tables, whose size is measured before one is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialize

#: A lookup table is broadcast up to so many rows and bytes of its files, both measured before; larger ones go through a salted join.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Ways over which a salted join deals the rows of one key.
SALTS = 32


def size_in_bytes(df: DataFrame) -> int:
    """Size of a table as the optimizer knows it: for one just written, that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined with ``small``, whose rows are few per key, so that a hot key never becomes one task.

    ``small`` is written and measured.  Up to ``limit`` rows and a bounded size it is broadcast;
    beyond, each of its rows is repeated for every salt and the rows of ``big``
    are dealt over the salts by the hash of ``spread``.  Null keys match nothing.
    """
    small = materialize(small, "lookup")
    if small.count() <= limit and size_in_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return big.join(small, [*keys, "_salt"], how).drop("_salt")

"""Running sums, positions, lags, ranks and quantiles over a whole table in a total order, without one task for all rows.

The table is written and counted.  A short one is a window in one task; else
rows are range-partitioned by the order and written again, so that both uses of
a partitioning see the same boundaries.  Every partition sums up by itself; what
the partitions before it add comes from a table of one row per partition, which
the session's shuffle partitions bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.joins import lookup
from plumbline.sources.scratch import materialize

UPTO = (W.unboundedPreceding, W.currentRow)
#: Rows that one task may order.
SHORT = 200_000
#: A value is hot where it has more than one of so many rows; there are fewer hot values than that.
HOT_SHARE = 1000


def _dealt(df: DataFrame, order: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = W.partitionBy("_part").orderBy(*order)
    rows = rows.withColumn("_at", F.row_number().over(own))
    for name, f in (made or {}).items():
        rows = rows.withColumn(name, f.over(own.rowsBetween(*UPTO)) if name.startswith("_sum") else f.over(own))
    return materialize(rows, "ordered")


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums; ``order`` must be total."""
    df = materialize(df, "unordered")
    if df.count() <= SHORT:
        return df.select("*", *(F.sum(c).over(W.orderBy(*order).rowsBetween(*UPTO)).alias(n) for n, c in sums.items()))
    own = {f"_sum{i}": F.sum(c) for i, c in enumerate(sums.values())}
    rows = _dealt(df, order, own)
    last = rows.groupBy("_part").agg(*(F.max_by(s, "_at").alias(f"{s}_all") for s in own))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("_part", *(F.coalesce(F.sum(f"{s}_all").over(before), F.lit(0)).alias(f"{s}_before") for s in own))
    rows = rows.join(F.broadcast(last), "_part")
    return rows.select(*df.columns, *((F.col(s) + F.col(f"{s}_before")).alias(n) for s, n in zip(own, sums)))


def lagged(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """``df`` with the value one row before; ``order`` must be total."""
    df = materialize(df, "unordered")
    if df.count() <= SHORT:
        return df.select("*", F.lag(value).over(W.orderBy(*order)).alias(out))
    rows = _dealt(df, order, {"_own": F.lag(value)})
    last = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col("_at")).alias("last"))
    last = last.select("_part", F.lag("last").over(W.orderBy("_part"))["v"].alias("_edge"))
    rows = rows.join(F.broadcast(last), "_part")
    return rows.select(*df.columns, F.when(F.col("_at") == 1, F.col("_edge")).otherwise(F.col("_own")).alias(out))


def positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """``df`` with 1, 2, 3, ... in a total order."""
    return running(df, order, {out: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``value`` among its non-null values, ties sharing theirs."""
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("_row"), F.lit("").alias("_column"), F.col(value).alias("_value"))
    ranked = column_ranks(rows).select("_row", F.col("_rank").alias("_r"))
    kept = df.filter(F.col(value).isNull()).select("*", F.lit(None).cast("double").alias(out))
    return ranked.select("_row.*", F.col("_r").alias(out)).unionByName(kept)


def column_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (_column, _value, ...) without null values, with ``_rank``: the average rank of a value in its column.

    Values are counted first, and only distinct values are summed up in order.
    Rows meet their ranks by value; hot values, a bounded number, in a broadcast.
    """
    rows = rows.filter("_value is not null")
    counts = rows.groupBy("_column", "_value").agg(F.count("*").alias("_c"))
    upto = running(counts, ["_column", "_value"], {"_upto": F.col("_c")})
    whole = upto.groupBy("_column").agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    ranks = lookup(upto, whole, ["_column"], F.col("_value"))
    ranks = materialize(ranks.select("_column", "_value", (F.col("_upto") - F.col("_start") - (F.col("_c") - 1) / 2).alias("_rank"), (F.col("_c") * HOT_SHARE > F.col("_n")).alias("_hot")), "ranks")
    rows = lookup(rows, ranks.filter("_hot").drop("_hot"), ["_column", "_value"], F.monotonically_increasing_id())
    cold = rows.filter("_rank is null").drop("_rank").join(ranks.filter("not _hot").drop("_hot"), ["_column", "_value"])
    return rows.filter("_rank is not null").unionByName(cold)


def quantiles(df: DataFrame, keys: list[str], value: str, linear: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """(keys, n, ...): quantiles of ``value`` by group, between neighbours (``linear``) or at the nearest rank, halves up.

    Values are counted by group and summed up in order of (keys, value), so a
    group may have any number of distinct values.  Null keys and values are left out.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).dropna()
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    upto = running(counts, [*keys, "_v"], {"_upto": F.col("_c")})
    whole = upto.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    if keys:
        upto = lookup(upto, whole, keys, F.col("_v"))
    else:
        upto = upto.crossJoin(F.broadcast(whole))
    at = lambda k: F.min(F.when(F.col("_upto") - F.col("_start") > k, F.col("_v")))
    last = F.col("n") - 1
    wanted, out = [], []
    for name, q in linear.items():
        k = F.floor(last * q)
        wanted += [at(k).alias(f"_{name}0"), at(F.least(k + 1, last)).alias(f"_{name}1")]
        part = last * q - F.floor(last * q)
        out.append((F.col(f"_{name}0") + part * (F.col(f"_{name}1") - F.col(f"_{name}0"))).alias(name))
    for name, q in (nearest or {}).items():
        wanted.append(at(F.floor(last * q + 0.5)).alias(name))
        out.append(F.col(name))
    return upto.groupBy(*keys, "n").agg(*wanted).select(*keys, "n", *out)

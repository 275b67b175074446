"""Column profiles and data quality as DataFrames: one row per column, value or pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.exprs import finite, label, pearson
from plumbline.operators import ordered
from plumbline.operators.ordered import column_ranks
from plumbline.operators.typing import MISSING_TOKENS, numeric_cast, stripped
from plumbline.sources.scratch import materialize

#: Aggregate expressions of one pass; more would outgrow generated code.
CHUNK = 40
MAD_SCALE = 1.4826
FAR_OUT = 3.0
Z_SENTINEL = 10.0
PATTERNS = (999.0, 9999.0, 99999.0, 999999.0)
LABELS_LISTED = 13


def long_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) of the finite values of the named columns."""
    wide = df.select(*(finite(df, n).alias(n) for n in names))
    return wide.unpivot([], names, "column", "value").filter("value is not null")


def numeric_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n, min, max, mean, median, std, q25, q75 (nearest rank), skew over finite values."""
    rows = long_numbers(df, names)
    v = F.col("value")
    stats = rows.groupBy("column").agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("skew"))
    ranks = ordered.quantiles(rows, ["column"], "value", {"median": 0.5}, {"q25": 0.25, "q75": 0.75}).drop("n")
    return stats.join(ranks, "column").select("column", "n", "min", "max", "mean", "median", "std", "q25", "q75", "skew")


def top_categories(df: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """column, value, n of the k most frequent labels; ties by label."""
    wide = df.select(*(label(df, n).alias(n) for n in names))
    counts = wide.unpivot([], names, "column", "value").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= k).select("column", "value", "n")


def category_lists(df: DataFrame, names: list[str], most: int = LABELS_LISTED) -> DataFrame:
    """column, n_categories and, up to ``most`` of them, all labels in order."""
    wide = df.select(*(label(df, n).alias(n) for n in names))
    found = wide.unpivot([], names, "column", "value").filter("value is not null").distinct()
    nth = F.row_number().over(W.partitionBy("column").orderBy("value"))
    first = found.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("labels"))  # each task keeps ``most``
    found = found.groupBy("column").agg(F.count("*").alias("n_categories")).join(first, "column")
    return found.withColumn("labels", F.when(F.col("n_categories") <= most, F.col("labels")))


def datetime_frequency(df: DataFrame, name: str) -> DataFrame:
    """first, last, n_distinct, median_gap (days) and frequency of a time column."""
    distinct = df.filter(F.col(name).isNotNull()).select(F.col(name).cast("timestamp_ntz").alias("t")).distinct()
    gap = F.timestamp_diff("MICROSECOND", F.col("before"), F.col("t")) / 8.64e10
    row = ordered.lagged(distinct, ["t"], "t").withColumn("gap", gap).agg(F.min("t").cast("string").alias("first"), F.max("t").cast("string").alias("last"), F.count("*").alias("n_distinct"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    g = F.col("median_gap")
    frequency = F.when(F.col("n_distinct") < 3, "unknown").when(g.between(0.9, 1.1), "daily").when(g.between(6.5, 7.5), "weekly").when(g.between(27, 32), "monthly").otherwise("irregular")
    return row.withColumn("frequency", frequency)


def text_lengths(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n, mean_length and max_length in code points."""
    wide = df.select(*(F.length(n).alias(n) for n in names))
    return wide.unpivot([], names, "column", "length").filter("length is not null").groupBy("column").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.max("length").cast("long").alias("max_length"))


def quality_counts(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """Rows of a text column read as numbers: n_rows, missing, tokens, invalid, valid, valid_ratio."""
    c = F.col(name)
    token = F.lower(stripped(c)).isin(*MISSING_TOKENS)
    good = numeric_cast(c).isNotNull()
    count = lambda x: F.count_if(x)
    row = df.agg(F.count("*").alias("n_rows"), count(c.isNull()).alias("missing"), count(token).alias("tokens"), count(c.isNotNull() & ~token & ~good).alias("invalid"), count(good).alias("valid"))
    return row.withColumn("valid_ratio", F.try_divide("valid", "n_rows"))


def robust_scale(df: DataFrame, name: str) -> DataFrame:
    """n, median, mad, q1, q3 (linear) of the finite values: two passes, the first one row wide."""
    v = df.select(finite(df, name).alias("v")).filter("v is not null")
    mid = materialize(ordered.quantiles(v, [], "v", {"median": 0.5, "q1": 0.25, "q3": 0.75}), "median")
    off = v.crossJoin(F.broadcast(mid)).select(F.abs(F.col("v") - F.col("median")).alias("off"))
    dev = ordered.quantiles(off, [], "off", {"mad": 0.5}).drop("n").crossJoin(F.broadcast(off.agg(F.max("off").alias("far"))))
    return mid.crossJoin(F.broadcast(dev))


def sentinel_candidates(df: DataFrame, name: str, scale: DataFrame | None = None) -> DataFrame:
    """value, n, and the signals of values more than ten robust deviations out.

    ``suspected`` takes two signals of: repeated, a fill pattern, a hundred
    times the column's own scale.  Only for columns with spread around the median.
    """
    scale = (robust_scale(df, name) if scale is None else scale).filter("mad > 1e-9 * greatest(1.0, abs(median))")
    v = df.select(finite(df, name).alias("value")).filter("value is not null")
    rows = v.crossJoin(F.broadcast(scale.withColumnRenamed("n", "n_all"))).filter(F.abs(F.col("value") - F.col("median")) / (MAD_SCALE * F.col("mad")) > Z_SENTINEL)
    found = rows.groupBy("value").agg(F.count("*").alias("n"), F.first("n_all").alias("n_all"), F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.first("mad").alias("mad"))
    repeated = (F.col("n") >= 2) & (F.col("n") >= 0.002 * F.col("n_all"))
    pattern = F.abs("value").isin(*PATTERNS)
    large = F.abs("value") >= 100.0 * F.greatest(F.abs("q1"), F.abs("q3"), MAD_SCALE * F.col("mad"))
    found = found.select("value", "n", repeated.alias("repeated"), pattern.alias("pattern"), large.alias("scale"))
    return found.withColumn("suspected", F.col("repeated").cast("int") + F.col("pattern").cast("int") + F.col("scale").cast("int") >= 2)


def robust_fences(df: DataFrame, name: str) -> DataFrame:
    """One row: median, mad, robust_z_max, q1, q3, iqr and fences of the values without suspected sentinels, and what lies beyond."""
    v = df.select(finite(df, name).alias("v")).filter("v is not null")
    whole = materialize(robust_scale(df, name), "scale")
    scale = whole.select("n", "median", "mad", F.try_divide("far", MAD_SCALE * F.col("mad")).alias("robust_z_max"))
    bad = sentinel_candidates(df, name, whole).filter("suspected").select("value")
    clean = v.join(F.broadcast(bad), v["v"] == bad["value"], "left_anti")
    q = ordered.quantiles(clean, [], "v", {"q1": 0.25, "q3": 0.75}).withColumnRenamed("n", "n_clean").crossJoin(F.broadcast(clean.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("lower", F.col("q1") - FAR_OUT * F.col("iqr")).withColumn("upper", F.col("q3") + FAR_OUT * F.col("iqr"))
    out = clean.crossJoin(F.broadcast(q)).agg(F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("extreme_count"))
    row = scale.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(out))
    return row.select("n", "median", "mad", "robust_z_max", "q1", "q3", "iqr", "extreme_count", (F.col("n") - F.col("n_clean")).alias("sentinel_rows"), F.greatest("lo", "lower").alias("range_lo"), F.least("hi", "upper").alias("range_hi"))


def pearson_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r, n of every pair, each over the rows where both are finite; r null where undefined.

    All pairs of a chunk come out of one aggregation with map-side sums.
    """
    wide = df.select(*(finite(df, n).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = None
    for at in range(0, len(pairs), CHUNK):
        stats = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col(a), F.col(b)).alias("r"), F.regr_count(F.col(b), F.col(a)).alias("n")) for a, b in pairs[at : at + CHUNK]]
        rows = wide.agg(F.array(*stats).alias("x")).select(F.inline("x"))
        out = rows if out is None else out.unionByName(rows)
    return out


def spearman_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """As :func:`pearson_pairs` on average ranks, taken once over all finite values of a column.

    All columns are ranked together, as (row, column, value), and their ranks meet again by row.
    """
    wide = materialize(df.select(F.monotonically_increasing_id().alias("_id"), *(finite(df, n).alias(n) for n in names)), "numbers")
    ranked = column_ranks(wide.unpivot(["_id"], names, "_column", "_value"))
    rows = ranked.groupBy("_id").agg(*(F.max(F.when(F.col("_column") == n, F.col("_rank"))).alias(n) for n in names))
    return pearson_pairs(rows, names)



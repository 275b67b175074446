"""Layer-2 structure as DataFrames: distributions, group summaries, curves, change points, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.exprs import bucket, finite, label, m2, rank_bin
from plumbline.operators import ordered
from plumbline.operators.ordered import average_ranks
from plumbline.sources.scratch import materialize

MIN_ROWS = 30
DIST_BINS, CURVE_BINS = 10, 10
SEGMENT = 5
MAD_SCALE = 1.4826


def distribution_bins(df: DataFrame, name: str, lo: float | None = None, hi: float | None = None, bins: int = DIST_BINS) -> DataFrame:
    """(bin, n) of equal bins over [lo, hi] (the data's range where not given); values outside are not counted."""
    v = df.select(finite(df, name).alias("v")).filter("v is not null")
    span = v.agg((F.lit(lo) if lo is not None else F.min("v")).cast("double").alias("lo"), (F.lit(hi) if hi is not None else F.max("v")).cast("double").alias("hi"))
    rows = v.crossJoin(F.broadcast(span)).filter("v between lo and hi")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("long")
    counts = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: n, quantiles, skewness, excess kurtosis and Sarle's bimodality coefficient."""
    v = df.select(finite(df, name).alias("v")).filter("v is not null")
    row = v.agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(q)).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    n = F.col("n").cast("double")
    below = F.col("kurtosis") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return row.withColumn("bimodality", F.when((n >= 4) & (below > 0), F.try_divide(F.col("skewness") * F.col("skewness") + 1, below)))


def group_summary(df: DataFrame, cat: str, num: str) -> DataFrame:
    """Per level: n, mean, median, std, q25, q75."""
    rows = df.select(label(df, cat).alias("level"), finite(df, num).alias("v")).dropna()
    cuts = ordered.quantiles(rows, ["level"], "v", {"median": 0.5, "q25": 0.25, "q75": 0.75}).drop("n")
    stats = rows.groupBy("level").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return stats.join(cuts, "level").select("level", "n", "mean", "median", "std", "q25", "q75")


def subgroup_anomalies(summary: DataFrame, least: int = MIN_ROWS, groups: int = 5) -> DataFrame:
    """(level, n, mean, others_median, robust_z, diff_sd, anomalous) of the levels with enough rows.

    Empty with fewer than ``groups`` such levels or without spread among their means.
    """
    rows = summary.filter((F.col("n") >= least) & F.col("mean").isNotNull())
    pooled = F.sqrt(F.try_divide(F.sum((F.col("n") - 1) * F.col("std") * F.col("std")), F.sum(F.when(F.col("std").isNotNull(), F.col("n") - 1))))
    mid = rows.agg(F.count("*").alias("k"), F.percentile("mean", F.lit(0.5)).alias("others_median"), pooled.alias("pooled"))
    dev = rows.crossJoin(F.broadcast(mid)).agg(F.percentile(F.abs(F.col("mean") - F.col("others_median")), F.lit(0.5)).alias("mad"))
    rows = rows.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(dev)).filter((F.col("k") >= groups) & (F.col("mad") > 0) & (F.col("pooled") > 0))
    rows = rows.withColumn("robust_z", (F.col("mean") - F.col("others_median")) / (MAD_SCALE * F.col("mad"))).withColumn("diff_sd", (F.col("mean") - F.col("others_median")) / F.col("pooled"))
    odd = (F.abs("robust_z") >= 3.0) & (F.abs("diff_sd") >= 0.5)
    return rows.select("level", "n", "mean", "others_median", "robust_z", "diff_sd", odd.alias("anomalous"))


def group_time_pattern(df: DataFrame, time: str, cat: str, num: str, unit: str) -> DataFrame:
    """(bucket, level, n, mean) per time bucket and level."""
    rows = df.select(bucket(F.col(time), unit).alias("bucket"), label(df, cat).alias("level"), finite(df, num).alias("v")).dropna()
    return rows.groupBy("bucket", "level").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def nonlinear_bins(df: DataFrame, x: str, ys: list[str], bins: int = CURVE_BINS) -> DataFrame:
    """(y, bin, lo, hi, n, mean, m2) over equal-frequency bins of x by average rank; ties share a bin."""
    rows = df.select(finite(df, x).alias("_x"), *(finite(df, y).alias(y) for y in ys)).filter("_x is not null")
    whole = rows.agg(F.count("*").alias("_all"))
    ranked = average_ranks(rows, "_x", "_rank").crossJoin(F.broadcast(whole))
    at = rank_bin(F.col("_rank"), F.col("_all"), bins)
    stats = [F.struct(F.lit(y).alias("y"), F.count(F.col(y)).alias("n"), F.avg(F.col(y)).alias("mean"), m2(F.col(y)).alias("m2")) for y in ys]
    found = ranked.groupBy(at.alias("_bin")).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.array(*stats).alias("s"))
    found = found.select(F.col("_bin").alias("bin"), "lo", "hi", F.inline("s"))
    return found.filter("n > 0").select("y", "bin", "lo", "hi", "n", "mean", "m2")


def bucket_series(df: DataFrame, time: str, num: str, unit: str) -> DataFrame:
    """(bucket, n, mean) in time buckets; one row per bucket."""
    rows = df.select(bucket(F.col(time), unit).alias("bucket"), finite(df, num).alias("v")).dropna()
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def change_point(series: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The split of a bucket series that separates its means best: k, change_at, before, after, effect.

    Buckets weigh the same; the series is bounded (a few hundred buckets), so
    prefix sums run over it whole.  No row with too few buckets or no spread.
    """
    whole, upto = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    rows = series.select("bucket", "mean").withColumn("k", F.count("*").over(upto)).withColumn("b", F.count("*").over(whole))
    for name, c in (("s", F.col("mean")), ("q", F.col("mean") * F.col("mean"))):
        rows = rows.withColumn(f"{name}1", F.sum(c).over(upto)).withColumn(f"{name}2", F.sum(c).over(whole))
    rows = rows.filter((F.col("k") >= segment) & (F.col("b") - F.col("k") >= segment))
    k, r = F.col("k"), F.col("b") - F.col("k")
    rows = rows.withColumn("before", F.col("s1") / k).withColumn("after", (F.col("s2") - F.col("s1")) / r)
    grand = F.col("s2") / F.col("b")
    between = k * (F.col("before") - grand) * (F.col("before") - grand) + r * (F.col("after") - grand) * (F.col("after") - grand)
    within = F.greatest(F.col("q2") - k * F.col("before") * F.col("before") - r * F.col("after") * F.col("after"), F.lit(0.0))
    rows = rows.withColumn("between", between).withColumn("effect", F.try_divide(F.abs(F.col("after") - F.col("before")), F.sqrt(within / (F.col("b") - 2))))
    return rows.orderBy(F.desc("between"), "k").limit(1).filter("effect is not null").select("k", F.col("bucket").alias("change_at"), "before", "after", "effect")


def ks_distances(df: DataFrame, cat: str, num: str, least: int = MIN_ROWS, groups: int = 8) -> DataFrame:
    """(a, b, n_a, n_b, distance) of the two-sample KS distance between the largest levels.

    Rows are read once, to count values per level; distributions are running sums over the
    distinct values, kept as one map of counts per value, so no pair of samples
    is ever joined.
    """
    rows = df.select(label(df, cat).alias("level"), finite(df, num).alias("v")).dropna()
    counts = materialize(rows.groupBy("level", "v").agg(F.count("*").alias("c")), "counts")
    sizes = counts.groupBy("level").agg(F.sum("c").alias("size")).filter(F.col("size") >= least)
    levels = sorted((r["level"], r["size"]) for r in sizes.orderBy(F.desc("size"), "level").limit(groups).collect())
    counts = counts.filter(F.col("level").isin([v for v, _ in levels]))
    if len(levels) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n_a long, n_b long, distance double")
    wide = counts.groupBy("v").agg(*(F.sum(F.when(F.col("level") == v, F.col("c")).otherwise(0)).alias(f"c{i}") for i, (v, _) in enumerate(levels)))
    summed = ordered.running(wide, ["v"], {f"s{i}": F.col(f"c{i}") for i in range(len(levels))})
    shares = summed.select(*((F.col(f"s{i}") / n).alias(f"f{i}") for i, (_, n) in enumerate(levels)))
    pairs = [(i, j) for i in range(len(levels)) for j in range(i + 1, len(levels))]
    gaps = [F.struct(F.lit(levels[i][0]).alias("a"), F.lit(levels[j][0]).alias("b"), F.lit(levels[i][1]).alias("n_a"), F.lit(levels[j][1]).alias("n_b"), F.max(F.abs(F.col(f"f{i}") - F.col(f"f{j}"))).alias("distance")) for i, j in pairs]
    return shares.agg(F.array(*gaps).alias("x")).select(F.inline("x"))

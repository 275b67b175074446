"""Chart data as DataFrames: what a declarative chart specification reduces the full table to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.exprs import bucket, finite, width_bin
from plumbline.operators import ordered
from plumbline.operators.joins import lookup
from plumbline.sources.scratch import materialize

AGGREGATIONS = ("count", "sum", "mean", "median", "min", "max")
HEX_COLUMNS = 40
DENSITY_BINS = 64
TOP = 20
LINKS = 60


def aggregate(how: str, y: str | None) -> Column:
    if how == "count":
        return F.count("*")
    return {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}[how](F.col(y))


def clean(df: DataFrame, columns: list[str | None], numbers: list[str | None]) -> DataFrame:
    """The named columns without rows that miss one; numbers must be finite."""
    names = list(dict.fromkeys(c for c in columns if c))
    rows = df.select(*names)
    return rows.select(*(finite(rows, c).alias(c) if c in numbers else F.col(c) for c in names)).dropna()


def line(df: DataFrame, x: str, y: str | None, how: str, unit: str | None = None, group: str | None = None) -> DataFrame:
    """(x[, series], y): one aggregate per (time bucket of) x and series."""
    rows = clean(df, [x, y, group], [y])
    at = bucket(F.col(x), unit) if unit else F.col(x)
    keys = [at.alias("x"), *([F.col(group).alias("series")] if group else [])]
    return rows.groupBy(*keys).agg(aggregate(how, y).alias("y"))


def ranked_categories(df: DataFrame, x: str, y: str | None, how: str, top: int = TOP) -> DataFrame:
    """(category, rank, truncated): the ``top`` categories by magnitude of their aggregate, ties by name.

    A top-n over the aggregated categories: each task keeps ``top`` of them.
    """
    rows = clean(df, [x, y], [y]).groupBy(F.col(x).alias("category")).agg(aggregate(how, y).alias("value"))
    size = F.col("value") if how == "count" else F.abs("value")
    best = rows.withColumn("size", size).orderBy(F.desc("size"), "category").limit(top + 1)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "category"))).withColumn("n", F.count("*").over(W.partitionBy(F.lit(0))))
    return best.filter(F.col("rank") <= top).select("category", "rank", (F.col("n") > top).alias("truncated"))


def bar(df: DataFrame, x: str, y: str | None, how: str, group: str | None = None, top: int = TOP) -> DataFrame:
    """(category, rank[, series], value): aggregates of the ranked categories; a missing cell is a null value."""
    cats = ranked_categories(df, x, y, how, top).select("category", "rank")
    rows = clean(df, [x, y, group], [y])
    keys = [F.col(x).alias("category"), *([F.col(group).alias("series")] if group else [])]
    cells = rows.groupBy(*keys).agg(aggregate(how, y).alias("value"))
    if not group:
        return cats.join(cells, "category", "left")
    grid = cats.crossJoin(cells.select("series").distinct())  # at most ``top`` categories
    return grid.join(cells, ["category", "series"], "left").select("category", "rank", "series", "value")


def stacked(df: DataFrame, x: str, y: str | None, how: str, group: str, top: int = TOP) -> DataFrame:
    """Bars of parts with their totals and shares in percent."""
    total = F.sum("value").over(W.partitionBy("category"))
    rows = bar(df, x, y, how, group, top).withColumn("total", total)
    return rows.withColumn("percent", F.try_divide(100.0 * F.col("value"), F.col("total")))


def histogram(df: DataFrame, x: str, bins: int | None = None, group: str | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """([series,] bin, lo, hi, n) over shared edges, empty bins included.

    Bins default to the square root of the rows between 10 and 50; a constant
    column is one bin around its value.
    """
    rows = clean(df, [x, group], [x])
    rows = rows.filter(F.col(x).between(lo, hi)) if lo is not None and hi is not None else rows
    edge = rows.agg((F.lit(lo).cast("double") if lo is not None else F.min(x)).alias("lo"), (F.lit(hi).cast("double") if hi is not None else F.max(x)).alias("hi"), F.count("*").alias("rows")).filter("rows > 0")
    k = F.lit(bins) if bins else F.greatest(F.lit(10), F.least(F.lit(50), F.floor(F.sqrt("rows")))).cast("int")
    flat = F.col("lo") == F.col("hi")
    edge = edge.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.when(flat, 1).otherwise(k).alias("k"))
    edge = edge.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("k"))
    at = F.least(F.greatest(F.floor((F.col(x) - F.col("lo")) / F.col("width")), F.lit(0)), F.col("k") - 1).cast("long")
    keys = ["series", "bin"] if group else ["bin"]
    counts = rows.crossJoin(F.broadcast(edge)).withColumn("bin", at)
    counts = (counts.withColumn("series", F.col(group)) if group else counts).groupBy(*keys).agg(F.count("*").alias("n"))
    every = edge.select("lo", "hi", "k", "width", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("k") - 1).cast("long"))).alias("bin"))
    every = every.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), F.when(F.col("bin") == F.col("k") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"))
    if group:
        every = counts.select("series").distinct().crossJoin(F.broadcast(every))  # the bins are bounded, the series need not be
    return every.join(counts, keys, "left").select(*keys, "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """(name, n, mean, q1, median, q3, lower_fence, upper_fence, n_outliers) per level of x, or over all rows."""
    rows = clean(df, [x, y], [y]).select((F.col(x).cast("string") if x else F.lit("all")).alias("name"), F.col(y).alias("v"))
    cuts = ordered.quantiles(rows, ["name"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    stats = rows.groupBy("name").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(cuts, "name").select("name", "n", "mean", "q1", "median", "q3")
    stats = stats.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    stats = materialize(stats, "boxes")
    out = lookup(rows, stats, ["name"], F.col("v")).groupBy("name").agg(F.count_if((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))).alias("n_outliers"))
    return stats.join(out, "name")


def outliers(df: DataFrame, y: str, x: str | None, n: int) -> DataFrame:
    """(name, v): up to ``n`` values of every level beyond its fences, drawn by hash."""
    from plumbline.operators.sampling import exact_sample_by

    rows = clean(df, [x, y], [y]).select((F.col(x).cast("string") if x else F.lit("all")).alias("name"), F.col(y).alias("v"))
    far = lookup(rows, box(df, y, x).select("name", "lower_fence", "upper_fence"), ["name"], F.col("v")).filter("v < lower_fence or v > upper_fence").select("name", "v")
    return exact_sample_by(far, "name", n)


def cells(df: DataFrame, x: str, group: str, y: str | None, how: str) -> DataFrame:
    """(x, group, value): the aggregate of every (x, group) there is."""
    rows = clean(df, [x, group, y], [y])
    return rows.groupBy(F.col(x).cast("string").alias("x"), F.col(group).cast("string").alias("group")).agg(aggregate(how, y).alias("value"))


def density_counts(df: DataFrame, y: str, x: str | None = None, bins: int = DENSITY_BINS) -> DataFrame:
    """(name, bin, n) over the range all levels share: what a smoothed density is made from."""
    rows = clean(df, [x, y], [y]).select((F.col(x).cast("string") if x else F.lit("all")).alias("name"), F.col(y).alias("v"))
    edge = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = width_bin(F.col("v"), F.col("lo"), (F.col("hi") - F.col("lo")) / bins, bins)
    return rows.crossJoin(F.broadcast(edge)).groupBy("name", at.alias("bin")).agg(F.count("*").alias("n"))


def dot_interval(df: DataFrame, x: str, y: str) -> DataFrame:
    """(name, n, mean, lo, hi): mean with its 95 % normal interval, null under two rows."""
    rows = clean(df, [x, y], [y])
    stats = rows.groupBy(F.col(x).cast("string").alias("name")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n"))
    return stats.select("name", "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def hexbin(df: DataFrame, x: str, y: str, columns: int = HEX_COLUMNS) -> DataFrame:
    """(col, row, n) of pointy-top hexagons in offset coordinates; integer indexes, one aggregation."""
    rows = clean(df, [x, y], [x, y])
    edge = rows.agg(*(f(c).alias(f"{k}_{a}") for c, k in ((x, "x"), (y, "y")) for f, a in ((F.min, "lo"), (F.max, "hi"))))
    for k in "xy":
        flat, lo, hi = F.col(f"{k}_lo") == F.col(f"{k}_hi"), F.col(f"{k}_lo"), F.col(f"{k}_hi")
        edge = edge.withColumns({f"{k}_lo": F.when(flat, lo - 0.5).otherwise(lo), f"{k}_hi": F.when(flat, hi + 0.5).otherwise(hi)})
    edge = edge.withColumn("dx", (F.col("x_hi") - F.col("x_lo")) / columns)
    edge = edge.withColumn("dy", F.col("dx") * (F.col("y_hi") - F.col("y_lo")) / (F.col("x_hi") - F.col("x_lo")) * F.lit(2 / 3**0.5))
    rows = rows.crossJoin(F.broadcast(edge)).withColumn("row", F.floor((F.col(y) - F.col("y_lo")) / (F.col("dy") * 0.75)))
    shift = F.when(F.col("row") % 2 == 1, F.col("dx") / 2).otherwise(0.0)
    return rows.groupBy(F.floor((F.col(x) - F.col("x_lo") - shift) / F.col("dx")).alias("col"), "row").agg(F.count("*").alias("n"))


def sankey(df: DataFrame, source: str, target: str, y: str | None = None, how: str = "count", top: int = LINKS) -> DataFrame:
    """(source, target, value) of the heaviest flows of positive weight; self-loops carry none."""
    rows = clean(df, [source, target, y], [y])
    rows = rows.withColumn("source", F.col(source).cast("string")).withColumn("target", F.col(target).cast("string")).filter("source <> target")
    flows = rows.groupBy("source", "target").agg(aggregate(how, y).alias("value")).filter("value > 0")
    return flows.orderBy(F.desc("value"), "source", "target").limit(top)


def stride(df: DataFrame, x: str, most: int) -> DataFrame:
    """Every k-th row of a series in order of x, k the least that leaves ``most`` rows."""
    rows = ordered.positions(df, [x, *(c for c in df.columns if c != x)], "_nth")
    n = df.agg(F.ceil(F.count("*") / most).alias("_k"))
    return rows.crossJoin(F.broadcast(n)).filter((F.col("_nth") - 1) % F.greatest("_k", F.lit(1)) == 0).drop("_nth", "_k")


def gap_flags(series: DataFrame, x: str, key: str) -> DataFrame:
    """(series, x, gap): whether a grouped line breaks before a point because other series have buckets in between.

    Buckets are ranked once over all series; a step of more than one rank is a gap.
    """
    rows = series.join(ordered.positions(series.select(x).distinct(), [x], "_rank"), x)
    step = F.col("_rank") - F.lag("_rank").over(W.partitionBy(key).orderBy(x))
    return rows.select(key, x, F.coalesce(step > 1, F.lit(False)).alias("gap"))

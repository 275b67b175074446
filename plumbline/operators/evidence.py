"""Layer-1 evidence as DataFrames: group effects, time effects, interactions, spread, identities.

Rows are reduced by one aggregation per question to bounded tables of moments
(n, mean, M2), which merge exactly; everything above those is arithmetic.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.exprs import bucket, finite, label, m2, pearson
from plumbline.operators import ordered
from plumbline.operators.joins import lookup

MIN_CELL, MIN_CELLS, FULL_GRID = 5, 4, 0.7
MIN_GROUP = 30
EDGE = 0.1
CHUNK = 60
MATCH_ROWS, MATCH_RATIO = 30, 0.99


def level_moments(df: DataFrame, levels: dict[str, Column], nums: list[str]) -> DataFrame:
    """(cat, level, num, n, mean, m2) for every grouping of ``levels`` and every number.

    A row becomes one row per grouping, not per (grouping, number); the one
    shuffle carries the groups' partial moments.
    """
    groupings = F.array(*(F.struct(F.lit(name).alias("_cat"), c.cast("string").alias("_level")) for name, c in levels.items()))
    rows = df.select(F.inline(groupings), *(finite(df, n).alias(n) for n in nums)).filter("_level is not null")
    stats = [F.struct(F.lit(n).alias("num"), F.count(F.col(n)).alias("n"), F.avg(F.col(n)).alias("mean"), m2(F.col(n)).alias("m2")) for n in nums]
    rows = rows.groupBy(F.col("_cat").alias("cat"), F.col("_level").alias("level")).agg(F.array(*stats).alias("x"))
    return rows.select("cat", "level", F.inline("x")).filter("n > 0")


def effects(moments: DataFrame) -> DataFrame:
    """(cat, num, n_groups, n_total, n_min, ss_between, ss_within, eta_squared, f_stat) of level moments.

    eta squared is adjusted for degrees of freedom and null where undefined.
    """
    pair = W.partitionBy("cat", "num")
    grand = F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair)
    rows = moments.withColumn("between", F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand))
    sums = rows.groupBy("cat", "num").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_total"), F.min("n").alias("n_min"), F.sum("between").alias("ss_between"), F.sum("m2").alias("ss_within"))
    k, n = F.col("n_groups"), F.col("n_total")
    total = F.col("ss_between") + F.col("ss_within")
    defined = (k >= 2) & (n - k >= 2) & (total > 0)
    eta = F.greatest(F.lit(0.0), 1 - F.try_divide(F.try_divide("ss_within", n - k), F.try_divide(total, n - 1)))
    f = F.try_divide(F.try_divide("ss_between", k - 1), F.try_divide("ss_within", n - k))
    return sums.withColumn("eta_squared", F.when(defined, eta)).withColumn("f_stat", F.when(defined, f))


def eta_squared(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    return effects(level_moments(df, {c: label(df, c) for c in cats}, nums))


def time_effects(df: DataFrame, time: str, nums: list[str], units: tuple[str, ...] = ("day", "month", "year")) -> DataFrame:
    """Effects of day, month and year buckets at once; ``cat`` is the unit."""
    return effects(level_moments(df, {u: bucket(F.col(time), u) for u in units}, nums))


def interaction_cells(df: DataFrame, a: Column, b: Column, num: str, least: int = MIN_CELL) -> DataFrame:
    """(a, b, n, mean, m2) of the cells with at least ``least`` rows."""
    rows = df.select(a.cast("string").alias("a"), b.cast("string").alias("b"), finite(df, num).alias("v")).dropna()
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), m2(F.col("v")).alias("m2")).filter(F.col("n") >= least)


def interaction_strength(cells: DataFrame) -> DataFrame:
    """One row: n_cells, n_a, n_b, n_total, strength, kept.

    strength is the share of the total sum of squares that additive marginal
    means (unweighted means of cell means) leave unexplained between cells;
    ``kept`` holds where the grid is full enough to tell.
    """
    m, r, c, g = F.col("mean"), F.avg("mean").over(W.partitionBy("a")), F.avg("mean").over(W.partitionBy("b")), F.avg("mean").over(W.partitionBy(F.lit(0)))
    whole = F.sum(F.col("n") * F.col("mean")).over(W.partitionBy(F.lit(0))) / F.sum("n").over(W.partitionBy(F.lit(0)))
    rows = cells.withColumn("off", F.col("n") * (m - (r + c - g)) * (m - (r + c - g))).withColumn("between", F.col("n") * (m - whole) * (m - whole))
    row = rows.agg(F.count("*").alias("n_cells"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"), F.sum("n").alias("n_total"), F.sum("off").alias("off"), (F.sum("between") + F.sum("m2")).alias("total"))
    full = F.col("n_cells") >= FULL_GRID * F.col("n_a") * F.col("n_b")
    kept = (F.col("n_cells") >= MIN_CELLS) & (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & full
    return row.select("n_cells", "n_a", "n_b", "n_total", F.try_divide("off", "total").alias("strength"), kept.alias("kept"))


def group_correlations(df: DataFrame, group: str, pairs: list[tuple[str, str]], least: int = MIN_GROUP) -> DataFrame:
    """(x, y, level, n, corr, slope) of every pair in every group; corr and slope null under ``least`` rows or without spread."""
    nums = sorted({n for p in pairs for n in p})
    rows = df.select(label(df, group).alias("_level"), *(finite(df, n).alias(n) for n in nums)).filter("_level is not null")
    out = None
    for at in range(0, len(pairs), CHUNK):
        stats = []
        for x, y in pairs[at : at + CHUNK]:
            n = F.regr_count(F.col(y), F.col(x))
            slope = F.try_divide(F.regr_sxy(F.col(y), F.col(x)), F.regr_sxx(F.col(y), F.col(x)))
            r = pearson(F.col(x), F.col(y))
            stats.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), n.alias("n"), F.when(n >= least, r).alias("corr"), F.when((n >= least) & r.isNotNull(), slope).alias("slope")))
        part = rows.groupBy(F.col("_level").alias("level")).agg(F.array(*stats).alias("s")).select("level", F.inline("s")).filter("n > 0")
        out = part if out is None else out.unionByName(part)
    return out.select("x", "y", "level", "n", "corr", "slope")


def slope_spread(found: DataFrame) -> DataFrame:
    """(x, y, n_groups, spread, n_min) over the groups that have a correlation."""
    return found.filter("corr is not null").groupBy("x", "y").agg(F.count("*").alias("n_groups"), (F.max("corr") - F.min("corr")).alias("spread"), F.min("n").alias("n_min")).filter("n_groups >= 2")


def dispersion_stats(df: DataFrame, cat: str, num: str) -> DataFrame:
    """Per level: n, std, iqr, mad, lo, hi, sum and M2 of the deviations from its median, rows in its outer tenths.

    Medians come of counted values; what is looked up by rows is one row per level.
    """
    rows = df.select(label(df, cat).alias("level"), finite(df, num).alias("v")).dropna()
    mid = ordered.quantiles(rows, ["level"], "v", {"mid": 0.5, "q1": 0.25, "q3": 0.75}).drop("n")
    mid = mid.join(rows.groupBy("level").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "level")
    rows = lookup(rows, mid, ["level"], F.col("v")).withColumn("dev", F.abs(F.col("v") - F.col("mid")))
    dev, wide = F.col("dev"), EDGE * (F.col("hi") - F.col("lo"))
    mad = ordered.quantiles(rows, ["level"], "dev", {"mad": 0.5}).drop("n")
    return (
        rows.groupBy("level")
        .agg(
            F.count("*").alias("n"),
            F.stddev_samp("v").alias("std"),
            F.min(F.col("q3") - F.col("q1")).alias("iqr"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum(dev).alias("dev_sum"),
            m2(dev).alias("dev_m2"),
            F.count_if(F.col("v") >= F.col("hi") - wide).alias("top_edge"),
            F.count_if(F.col("v") <= F.col("lo") + wide).alias("bottom_edge"),
        )
        .join(mad, "level")
    )


def resolution(df: DataFrame, num: str) -> DataFrame:
    """The smallest step between distinct finite values."""
    distinct = df.select(finite(df, num).alias("v")).filter("v is not null").distinct()
    steps = ordered.lagged(distinct, ["v"], "v").select((F.col("v") - F.col("before")).alias("step"))
    return steps.agg(F.min(F.when(F.col("step") > 0, F.col("step"))).alias("resolution"))


def lag1_autocorrelation(df: DataFrame, order: list[str], nums: list[str]) -> DataFrame:
    """(num, rho, n): correlation of every number with its value one row before."""
    rows = df.select(*order, F.struct(*(finite(df, n).alias(f"v{i}") for i, n in enumerate(nums))).alias("_v"))
    rows = ordered.lagged(rows, order, "_v", "_before")
    pair = lambda i: (F.col(f"_before.v{i}"), F.col(f"_v.v{i}"))
    stats = [F.struct(F.lit(n).alias("num"), pearson(*pair(i)).alias("rho"), F.regr_count(*pair(i)[::-1]).alias("n")) for i, n in enumerate(nums)]
    return rows.agg(F.array(*stats).alias("x")).select(F.inline("x"))


def correlation_tests(df: DataFrame, nums: list[str], order: list[str]) -> DataFrame:
    """(a, b, r, n, n_eff, t2): correlations with Bartlett's effective size and the squared t they give."""
    from plumbline.operators.profile import pearson_pairs

    rho = lag1_autocorrelation(df, order, nums)
    pairs = pearson_pairs(df, nums)
    pairs = pairs.join(F.broadcast(rho.select(F.col("num").alias("a"), F.col("rho").alias("ra"))), "a").join(F.broadcast(rho.select(F.col("num").alias("b"), F.col("rho").alias("rb"))), "b")
    both = F.coalesce(F.col("ra") * F.col("rb"), F.lit(0.0))
    n_eff = F.when(both > 0, F.least(F.col("n").cast("double"), F.greatest(F.lit(3.0), F.col("n") * (1 - both) / (1 + both)))).otherwise(F.col("n").cast("double"))
    t2 = F.try_divide(F.col("r") * F.col("r") * (n_eff - 2), 1 - F.col("r") * F.col("r"))
    return pairs.select("a", "b", "r", "n", n_eff.alias("n_eff"), t2.alias("t2"))


#: Identity forms: kind, operands, and the expression over them.
FORMS2 = {
    "product": lambda a, b: a * b,
    "sum": lambda a, b: a + b,
    "difference": lambda a, b: a - b,
    "ratio": lambda a, b: F.try_divide(a, b),
    "discounted": lambda a, b: a * (1 - b),
}
FORMS3 = {"triple_product": lambda a, b, c: a * b * c, "discounted_product": lambda a, b, c: a * b * (1 - c)}
SYMMETRIC = {"product", "sum"}


def identity_forms(target: str, peers: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Every form of two or three peers that may give ``target``, one per set where operands commute."""
    pool = [p for p in peers if p != target]
    out = [(k, pair) for k in FORMS2 for pair in (combinations(pool, 2) if k in SYMMETRIC else permutations(pool, 2))]
    out += [("triple_product", t) for t in combinations(pool, 3)]
    out += [("discounted_product", (*pair, c)) for c in pool for pair in combinations([p for p in pool if p != c], 2)]
    return out


def identity_matches(df: DataFrame, target: str, forms: list[tuple[str, tuple[str, ...]]], decimals: int) -> DataFrame:
    """(kind, components, n, matched): rows where a form is defined, and where it gives the target up to rounding."""
    nums = sorted({target, *(c for _, x in forms for c in x)})
    rows = df.select(*(finite(df, n).alias(n) for n in nums)).filter(F.col(target).isNotNull())
    t = F.col(target)
    slack = 1e-6 * F.abs(t) + 0.5 * 10.0**-decimals
    out = None
    for at in range(0, len(forms), CHUNK):
        stats = []
        for kind, x in forms[at : at + CHUNK]:
            value = (FORMS2 | FORMS3)[kind](*(F.col(c) for c in x))
            stats.append(F.struct(F.lit(kind).alias("kind"), F.lit(",".join(x)).alias("components"), F.count(value).alias("n"), F.count_if(F.abs(value - t) <= slack).alias("matched")))
        part = rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
        out = part if out is None else out.unionByName(part)
    return out


def decimals(df: DataFrame, num: str, most: int = 6) -> DataFrame:
    """The fewest decimals (up to ``most``) that write every finite value, as one row."""
    v = df.select(finite(df, num).alias("v")).filter("v is not null")
    off = [F.max(F.abs(F.col("v") * 10.0**k - F.round(F.col("v") * 10.0**k))).alias(f"d{k}") for k in range(most)]
    row = v.agg(*off)
    need = F.lit(most)
    for k in reversed(range(most)):
        need = F.when(F.col(f"d{k}") <= 1e-6 * 10.0**k + 1e-9, F.lit(k)).otherwise(need)
    return row.select(need.cast("long").alias("decimals"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: float = 0.05) -> DataFrame:
    """``tests`` with ``discovery`` by the step-up rule over all non-null p; a table of tests is one row per test."""
    ranked = tests.filter(F.col(p).isNotNull()).withColumn("_rank", F.rank().over(W.orderBy(p))).withColumn("_tied", F.count("*").over(W.partitionBy(p)))
    bound = ranked.agg(F.count("*").alias("_m")).crossJoin(ranked).filter(F.col(p) <= q * (F.col("_rank") + F.col("_tied") - 1) / F.col("_m")).agg(F.max(p).alias("_bound"))
    return tests.crossJoin(F.broadcast(bound)).withColumn("discovery", F.coalesce(F.col(p) <= F.col("_bound"), F.lit(False))).drop("_bound")

"""Queries over the tables of a scale-factor folder, with the SQL that gives the same rows.

Every query runs an operator of this package over whole tables.  ``fixed``
rounds a statistic off the grid of decimal ties, on which two engines may
differ; it belongs to these queries, not to the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import catalogue_decisions
from plumbline.catalogue_sql import SQL
from plumbline.functions.exprs import bucket, label
from plumbline.operators import charts, evidence, ordered, profile, sampling, structure, typing

OFF_GRID = 1.2345e-8
LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Registers ``f(read)`` under its name; ``read(table)`` reads a table."""
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return f


def fixed(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + OFF_GRID, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded by ``fixed``, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append((fixed(c, special.get(f.name, digits)) if kind in ("double", "float") else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)


# --- profiles and quality --------------------------------------------------------


@query
def profile_numeric(read):
    return rounded(profile.numeric_profile(read("lineitem"), LINE_NUMS), 5, skew=4)


@query
def profile_categorical_topk(read):
    return profile.top_categories(read("orders"), ["o_orderstatus", "o_orderpriority"], 10)


@query
def profile_category_lists(read):
    rows = profile.category_lists(read("lineitem"), LINE_CATS)
    return rows.select("column", "n_categories", F.array_join("labels", "|").alias("labels"))


@query
def profile_datetime_frequency(read):
    return rounded(profile.datetime_frequency(read("orders"), "o_orderdate"))


@query
def profile_text_lengths(read):
    return rounded(profile.text_lengths(read("documents"), ["text", "source"]))


def dirty(orders: DataFrame) -> DataFrame:
    """Prices as people write them: currencies, thousands, tokens and typing errors, by order key."""
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    raw = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 1, " N/A ")
        .when(k % 11 == 2, F.concat(F.lit("$"), plain))
        .when(k % 11 == 3, F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(k % 11 == 4, F.concat(plain, F.lit("%")))
        .when(k % 11 == 5, F.concat(plain, F.lit("kg")))
        .when(k % 11 == 6, "1,234.50")
        .when(k % 11 == 7, "-")
        .otherwise(plain)
    )
    return orders.select("o_orderkey", raw.alias("raw"))


@query
def quality_counts(read):
    return rounded(profile.quality_counts(dirty(read("orders")), "raw"))


@query
def cast_replay_numeric(read):
    rows = dirty(read("orders"))
    return typing.apply_casts(rows, {"raw": typing.Cast("numeric", None, True, True, True)}).select("o_orderkey", F.col("raw").alias("value"))


@query
def cast_replay_datetime(read):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format(d, "dd/MM/yyyy"))
    rows = typing.apply_casts(read("orders").select("o_orderkey", text.alias("raw")), {"raw": typing.Cast("datetime", "dd/MM/yyyy")})
    return rows.select("o_orderkey", F.col("raw").cast("string").alias("value"))


def spiked(events: DataFrame) -> DataFrame:
    return events.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.lit(99999.0)).otherwise(F.col("value")))


@query
def robust_fences(read):
    return rounded(profile.robust_fences(spiked(read("events")), "value"))


@query
def sentinel_candidates(read):
    return profile.sentinel_candidates(spiked(read("events")), "value")


@query
def semantic_types(read):
    spark, rows = None, []
    for table in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents", "labels"):
        df = read(table)
        spark = df.sparkSession
        rows += [(table, name, t.semantic, t.nominal, t.cast.target if t.cast else None) for name, t in typing.infer(df).items()]
    return spark.createDataFrame(rows, "table string, column string, semantic string, nominal boolean, cast string")


@query
def scan_csv(read):
    """A table written as CSV and loaded again."""
    from plumbline.sources import loader

    df = read("supplier")
    return loader.round_trip(df, "csv").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query
def preview(read):
    return read("customer").orderBy("c_custkey").limit(50)


# --- pairs of numbers --------------------------------------------------------------


@query
def pearson_matrix(read):
    return rounded(profile.pearson_pairs(read("lineitem"), LINE_NUMS))


@query
def spearman_matrix(read):
    return rounded(profile.spearman_pairs(read("lineitem"), LINE_NUMS))


@query
def average_rank(read):
    rows = ordered.average_ranks(read("part").select("p_partkey", "p_size"), "p_size")
    return rows.select("p_partkey", F.col("rank").cast("double").alias("rank"))


@query
def lag1_autocorr(read):
    return rounded(evidence.lag1_autocorrelation(read("events"), ["ts", "event_id"], ["value"]))


@query
def correlation_tests(read):
    rows = read("lineitem").withColumn("at", F.col("l_shipdate"))
    return rounded(evidence.correlation_tests(rows, LINE_NUMS, ["at", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]), 5, n_eff=2, t2=2)


@query
def near_duplicates(read):
    rows = read("lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 1.1 + 5).alias("price_usd"))
    found = profile.spearman_pairs(rows, ["l_quantity", "l_extendedprice", "price_usd"])
    return rounded(found.withColumn("copy", F.abs("r") >= 0.995))


@query
def derived_identities(read):
    rows = read("lineitem").select("l_extendedprice", "l_discount", "l_tax", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("disc_price"))
    forms = evidence.identity_forms("disc_price", ["l_extendedprice", "l_discount", "l_tax"])
    return evidence.identity_matches(rows, "disc_price", forms, 3)


@query
def decimals(read):
    df = read("lineitem")
    out = None
    for n in LINE_NUMS:
        row = evidence.decimals(df, n).select(F.lit(n).alias("column"), "decimals")
        out = row if out is None else out.unionByName(row)
    return out


# --- groups ------------------------------------------------------------------------


@query
def eta_squared_all(read):
    rows = evidence.eta_squared(read("lineitem"), LINE_CATS, LINE_NUMS)
    return rounded(rows.select("cat", "num", "n_groups", "n_total", "n_min", "eta_squared", "f_stat"), 6, f_stat=4)


@query
def time_effects(read):
    rows = evidence.time_effects(read("orders"), "o_orderdate", ["o_totalprice"], ("month", "year"))
    return rounded(rows.select(F.col("cat").alias("unit"), "num", "n_groups", "n_total", "n_min", "eta_squared", "f_stat"), 6, f_stat=4)


@query
def interaction_cells(read):
    df = read("lineitem")
    return rounded(evidence.interaction_cells(df, label(df, "l_returnflag"), label(df, "l_linestatus"), "l_extendedprice").select("a", "b", "n", "mean"), 5)


@query
def interaction_strength(read):
    df = read("lineitem")
    return rounded(evidence.interaction_strength(evidence.interaction_cells(df, label(df, "l_returnflag"), label(df, "l_linenumber"), "l_extendedprice")))


@query
def slope_by_group(read):
    return rounded(evidence.group_correlations(read("lineitem"), "l_returnflag", [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]), 5, slope=4)


@query
def slope_spread(read):
    found = evidence.group_correlations(read("lineitem"), "l_returnflag", [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return rounded(evidence.slope_spread(found), 5)


@query
def dispersion_stats(read):
    return rounded(evidence.dispersion_stats(read("events"), "event_type", "value"), 5, dev_sum=3, dev_m2=3)


@query
def bucket_edges(read):
    n = F.col("n_chars")
    band = F.when(n < 1000, "a").when(n < 3000, "b").otherwise("c")
    return rounded(evidence.dispersion_stats(read("documents").select("n_chars", band.alias("band")), "band", "n_chars").select("level", "n", "lo", "hi", "top_edge", "bottom_edge"))


@query
def value_resolution(read):
    return rounded(evidence.resolution(read("part"), "p_size"))


@query
def bh_discoveries(read):
    p = (F.pmod(F.col("n_nationkey") * 7, F.lit(25)) + 1) * F.lit(0.0015)
    return evidence.benjamini_hochberg(read("nation").select("n_nationkey", p.alias("p"))).select("n_nationkey", "discovery")


@query
def group_summary(read):
    return rounded(structure.group_summary(read("orders"), "o_orderpriority", "o_totalprice"), 4)


@query
def subgroup_anomalies(read):
    return rounded(structure.subgroup_anomalies(structure.group_summary(read("documents"), "source", "n_chars")), 4)


@query
def conditional_relationships(read):
    df = read("lineitem")
    pairs = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]
    return rounded(evidence.slope_spread(evidence.group_correlations(df, "l_linestatus", pairs)), 5)


@query
def group_time_pattern(read):
    rows = structure.group_time_pattern(read("events"), "ts", "event_type", "value", "day")
    return rounded(rows.withColumn("bucket", F.col("bucket").cast("string")), 5)


# --- shapes --------------------------------------------------------------------------


@query
def distribution_bins(read):
    return structure.distribution_bins(read("orders"), "o_totalprice")


@query
def distribution_summary(read):
    return rounded(structure.distribution_summary(read("orders"), "o_totalprice"), 4)


@query
def nonlinear_bins(read):
    return rounded(structure.nonlinear_bins(read("part"), "p_size", ["p_retailprice"]), 4, m2=2)


@query
def change_point_split(read):
    rows = structure.change_point(structure.bucket_series(read("events"), "ts", "value", "day"))
    return rounded(rows.withColumn("change_at", F.col("change_at").cast("string")), 5)


@query
def ks_pairs(read):
    return rounded(structure.ks_distances(read("events"), "event_type", "value"))


# --- charts --------------------------------------------------------------------------


@query
def line_month(read):
    rows = charts.line(read("orders"), "o_orderdate", "o_totalprice", "mean", "month")
    return rows.select(F.col("x").cast("string").alias("x"), fixed("y").alias("y"))


@query
def line_week(read):
    rows = charts.line(read("orders"), "o_orderdate", "o_totalprice", "mean", "week")
    return rows.select(F.col("x").cast("string").alias("x"), fixed("y").alias("y"))


@query
def line_grouped(read):
    rows = charts.line(read("events"), "ts", "value", "sum", "day", "event_type")
    return rows.select(F.col("x").cast("string").alias("x"), "series", fixed("y", 3).alias("y"))


@query
def bar_top_n(read):
    return charts.bar(read("part"), "p_name", None, "count", top=20).select("category", F.col("rank").cast("long").alias("rank"), "value")


@query
def bar_grouped_nulls(read):
    rows = charts.bar(read("part"), "p_brand", "p_retailprice", "mean", "p_type", 10)
    return rows.select("category", F.col("rank").cast("long").alias("rank"), "series", fixed("value", 5).alias("value"))


@query
def bar_median(read):
    rows = charts.bar(read("orders"), "o_orderpriority", "o_totalprice", "median")
    return rows.select("category", F.col("rank").cast("long").alias("rank"), fixed("value", 5).alias("value"))


@query
def histogram(read):
    return rounded(charts.histogram(read("lineitem"), "l_extendedprice"), 3)


@query
def histogram_grouped(read):
    return rounded(charts.histogram(read("lineitem"), "l_quantity", 12, "l_returnflag"), 3)


@query
def box_groups(read):
    return rounded(charts.box(read("orders"), "o_totalprice", "o_orderstatus"), 4)


@query
def heatmap_matrix(read):
    return rounded(charts.cells(read("lineitem"), "l_returnflag", "l_linenumber", "l_quantity", "mean"), 5)


@query
def kde_counts(read):
    return charts.density_counts(read("events"), "value", "event_type")


@query
def dot_interval(read):
    return rounded(charts.dot_interval(read("orders"), "o_orderpriority", "o_totalprice"), 4)


@query
def two_state(read):
    return rounded(charts.cells(read("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum"), 2)


@query
def hexbin(read):
    return charts.hexbin(read("lineitem"), "l_quantity", "l_extendedprice")


@query
def stacked_bar_percent(read):
    rows = charts.stacked(read("orders"), "o_orderpriority", None, "count", "o_orderstatus")
    return rows.select("category", F.col("rank").cast("long").alias("rank"), "series", "value", "total", fixed("percent").alias("percent"))


@query
def sankey_links(read):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read("events").withColumn("before", F.lag("event_type").over(w)).filter("before is not null")
    return charts.sankey(rows, "before", "event_type")


@query
def sankey_weighted(read):
    df = read("orders").withColumn("month", F.date_format("o_orderdate", "MM"))
    return rounded(charts.sankey(df, "month", "o_orderpriority", "o_totalprice", "sum"), 2)


@query
def scatter_sample(read):
    return sampling.exact_sample(charts.clean(read("lineitem"), ["l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice"]), 10_000).agg(F.count("*").alias("n"))


@query
def exact_sample(read):
    return sampling.exact_sample(read("lineitem"), 5000, 13).agg(F.count("*").alias("n"))


@query
def stride_sample(read):
    return charts.stride(read("part").select("p_partkey", "p_retailprice"), "p_partkey", 300)


@query
def gap_flags(read):
    hour = bucket(F.col("ts"), "hour").alias("x")
    rows = read("events").select(hour, F.col("event_type").alias("series")).distinct()
    found = charts.gap_flags(rows, "x", "series")
    return found.select("series", F.col("x").cast("string").alias("x"), "gap")


for _f in catalogue_decisions.QUERIES.values():
    query(_f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (SQL | catalogue_decisions.SQL).items() if k in _QUERIES}

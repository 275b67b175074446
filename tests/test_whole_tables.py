"""Decision queries on tables beyond the sample of a profile: all rows count, as in the SQL."""

import duckdb
import numpy as np
import pytest
from test_catalogue import rows

from plumbline import catalogue
from plumbline.operators.bounded import Rows
from plumbline.operators.robust import quality_of, quality_of_table
from plumbline.operators.whole import Whole

SF = "/root/testdata/sf0.01"
#: Copies of each table with shifted keys: over 100 000 rows, on which the shares of a sample differ from those of the table.
GROWN = {"events": ("event_id", 12), "part": ("p_partkey", 60), "lineitem": ("l_orderkey", 2)}


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The folder of the grown tables and a connection that has them as views."""
    folder, con = tmp_path_factory.mktemp("grown"), duckdb.connect()
    for t, (key, n) in GROWN.items():
        con.sql(f"COPY (SELECT * REPLACE ({key} + i * 1000003 AS {key}) FROM '{SF}/{t}.parquet', range({n}) r(i)) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["anomalous_groups", "chart_confidence", "curve_shapes", "mode_dominated", "probe_verdicts", "sentinel_verdicts"])
def test_query_on_more_rows_than_a_sample_has(spark, grown, name):
    folder, con = grown
    df = catalogue.queries()[name](spark, str(folder))
    want = con.sql(catalogue.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def near(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9) if isinstance(a, float) else a == b


@pytest.mark.parametrize("kind", ["spread", "spiked", "dominated", "dominated and spiked", "constant", "flat quartiles"])
def test_quality_of_a_table_is_that_of_its_values(spark, kind):
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(5, 2, 2000), 2)
    if "spiked" in kind:
        v[:9] = 9999.0
    if "dominated" in kind:
        v[200:1700] = 0.0
    if kind == "dominated and spiked":
        v[9:12], v[12:60] = -9999.0, 99999.0
    if kind == "constant":
        v[:] = 3.0
    if kind == "flat quartiles":
        v = np.r_[np.repeat([1.0, 2.0], 900), rng.normal(1.5, 50, 200)]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got, want = quality_of_table(df, "v"), quality_of(np.sort(v))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9) if isinstance(want[k], tuple) else near(got[k], want[k]), k


def test_quality_of_a_table_without_values(spark):
    assert quality_of_table(spark.createDataFrame([(None,)] * 9, "v double"), "v") is None


def test_reductions_of_a_table_are_those_of_its_rows(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    x, y, a, b = "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    some, every = Rows.of(df, [x, y], [a, b]), Whole.of(df, [x, y], [a, b])
    tables = [
        (some.moments(some.cats, [x, y]), every.moments(every.cats, [x, y])),
        (some.group_table(a, y), every.group_table(a, y)),
        (some.group_correlations(a, [(x, y)]), every.group_correlations(a, [(x, y)])),
        (some.cells(some.cats[a], some.cats[b], y), every.cells(every.cats[a], every.cats[b], y)),
        (some.curve_bins(x, [y], 10)[y], every.curve_bins(x, [y], 10)[y]),
        (some.distances(a, y, 30, 8), every.distances(a, y, 30, 8)),
    ]
    for want, got in tables:
        key = lambda r: str([v for v in r.values() if isinstance(v, str | int)])
        assert len(want) == len(got)
        for w, g in zip(sorted(want, key=lambda r: key(dict(sorted(r.items())))), sorted(got, key=lambda r: key(dict(sorted(r.items()))))):
            assert w.keys() == g.keys() and all(near(g[k], w[k]) for k in w)
    assert every.pearson([x, y])[x, y] == pytest.approx(some.pearson([x, y])[x, y])

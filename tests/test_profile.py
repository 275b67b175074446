import numpy as np
import pytest
from tables import groups, hourly, noise, outliers, sales

from plumbline.operators import curves, dependence
from plumbline.operators.profiler import profile_dataset
from plumbline.operators.robust import Counts, dominated
from plumbline.plans.model import Profile


@pytest.fixture(scope="module")
def profiles(spark):
    made = {}

    def of(make):
        if make not in made:
            made[make] = profile_dataset(spark.createDataFrame(make()), make.__name__)
        return made[make]

    return of


def pairs(rows, *keys):
    return {tuple(r[k] for k in keys) for r in rows}


def test_counts_and_statistics(profiles):
    p, raw = profiles(outliers), outliers()
    c = p.column("clean")
    assert c.stats["mean"] == pytest.approx(raw.clean.mean()) and c.stats["std"] == pytest.approx(raw.clean.std())
    assert c.stats["median"] == pytest.approx(raw.clean.median())
    assert c.stats["q25"] == pytest.approx(np.sort(raw.clean)[round(0.25 * 999)])
    assert p.column("team").n_categories == 2 and p.column("team").labels == ["a", "b"]


def test_sentinels_and_extremes(profiles):
    p = profiles(outliers)
    t = p.column("temperature").quality
    assert [(s["value"], s["count"]) for s in t.sentinels] == [(-999.0, 15)] and t.sentinel_rows == 15
    assert t.robust_range[0] > -50
    assert p.column("value").quality.extreme_count >= 10 and not p.column("value").quality.sentinels
    z = p.column("mostly_zero").quality
    assert z.concentration == "mode_dominated" and z.mode_share == pytest.approx(0.8, abs=0.05) and not z.sentinels
    assert not p.column("clean").quality.sentinels and p.column("clean").quality.extreme_count == 0


def test_mode_dominated_sentinels():
    values = [(0.0, 900), (9999.0, 20)] + [(float(i) / 10, 1) for i in range(1, 81)]
    out = dominated(Counts(values), 0.0, 0.0)
    assert [s["value"] for s in out["sentinels"]] == [9999.0] and out["concentration"] == "concentrated"
    assert dominated(Counts([(5.0, 100)]), 5.0, 0.0)["concentration"] == "constant"


def test_identities_and_copies(profiles):
    d = profiles(sales).evidence["derived"]
    assert [(x["target"], set(x["components"]), x["kind"]) for x in d] == [] or d[0]["target"] == "sales"
    h = profiles(hourly).evidence
    assert ("cnt", "sum") in pairs(h["derived"], "target", "kind")
    assert [(g["representative"], g["duplicates"]) for g in h["near_duplicates"]] == [("temp", ["atemp"])]
    assert dependence.related_names("temp", "atemp") and dependence.related_names("price", "price_usd") and not dependence.related_names("hum", "temp")


def test_planted_effects(profiles):
    e = profiles(groups).evidence
    found = {(m["cat"], m["num"]): m for m in e["cat_num"]}
    assert found["team", "shifted"]["eta_squared"] > 0.9 and found["team", "shifted"]["discovery"]
    assert found["team", "x"]["eta_squared"] < 0.02
    spread = {(m["cat"], m["num"]): m for m in e["dispersion"]}
    assert spread["team", "spread"]["strength"] == "strong" and spread["team", "spread"]["widest"] == "c"
    assert ("team", "x") not in spread
    mix = {frozenset((m["cat1"], m["cat2"])): m for m in e["interactions"] if m["num"] == "mixed"}
    assert mix[frozenset(("team", "state"))]["strength"] > 0.5 and mix[frozenset(("team", "state"))]["p_value"] < 1e-6
    bent = {(m["x"], m["y"]): m for m in e["nonlinear"]}
    assert bent["x", "curved"]["shape"] == "u_shape" and bent["x", "curved"]["p_value"] < 1e-6
    flips = {(frozenset((m["x"], m["y"])), m["group"]): m for m in e["conditional"]}
    assert flips[frozenset(("x", "slope")), "team"]["corr_spread"] > 1.5
    steps = {m["num"]: m for m in e["change_points"]}
    assert steps["stepped"]["flagged"] and steps["stepped"]["effect_size"] > 2 * steps["x"]["effect_size"]


def test_noise_has_few_discoveries(profiles):
    assert profiles(noise).fdr["discoveries"] <= 1 and profiles(noise).fdr["m"] > 40


def test_json_round_trip(profiles):
    p = profiles(groups)
    q = Profile.from_json(p.to_json())
    assert q.columns == p.columns and q.pearson.keys() == p.pearson.keys() and q.fdr == p.fdr
    for bad in ("{}", "[]", "nonsense", '{"version": 99}'):
        with pytest.raises(ValueError):
            Profile.from_json(bad)


def test_sampling_keeps_full_counts(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 7 as string) as g", "if(id % 3 = 0, null, cast(id as double)) as v")
    p = profile_dataset(df, threshold=500)
    assert (p.n_rows, p.profiled_rows) == (3000, 500) and p.column("v").missing_count == 1000
    again = profile_dataset(df.repartition(5), threshold=500)
    assert again.column("v").stats["n"] == p.column("v").stats["n"]


def test_tiny_and_empty(spark):
    p = profile_dataset(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"))
    assert p.n_rows == 2
    assert profile_dataset(spark.createDataFrame([], "x int, y string")).n_rows == 0


def test_curve_helpers():
    assert curves.hills([0.3, 0.05, 0.3, 0.05, 0.3], 0.1, 0.6, True) == 3
    assert curves.hills([0.3, 0.28, 0.3], 0.1, 0.6, True) == 1
    assert curves.Shape(1, 1, [1, 2, 1.98, 3]).one_way and curves.Shape(1, 1, [3, 2, 2.02, 1]).one_way and not curves.Shape(1, 1, [1, 3, 1]).one_way
    c, vertex = curves.bend([4, 1, 0, 1, 4])
    assert c == pytest.approx(1) and vertex == pytest.approx(2)
    assert curves.thin(5) == [0, 1, 2, 3, 4] and len(curves.thin(100)) == 24
    assert curves.best_split([(i, 0.0 if i < 6 else 9.0 + i % 2, 1) for i in range(12)])[0] == 6
    assert curves.best_split([(i, 1.0, 1) for i in range(12)]) is None


def test_brown_forsythe_null_rate():
    """Equal spreads are called strong at most a little over 5 % of the time."""
    rng, hits = np.random.default_rng(7), 0
    for _ in range(200):
        rows = []
        for level in "abc":
            v = rng.normal(size=30)
            dev = np.abs(v - np.median(v))
            rows.append({"level": level, "n": 30, "std": v.std(ddof=1), "iqr": np.subtract(*np.percentile(v, [75, 25])), "mad": np.median(dev), "lo": v.min(), "hi": v.max(), "dev_sum": dev.sum(), "dev_m2": ((dev - dev.mean()) ** 2).sum(), "top_edge": 1, "bottom_edge": 1})
        entry = dependence._compare(rows, True)
        hits += entry is not None and entry["strength"] == "strong"
    assert hits / 200 <= 0.075

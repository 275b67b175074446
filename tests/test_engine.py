import json
import threading
import zipfile

import pytest
from tables import groups, hourly, noise, outliers, sales

from plumbline.engine import Engine
from plumbline.operators import probes, profiler, render
from plumbline.plans import recommend as rec
from plumbline.plans.confidence import assess, excluded
from plumbline.plans.model import Spec
from plumbline.plans.roles import in_order, role_of
from plumbline.plans.spec import TYPES, validate
from plumbline.sources import loader, store


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def keys(spark, engine):
    return {f.__name__: engine.save(spark.createDataFrame(f()), f.__name__)["dataset_id"] for f in (sales, noise, hourly, groups, outliers)}


# --- recommendations ------------------------------------------------------------------


def test_noise_has_no_top_chart(engine, keys):
    assert all(r.tier != "top" for r in engine.recommend(keys["noise"])["recommendations"])


def test_definitions_are_never_top(engine, keys):
    for name in ("sales", "hourly"):
        for r in engine.recommend(keys[name])["recommendations"]:
            if frozenset((r.spec.x, r.spec.y)) in rec.Evidence(engine.profile(keys[name])).definition:
                assert r.tier == "exploratory" and "definition" in " ".join(w["message"] for w in r.warnings)


def test_planted_findings_lead(engine, keys):
    got = engine.recommend(keys["groups"])["recommendations"]
    top = {(r.spec.x, r.spec.y) for r in got if r.tier == "top"}
    assert ("team", "shifted") in top
    assert any(r.intent == "distribution_by_group" and r.spec.y == "spread" for r in got)
    assert any(r.intent == "two_state_comparison" and r.spec.y == "mixed" for r in got)


def test_copies_and_cycles(engine, keys):
    got = engine.recommend(keys["hourly"])["recommendations"]
    assert all(r.spec.y != "atemp" and r.spec.x != "atemp" for r in got)
    assert any(r.intent == "cyclic_pattern" and r.spec.x == "hr" for r in got)


def test_lists_are_short_valid_and_deterministic(engine, keys):
    for key in keys.values():
        p = engine.profile(key)
        a, b = rec.recommend(p), rec.recommend(p)
        assert len(a) <= 12 and [r.spec for r in a] == [r.spec for r in b]
        assert all(not validate(s, p) for r in a for s in (r.spec, *r.alternatives))
        assert [r.score for r in a] == sorted((r.score for r in a), reverse=True)
        assert sum(r.tier == "top" for r in a) <= 3


def test_sentinels_lower_confidence(engine, keys):
    p = engine.profile(keys["outliers"])
    confidence, warnings, cap = assess(Spec("histogram", "temperature"), p)
    assert cap == "secondary" and confidence["robustness"] == 0.6 and [w["code"] for w in warnings] == ["suspected_sentinel"]
    assert assess(Spec("histogram", "clean"), p)[0]["overall"] == 1.0
    assert excluded(p) == []


@pytest.mark.parametrize("a, b, ends", [("from_city", "to_city", ("from_city", "to_city")), ("dst", "src", ("src", "dst")), ("status_next", "status_prev", ("status_prev", "status_next")), ("city", "town", None), ("from_city", "to_town", None)])
def test_flow_names(a, b, ends):
    assert rec.flow_direction(a, b) == ends


def test_suggested_charts(engine, keys):
    p = engine.profile(keys["groups"])
    assert rec.score_spec(Spec("bar", "team", "shifted", aggregation="mean"), p)[1] == "strong"
    assert rec.score_spec(Spec("bar", "team", "x", aggregation="mean"), p)[1] == "weak"
    assert rec.score_spec(Spec("heatmap"), p) == (0.65, "neutral")
    assert rec.reselect(Spec("violin", "team", "spread"), p)[2] == "distribution_by_group"
    assert rec.reselect(Spec("rose", "team", "shifted", aggregation="mean"), p)[0].type != "rose"
    h = engine.profile(keys["hourly"])
    assert rec.canonical(Spec("scatter", "atemp", "hum"), h) == (Spec("scatter", "temp", "hum"), ["atemp -> temp"])
    assert rec.canonical(Spec("scatter", "temp", "atemp"), h)[0] is None


# --- specifications and rendering --------------------------------------------------------


def test_every_violation_is_listed(engine, keys):
    p = engine.profile(keys["groups"])
    errors = validate(Spec("line", "team", "team", "gone", bins=3, percent=True), p)
    assert len(errors) >= 4
    assert validate(Spec("pie"), p) == ["unknown chart type 'pie'"]
    assert validate(Spec("rose", "team", "x", aggregation="mean"), p)
    assert validate(Spec("histogram", "x", bins=400), p) == ["bins must be within 5..200"]
    assert validate(Spec("raincloud", "team", "x"), p) == []


SPECS = {
    "line": Spec("line", "ts", "x", aggregation="mean", time_granularity="day"),
    "bar": Spec("bar", "team", "shifted", "state", "mean"),
    "lollipop": Spec("lollipop", "team", aggregation="count"),
    "scatter": Spec("scatter", "x", "slope", "team"),
    "histogram": Spec("histogram", "x", group_by="team", bins=12),
    "box": Spec("box", "team", "spread"),
    "violin": Spec("violin", None, "spread"),
    "raincloud": Spec("raincloud", "team", "spread"),
    "ridgeline": Spec("ridgeline", "team", "spread"),
    "dot_interval": Spec("dot_interval", "team", "shifted"),
    "dumbbell": Spec("dumbbell", "team", "mixed", "state", "mean"),
    "slopegraph": Spec("slopegraph", "team", "mixed", "state", "mean"),
    "hexbin": Spec("hexbin", "x", "curved"),
    "stacked_bar": Spec("stacked_bar", "team", None, "state", "count", percent=True),
    "sankey": Spec("sankey", "team", None, "state", "count"),
    "heatmap": Spec("heatmap", "team", "mixed", "state", "mean"),
}


@pytest.mark.parametrize("kind", sorted(SPECS))
def test_render(engine, keys, kind):
    out = engine.render(keys["groups"], SPECS[kind])
    assert out["n_points"] > 0
    json.dumps(out["chart_data"])


def test_render_values(engine, keys):
    raw = groups()
    out = engine.render(keys["groups"], SPECS["bar"])["chart_data"]
    assert out["categories"] == ["c", "b", "a"] and [s["name"] for s in out["series"]] == ["after", "before"]
    want = raw[(raw.team == "b") & (raw.state == "after")].shifted.mean()
    assert out["series"][0]["values"][1] == pytest.approx(want)
    two = engine.render(keys["groups"], SPECS["dumbbell"])["chart_data"]
    assert two["states"] == ["before", "after"]
    assert sum(engine.render(keys["groups"], SPECS["histogram"])["chart_data"]["bins"]["counts"]) == len(raw)
    box = {g["name"]: g for g in engine.render(keys["groups"], SPECS["box"])["chart_data"]["groups"]}
    assert box["c"]["median"] == pytest.approx(raw[raw.team == "c"].spread.median())
    stacked = engine.render(keys["groups"], SPECS["stacked_bar"])["chart_data"]
    assert all(sum(s["values"][i] for s in stacked["series"]) == pytest.approx(100) for i in range(3))
    rain = engine.render(keys["groups"], SPECS["raincloud"])
    assert rain["sampled"] and all(len(g["points"]) == 200 and max(g["density"]) == 1.0 for g in rain["chart_data"]["groups"])
    polar = engine.render(keys["hourly"], Spec("polar_line", "hr", "cnt", aggregation="mean"))["chart_data"]
    assert polar["categories"] == list(range(24))
    assert engine.render(keys["hourly"], Spec("heatmap"))["chart_data"]["matrix"][0][0] == 1.0


def test_display_range_is_disclosed(engine, keys):
    out = engine.render(keys["outliers"], Spec("histogram", "temperature"))
    assert out["display_range"]["excluded_below"] == 15 and sum(out["chart_data"]["bins"]["counts"]) == 985


def test_long_line_is_coarsened(spark, engine):
    df = spark.range(12000).selectExpr("timestamp_seconds(1700000000 + id * 600) as ts", "rand(1) as v", "id")
    key = engine.save(df)["dataset_id"]
    out = engine.render(key, Spec("line", "ts", "v"))
    assert out["spec"].time_granularity == "day" and out["spec"].aggregation == "mean" and out["n_points"] < 100


def test_invalid_specs_raise(engine, keys):
    with pytest.raises(render.RenderError) as e:
        engine.render(keys["groups"], Spec("bar", "x", "gone"))
    assert len(e.value.errors) >= 2


# --- probes --------------------------------------------------------------------------------------


def ask(kind, **columns):
    return {"type": kind, "columns": columns}


@pytest.mark.parametrize(
    "request_, verdict",
    [
        (ask("group_difference", group="team", target="shifted"), "pass"),
        (ask("group_difference", group="team", target="x"), "fail"),
        (ask("slope_difference", x="x", y="slope", group="team"), "pass"),
        (ask("grouped_relationship", x="x", y="slope", group="team"), "fail"),
        (ask("nonlinear_relationship", x="x", y="curved"), "pass"),
        (ask("nonlinear_relationship", x="x", y="shifted"), "fail"),
        (ask("distribution_difference", group="team", target="spread"), "pass"),
        (ask("distribution_difference", group="state", target="x"), "fail"),
        (ask("time_pattern", time="ts", target="stepped", group="team"), "pass"),
        (ask("time_pattern", time="ts", target="x"), "fail"),
        (ask("interaction", factor1="team", factor2="state", target="mixed"), "pass"),
        (ask("interaction", factor1="team", factor2="state", target="shifted"), "fail"),
    ],
)
def test_probe(engine, keys, request_, verdict):
    (out,) = engine.probe(keys["groups"], [request_])
    assert out.verdict == verdict, out
    assert (out.p_value is None or out.p_value < 1e-4) if verdict == "pass" else True
    json.loads(probes.as_json(out))


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "group_difference", "columns": {"group": "team", "target": "x"}, "sql": "drop"},
        ask("unknown", group="team"),
        ask("group_difference", group="team"),
        ask("group_difference", group="team", target="team"),
        ask("group_difference", group="x", target="shifted"),
        ask("group_difference", group="team", target="gone"),
        ask("time_pattern", time="team", target="x"),
        ask("group_difference", group="team", target=""),
        "text",
    ],
)
def test_bad_requests_are_rejected(engine, keys, bad):
    (out,) = engine.probe(keys["groups"], [bad])
    assert isinstance(out, probes.Rejected) and out.reason


def test_probe_caps_and_repeats(engine, keys):
    asked = [ask("group_difference", group=g, target=t) for g in ("team", "state") for t in ("x", "shifted", "spread")]
    out = engine.probe(keys["groups"], [asked[0], *asked])
    assert len(out) == 6 and isinstance(out[-1], probes.Rejected) and out[-1].reason.startswith("cap")
    (copy,) = engine.probe(keys["hourly"], [ask("nonlinear_relationship", x="atemp", y="hum")])
    assert "near-duplicate" in copy.reason


def test_directions():
    assert probes.directions([0.5, 0.3]) == {"direction": "positive", "same_sign": True}
    assert probes.directions([0.5, -0.3])["direction"] == "mixed" and probes.directions([0.05])["direction"] == "none"
    assert not probes.directions([0.5, 0.05])["same_sign"]


# --- store, profiles, loader ------------------------------------------------------------------------


def test_catalog(spark, engine, keys):
    assert {m["dataset_id"] for m in engine.list()} >= set(keys.values())
    assert engine.store.meta(keys["sales"])["n_rows"] == 1000 and len(engine.preview(keys["sales"], 0)) == 1
    for bad in ("x", "0" * 32, "../" + "0" * 29):
        with pytest.raises(store.NotFound):
            engine.store.meta(bad)
    gone = engine.save(spark.range(3))["dataset_id"]
    engine.store.drop(gone)
    with pytest.raises(store.NotFound):
        engine.store.frame(gone)


def test_profile_is_computed_once_and_recovers(spark, engine, monkeypatch):
    key = engine.save(spark.range(100).selectExpr("id", "rand(3) as v"))["dataset_id"]
    calls = []
    real = profiler.profile_dataset
    monkeypatch.setattr("plumbline.engine.profile_dataset", lambda *a: calls.append(1) or real(*a))
    threads = [threading.Thread(target=engine.profile, args=(key,)) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(calls) == 1
    fresh = Engine(spark, engine.store.root.path)
    fresh.profile(key)
    assert len(calls) == 1
    engine.store.publish_profile(key, "broken")
    Engine(spark, engine.store.root.path).profile(key)
    assert len(calls) == 2 and engine.store.root.names("_drafts") == []


def test_files_are_published_whole_and_once(spark, tmp_path):
    from plumbline.sources.files import Folder

    folder = Folder(spark, f"file://{tmp_path}")
    assert folder.publish("a/x", "one") and not folder.publish("a/x", "two") and folder.read("a/x") == "one"
    assert folder.publish("a/x", "three", replace=True) and folder.read("a/x") == "three" and folder.size("a/x") == 5
    assert folder.names("a") == ["x"] and folder.names("none") == [] and folder.names("_drafts") == []
    folder.delete("a")
    assert not folder.exists("a/x")


def test_large_tables_are_not_kept_in_memory(spark, tmp_path, monkeypatch):
    small = store.Store(spark, f"file://{tmp_path}/s")
    assert small.frame(small.save(spark.range(10), "t")["dataset_id"]).is_cached
    monkeypatch.setattr(store, "CACHED_BYTES", 1)
    assert not small.frame(small.save(spark.range(10), "u")["dataset_id"]).is_cached


def test_uploads_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BYTES", 10)
    with pytest.raises(loader.TooLarge):
        store.Store(spark, str(tmp_path / "u")).upload(write(tmp_path / "big.csv", "a,b\n1,2\n3,4\n"))


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv(spark, tmp_path):
    df = loader.load(spark, write(tmp_path / "a.CSV", "ts,city,value\n2024-01-02,Rome,1.5\n2024-01-03,,2\n"))
    assert dict(df.dtypes) == {"ts": "date", "city": "string", "value": "double"} and df.filter("city is null").count() == 1
    assert loader.load(spark, write(tmp_path / "l.csv", "a,b\ncaf\xe9,1\n".encode("latin-1"))).count() == 1
    df = loader.load(spark, write(tmp_path / "d.csv", "a,a,,b\n1,2,3,4\n"))
    assert len(set(df.columns)) == 4 and df.columns[0] == "a"
    df = loader.load(spark, write(tmp_path / "q.csv", 'a,b\n"x, ""y""\nz",2\n'))
    assert df.first()[0] == 'x, "y"\nz'


@pytest.mark.parametrize("name, data, message", [("e.csv", "", "empty"), ("h.csv", "a,b\n", "header"), ("n.txt", "a", "unsupported"), ("c.parquet", "no parquet", "Parquet"), ("w.xlsx", "no zip", "workbook")])
def test_load_errors_differ(spark, tmp_path, name, data, message):
    with pytest.raises(loader.LoadError, match=message):
        loader.load(spark, write(tmp_path / name, data))


def test_xlsx(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>pop</t></is></c><c r="D1" t="str"><v>ok</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c><c r="D2" t="b"><v>1</v></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>city</t></si><si><r><t>Ro</t></r><r><t>me</t></r></si></sst>')
    df = loader.load(spark, str(path))
    assert df.columns == ["city", "pop", "column_3", "ok"] and [tuple(r) for r in df.collect()] == [("Rome", 5, None, True), (None, 7, None, None)]


@pytest.mark.parametrize("names, out", [(["a", "a", ""], ["a", "a_2", "column_3"]), (["a", "a", "a_2"], ["a", "a_3", "a_2"]), ([None, " x "], ["column_1", "x"])])
def test_unique_names(names, out):
    assert loader.unique_names(names) == out


def test_roles(engine, keys):
    p = engine.profile(keys["hourly"])
    hr = role_of(p.column("hr"))
    assert hr.cyclic and hr.period == 24
    s = role_of(engine.profile(keys["groups"]).column("state"))
    assert s.role == "ordinal" and s.order == ("before", "after") and s.two_state
    assert in_order(["Mar", "Jan"], None) == ["Jan", "Mar"]
    assert set(TYPES) == set(render.TYPES)

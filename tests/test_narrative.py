import pytest
from hypothesis import given
from hypothesis import strategies as st
from tables import groups

from plumbline.engine import Engine
from plumbline.narrative import provider as prov
from plumbline.narrative.claims import claim_of, sentence
from plumbline.narrative.coverage import uncorroborated
from plumbline.narrative.prompts import describe
from plumbline.narrative.verify import problems
from plumbline.narrative.workflow import Narrator, implied
from plumbline.plans.model import Spec

MEANS = claim_of("group_difference", {"group": "team", "target": "score"}, {"groups": [{"level": "red", "mean": 9.04}, {"level": "blue", "mean": 4.0}, {"level": "green", "mean": 0.02}]}, 0.91)
SLOPES = claim_of("grouped_relationship", {"x": "price", "y": "units", "group": "team"}, {"groups": [{"level": "red", "corr": 0.8}, {"level": "blue", "corr": 0.7}]}, 0.7, -0.3)
FLIPS = claim_of("slope_difference", {"x": "price", "y": "units", "group": "team"}, {"groups": [{"level": "red", "corr": 0.8}, {"level": "blue", "corr": -0.7}]}, 1.5)
STEP = claim_of("time_pattern", {"time": "day", "target": "units"}, {"change_point": {"strength": "strong", "before_mean": 1.5, "after_mean": 4.5, "change_at": "2024-03-01T00:00:00"}}, 0.5)


def test_sentences():
    assert sentence(MEANS) == "Mean score is highest for team red (9.04) and lowest for team green (0.02)."
    assert "within each of the 2 team groups" in sentence(SLOPES) and sentence(SLOPES).endswith("points the other way.")
    assert "opposite directions in team blue (r = -0.7)" in sentence(FLIPS)
    assert sentence(STEP) == "Mean units rises from 1.5 to 4.5 around 2024-03-01."


@pytest.mark.parametrize(
    "text, claim",
    [
        ("The average score is highest for team red (9.04) and lowest for team green.", MEANS),
        ("Average score differs between the team groups; red is higher than blue.", MEANS),
        ("units rises with price in every team.", SLOPES),
        ("The relationship between price and units is in opposite directions across team groups.", FLIPS),
        ("Mean units increased from 1.5 to 4.5 around 2024-03-01.", STEP),
        ("Average score is 9.04 for team red, 4 for blue and 0.02 for green.", MEANS),
        ("9.04 is the average score of team red; that of team green is 0.02.", MEANS),
        ("units rises with price in all team groups: red (0.80) and blue (0.70).", SLOPES),
        ("units consistently rises with price across the team groups.", SLOPES),
    ],
)
def test_supported_texts(text, claim):
    assert problems(text, claim) == []


@pytest.mark.parametrize(
    "text, claim",
    [
        ("The average score is highest for team blue.", MEANS),
        ("blue is higher than red.", MEANS),
        ("Being in team red causes a high score.", MEANS),
        ("Average score is 12 for team red.", MEANS),
        ("Every team differs.", MEANS),
        ("The score of team purple is high.", MEANS),
        ("score is not different.", MEANS),
        ("units falls with price in every team.", SLOPES),
        ("units rises with price in every team.", FLIPS),
        ("Mean units decreased from 4.5 to 1.5.", STEP),
        ("Mean units increased around 2024-04-01.", STEP),
        ("Der Wert steigt.", STEP),
        ("units ↑ 📈", STEP),
        ("", STEP),
        ("Management should raise prices.", SLOPES),
        # The right number beside the wrong group, or beside none.
        ("Average score is 9.04 for team blue.", MEANS),
        ("Average score: team red 4.0, team blue 9.04.", MEANS),
        ("Average score is highest for team red (4.0).", MEANS),
        ("Average score is 9.04.", MEANS),
        ("units rises with price in team red (r = 0.7) and team blue (r = 0.8).", SLOPES),
        ("units rises with price in team red and in opposite directions in team blue (0.8).", FLIPS),
        # Universals about anything but the groups.
        ("units rises with price in all rows.", SLOPES),
        ("units always rises with price.", SLOPES),
        ("units rises with price everywhere, in any period.", SLOPES),
        ("units rises with price in all values of the data.", SLOPES),
        # A number of another kind, order and negation in disguise.
        ("Average score is 904% for team red.", MEANS),
        ("Average score of team red is about 9.05.", MEANS),
        ("Average score of team green is above team blue.", MEANS),
        ("Mean units increased from 4.5 to 1.5, not down.", STEP),
    ],
)
def test_unsupported_texts(text, claim):
    assert problems(text, claim)


@pytest.mark.parametrize("claim", [MEANS, SLOPES, FLIPS, STEP])
def test_numbers_of_templates_stand_beside_their_groups(claim):
    assert not [p for p in problems(sentence(claim), claim) if "number" in p or "about the groups" in p]


@given(st.text(alphabet=st.characters(codec="utf-8"), min_size=1, max_size=60))
def test_random_text_is_refused_unless_made_of_known_words(text):
    if not problems(text, MEANS):
        assert all(ord(c) < 128 or c in "’−–—" for c in text)


class Fake:
    identity = ("fake",)
    may_see_values = False

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def complete(self, messages):
        self.seen.append(messages)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("narrative")))


@pytest.fixture(scope="module")
def key(spark, engine):
    return engine.save(spark.createDataFrame(groups()))["dataset_id"]


def h(test, importance=3, statement="a claim", **columns):
    return {"statement": statement, "test": test, "columns": columns, "importance": importance}


def test_workflow(engine, key):
    proposals = [
        h("group_difference", 5, group="team", target="shifted"),
        h("distribution_difference", 4, group="team", target="spread"),
        h("group_difference", 4, group="team", target="x"),
        h("group_difference", 4, group="team", target="shifted"),
        h("group_difference", 4, "sales_total differs", group="team", target="shifted"),
        h("nonlinear_relationship", 1, x="x", y="curved"),
        "nonsense",
    ]
    fake = Fake({"hypotheses": proposals, "charts": [{"type": "box", "x": "team", "y": "spread"}, {"type": "pie"}]}, {"insights": [{"id": 1, "text": "Average shifted is highest for team c."}, {"id": 2, "text": "team c drives everything."}]})
    report = Narrator(engine, fake).report(key)
    got = {f.id: f for f in report.insights}
    assert set(got) == {1, 2} and got[1].source == "evidence" and got[2].source == "probe"
    assert got[1].text == "Average shifted is highest for team c." and got[2].text.startswith("Median spread")
    why = dict(report.dropped)
    assert "fails" in why[3] and "same test" in why[4] and "unknown columns" in why[5] and "cap" in why[6]
    assert len(report.recommendations) <= 12


def test_the_largest_of_many_comparisons_needs_another_sign(engine, key):
    p = engine.profile(key)
    slopes = lambda *r: {"groups": [{"level": str(i), "corr": x} for i, x in enumerate(r)]}
    assert uncorroborated("slope_difference", {}, "pass", slopes(0.2, -0.2), p) and uncorroborated("slope_difference", {}, "pass", {}, p)
    assert uncorroborated("slope_difference", {}, "pass", slopes(0.5, -0.2, None), p) is None
    weak = {"group": "team", "target": "x"}
    assert uncorroborated("distribution_difference", weak, "weak", {}, p) and uncorroborated("distribution_difference", weak, "pass", {}, p) is None
    assert uncorroborated("distribution_difference", {"group": "team", "target": "shifted"}, "weak", {}, p) is None
    assert uncorroborated("group_difference", weak, "weak", {}, p) is None


def test_recommendations_with_and_without_a_provider(engine, key, monkeypatch):
    fake = Fake({"hypotheses": ["nonsense", h("group_difference", group="team", target="x")], "charts": []}, {})
    n = Narrator(engine, fake)
    assert n.recommendations(key, llm=False) == engine.recommend(key) | {"insights": []} and not fake.seen
    got = n.recommendations(key, debug=True)
    assert set(got) == {"recommendations", "warnings", "insights", "debug"} and got["debug"]["dropped"]
    assert "debug" not in n.recommendations(key) and len(fake.seen) == 1
    monkeypatch.setattr("plumbline.narrative.workflow.VERSION", 99)
    fake.answers += [{}, {}]
    n.report(key)
    assert len(fake.seen) == 2  # another version of the prompts is another report


def test_failures_fall_back(engine, key):
    report = Narrator(engine, Fake(prov.ProviderError("timeout"))).report(key)
    assert report.message and not report.insights and report.recommendations
    assert [r.spec for r in Narrator(engine).report(key).recommendations] == [r.spec for r in engine.recommend(key)["recommendations"]]
    fake = Fake({"hypotheses": [h("distribution_difference", group="team", target="spread")]}, prov.ProviderError("timeout"))
    report = Narrator(engine, fake).report(key)
    assert report.insights[0].text.startswith("Median spread")


def test_reports_are_kept(engine, key):
    fake = Fake({}, {})
    n = Narrator(engine, fake)
    assert n.report(key) is n.report(key) and len(fake.seen) == 1
    n.report(key, refresh=True)
    assert len(fake.seen) == 2


def test_implied_tests(engine, key):
    p = engine.profile(key)
    assert implied(Spec("bar", "team", "x"), p)[0] == "group_difference" and implied(Spec("box", "team", "x"), p)[0] == "distribution_difference"
    assert implied(Spec("line", "ts", "x"), p)[0] == "time_pattern" and implied(Spec("histogram", "x"), p) == (None, {})


def test_privacy(engine, key):
    assert prov.is_loopback("http://127.0.0.1:1/v1") and prov.is_loopback("http://[::1]/") and prov.is_loopback("http://localhost")
    assert not prov.is_loopback("http://192.168.0.2/") and not prov.is_loopback("https://example.com")
    assert not prov.ChatCompletions("https://example.com", "m").may_see_values
    assert "examples" not in str(describe(engine.profile(key), False)) and "examples" in str(describe(engine.profile(key), True))


def test_json_in_answers():
    assert prov.find_json('```json\n{"a": 1}\n```') == {"a": 1} and prov.find_json('Sure! {"a": {"b": 2}} done') == {"a": {"b": 2}}
    for bad in ("", "[1]", "no"):
        with pytest.raises(ValueError):
            prov.find_json(bad)
    with pytest.raises(prov.ProviderError, match="misconfigured"):
        prov.ChatCompletions().complete([])


def test_a_probe_without_a_p_value_is_no_finding_and_loosens_nothing(engine, key, monkeypatch):
    from plumbline.narrative import workflow
    from plumbline.operators.probes import Result

    def answer(p):
        return Result("distribution_difference", {}, "pass", 0.5, "", 100, 50, p, (0.25, 0.12), {"groups": []}, {"overall": 1.0})

    asked = [h("distribution_difference", 5, group="team", target="spread"), h("distribution_difference", 4, group="state", target="spread")]
    seen = []
    monkeypatch.setattr(engine, "probe", lambda key, requests: [answer(None), answer(0.03)])
    monkeypatch.setattr(workflow.tails, "holm", lambda p, alpha: seen.append(list(p)) or [x <= alpha / len(p) for x in p])
    report = Narrator(engine, Fake({"hypotheses": asked}, {})).report(key, refresh=True)
    assert seen == [[0.03]] and [f.id for f in report.insights] == [2]
    assert dict(report.dropped)[1] == "not significant among the probes of this run"

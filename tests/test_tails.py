import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from plumbline.functions import tails


@pytest.mark.parametrize("f, d1, d2", [(4.001, 1, 60), (3.150, 2, 60), (2.290, 5, 120), (4.965, 1, 10), (2.603, 5, 25), (3.101, 2, 87)])
def test_f_five_percent_points(f, d1, d2):
    assert tails.f_tail(f, d1, d2) == pytest.approx(0.05, abs=2e-4)


@pytest.mark.parametrize("x, df", [(3.841, 1), (5.991, 2), (11.070, 5), (31.410, 20), (124.342, 100)])
def test_chi2_five_percent_points(x, df):
    assert tails.chi2_tail(x, df) == pytest.approx(0.05, abs=2e-4)


def test_edges_and_other_tails():
    assert tails.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.f_tail(0, 1, 1) == 1.0 and tails.f_tail(math.inf, 2, 5) == 0.0 and tails.chi2_tail(0, 3) == 1.0
    assert tails.ks_tail(0.0, 100, 100) == 1.0 and tails.ks_tail(0.5, 200, 200) < 1e-9
    assert tails.ks_tail(1.36 / math.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=0.01)


def test_eta_of_two_small_groups():
    # [1, 1, 2] and [5, 5, 6]: means 4/3 and 16/3, within 2/3 each, total 76/3 - so 1 - (4/3 / 4) / (76/3 / 5)
    assert tails.adjusted_eta(24.0, 4 / 3, 2, 6) == pytest.approx(1 - (4 / 3 / 4) / (76 / 3 / 5))
    assert tails.adjusted_eta(0.0, 0.0, 2, 6) is None and tails.adjusted_eta(5.0, 0.0, 3, 3) is None


def test_step_up_and_step_down():
    p = [0.001, 0.025, 0.03, 0.2, 0.9]
    assert tails.benjamini_hochberg(p) == [True, True, True, False, False]
    assert tails.benjamini_hochberg([0.04, None, 0.9]) == [False, False, False]
    assert tails.holm([0.01, 0.04, 0.03]) == [True, False, False]


def test_effective_size():
    assert tails.effective_n(100, 0.9, 0.9) == pytest.approx(100 * 0.19 / 1.81)
    assert tails.effective_n(100, 0.9, -0.9) == 100 and tails.effective_n(100, None, 0.5) == 100
    assert tails.effective_n(100, 0.999, 0.999) == 3


@given(st.lists(st.floats(0, 1), max_size=40))
def test_discoveries_are_the_smallest_p(p):
    found = tails.benjamini_hochberg(p)
    hits = [v for v, f in zip(p, found) if f]
    assert all(v not in hits or f for v, f in zip(p, found))
    assert not hits or max(hits) <= min([v for v, f in zip(p, found) if not f], default=1.0)
    assert sum(tails.holm(p)) <= sum(found)


@given(st.floats(0.01, 50), st.integers(1, 40), st.integers(1, 200))
def test_f_tail_is_a_probability_and_falls(f, d1, d2):
    a, b = tails.f_tail(f, d1, d2), tails.f_tail(f * 1.5, d1, d2)
    assert 0 <= b <= a + 1e-12 <= 1 + 1e-9

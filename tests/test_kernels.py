import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massloom.functions import kernels as K
from massloom.functions import similarity as S
from massloom.functions.statistics import t_two_sided
from massloom.operators import peaks as P


def test_local_maxima_and_plateaus():
    assert K.local_maxima(np.array([0, 1, 0, 2, 2, 2, 0, 3])).tolist() == [1, 4]
    assert len(K.local_maxima(np.array([3, 2, 1]))) == 0


def test_find_peaks_filters_in_order():
    x = np.array([0, 5, 1, 9, 1, 4, 0, 8, 0], float)
    assert K.find_peaks(x)["peaks"].tolist() == [1, 3, 5, 7]
    assert K.find_peaks(x, height=5)["peaks"].tolist() == [1, 3, 7]
    assert K.find_peaks(x, distance=3)["peaks"].tolist() == [3, 7]
    got = K.find_peaks(x, prominence=4)
    assert got["peaks"].tolist() == [1, 3, 7] or got["peaks"].tolist() == [1, 3, 5, 7]
    assert got["prominences"][1] == 9


def test_width_interpolates():
    got = K.find_peaks(np.array([0, 2, 4, 2, 0], float))
    assert got["prominences"][0] == 4 and got["widths"][0] == pytest.approx(2.0)


def test_moving_average():
    assert K.moving_average(np.array([1.0, 2, 3, 4]), 3).tolist() == pytest.approx([4 / 3, 2, 3, 11 / 3])
    assert K.moving_average(np.array([1, 2, 4]), 2).tolist() == [1, 1, 3]  # integers stay integers
    assert K.max_of_two(np.array([0, 2, 0, 4, 0])).tolist() == [0, 2, 2, 4, 4]


def test_area_variants():
    x = np.array([0, 2, 0, 4, 0])
    assert P.area(x, 1, 3) == 6 and P.area(x, 1, 3, "auc") == 2 + 2 + 4
    y = K.gaussian(np.arange(40), 100, 20, 3)
    assert P.area(y, 5, 35, "gauss") == pytest.approx(K.gaussian_area(100, 3), rel=1e-6)


def test_lowess_on_a_line_is_the_line():
    x = np.arange(30.0)
    sx, f = K.lowess(2 * x + 1, x, 0.4, 3)
    assert f == pytest.approx(2 * x + 1, abs=1e-8)
    assert K.interpolate([-1, 31], sx, f) == pytest.approx([-1, 63], abs=1e-6)
    K.lowess([1, 2, 3, 3], [0, 0, 0, 5], 0.5)  # equal x


def test_gaussian_fit():
    x = np.arange(50)
    h, m, s = K.fit_gaussian(x, K.gaussian(x, 1000, 22.3, 4.2), 900, 20, 10)
    assert (h, m, abs(s)) == pytest.approx((1000, 22.3, 4.2), rel=1e-6)


def test_linkage_and_assignment():
    x = np.array([0, 0.1, 5, 5.1, 10])
    d = np.abs(x[:, None] - x)
    assert K.linkage_clusters(d, 1).tolist() == [1, 1, 2, 2, 3]
    assert K.linkage_clusters(d, 1, "ward").tolist() == [1, 1, 2, 2, 3]
    assert K.assign_pairs(np.array([[10, 9], [9, 0]])) == [(0, 1), (1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=5))
def test_assignment_is_the_best(table):
    from itertools import permutations

    g = np.array(table, float)
    n, m = g.shape
    best = max(sum(g[i, j] for i, j in zip(rows, cols, strict=True)) for rows in permutations(range(n), min(n, m)) for cols in [range(m)] if n >= m) if n >= m else max(sum(g[i, c[i]] for i in range(n)) for c in permutations(range(m), n))
    assert sum(g[i, j] for i, j in K.assign_pairs(g)) == best


spectrum = st.lists(st.tuples(st.floats(50, 500), st.floats(1, 1000)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(spectrum, spectrum)
def test_similarities_are_symmetric_and_bounded(a, b):
    for f in (S.greedy_cosine, S.hungarian_cosine):
        assert 0 <= f(a, b)[0] <= 1
        assert f(a, a)[0] == pytest.approx(1.0)
    assert S.hungarian_cosine(a, b)[0] == pytest.approx(S.hungarian_cosine(b, a)[0])
    assert S.hungarian_cosine(a, b)[0] >= S.greedy_cosine(a, b)[0] - 1e-9
    assert S.entropy_similarity(a, b) == pytest.approx(S.entropy_similarity(b, a))
    assert S.entropy_similarity(a, a) == pytest.approx(1.0)


def test_empty_spectra_score_zero():
    assert S.greedy_cosine([], [(1, 2)]) == (0.0, 0)
    assert S.entropy_similarity([], [(1, 2)]) == 0.0
    assert S.linear_cosine([(1, 0)], [(1, 1)])[0] == 0.0


def test_splits():
    assert K.split_largest_gap(np.array([1, 2, 9, 10])) == 2
    wide = np.sort(np.concatenate([np.full(20, 100.0), np.full(20, 100.01)]))
    assert len(set(K.split_wide(wide, 100 * 5e-6).tolist())) == 2
    assert K.bin_by_median(np.array([1.0, 2, 3, 10, 11]), lambda v: 4).tolist() == [0, 0, 0, 1, 1]


def test_detects_gaussian_peaks():
    x = np.arange(400)
    y = K.gaussian(x, 2e6, 120, 5) + K.gaussian(x, 1e6, 280, 6) + 500
    got = P.detect_peaks(y.astype(int), P.PeakParameters())
    assert [abs(q["apex"] - t) <= 1 for q, t in zip(got, (120, 280), strict=True)] == [True, True]
    assert all(q["goodness_fitting"] > 0.9 and 0 <= q["cSelectivity"] <= 1 and q["snr"] > 2 for q in got)
    assert all(q["peak_area"] <= y.sum() for q in got)
    assert P.detect_peaks(np.zeros(100), P.PeakParameters()) == []


def test_calibration_moves_by_the_shift():
    at = np.arange(50, 950, 20)
    m = P.calibration_map(at, at + 5, 1000, 1000)
    assert m[500] == 505 and all(k != v for k, v in m.items())


def test_unique_peak_and_overlaps():
    y = K.gaussian(np.arange(100), 1e6, 50, 4)
    assert P.unique_peak(y) == 50
    assert P.unique_peak(y + np.roll(y, 30)) is None
    a, b = ({"apex": p, "left_base": lo, "right_base": hi, "height": 1, "goodness_fitting": 1} for p, lo, hi in ((10, 0, 20), (22, 12, 30)))
    assert [(q["left_base"], q["right_base"]) for q in P.resolve_overlaps([a, b])] == [(0, 12), (20, 30)]


def test_student():
    assert t_two_sided(0, 10) == pytest.approx(1.0)
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert math.isclose(t_two_sided(-1.0, 1), 0.5, abs_tol=1e-9)

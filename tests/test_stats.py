import math

import numpy as np
import pytest

from helixmill.functions import stats


def test_normal_tails_and_quantiles():
    assert stats.norm_sf(np.array([0.0, 1.959963984540054]))[1] == pytest.approx(0.025, rel=1e-10)
    p = np.array([1e-250, 1e-20, 1e-8, 0.025, 0.3, 0.5, 0.9, 1 - 1e-10])
    assert stats.norm_sf(-stats.norm_ppf(p)) == pytest.approx(p, rel=1e-8)
    assert np.isnan(stats.norm_ppf(np.array([np.nan]))[0])


def test_t_tails():
    # with one degree of freedom the distribution is Cauchy's
    t = np.array([0.5, 2.0, 50.0])
    assert stats.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * np.arctan(t), rel=1e-9)
    assert stats.t_two_sided(np.array([1.96]), 1e7)[0] == pytest.approx(2 * stats.norm_sf(np.array([1.96]))[0], rel=1e-5)
    assert 0 < stats.t_two_sided(np.array([40.0]), 1000)[0] < 1e-200
    assert np.isnan(stats.t_two_sided(np.array([np.nan]), 5)[0])


def test_chi2_tails():
    x = np.array([0.1, 1.0, 10.0])
    assert stats.chi2_sf(x, 1) == pytest.approx(2 * stats.norm_sf(np.sqrt(x)), rel=1e-12)
    assert stats.chi2_sf(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-12)
    assert stats.chi2_sf(np.array([9.487729036781154]), 4)[0] == pytest.approx(0.05, rel=1e-9)
    assert stats.chi2_sf(np.array([7.814727903251179]), 3)[0] == pytest.approx(0.05, rel=1e-9)


def test_cells_and_people_give_the_same_logistic_fit():
    r = np.random.default_rng(1)
    n = 3000
    g, age, sex = r.integers(0, 3, n), r.integers(18, 91, n), r.integers(0, 2, n)
    y = (r.random(n) < 1 / (1 + np.exp(-(-1 + 0.4 * g + 0.01 * age - 0.3 * sex)))).astype(float)
    x = np.column_stack([np.ones(n), g, age / 50, sex]).astype(float)
    one = [v[0] for v in stats.irls(x[None], np.ones((1, n)), y[None])]
    key, which = np.unique(x, axis=0, return_inverse=True)
    count, ill = np.bincount(which.ravel()).astype(float), np.bincount(which.ravel(), weights=y)
    # beside a model of nobody, and filled up with cells of nobody
    key, count, ill = (np.stack([np.concatenate([v, np.zeros((3, *v.shape[1:]))]), np.zeros((len(v) + 3, *v.shape[1:]))]) for v in (key, count, ill))
    beta, se, ok = stats.irls(key, count, ill)
    assert one[2] and ok.tolist() == [True, False] and np.isnan(beta[1]).all()
    cells = beta[0], se[0]
    assert cells[0] == pytest.approx(one[0], rel=1e-6) and cells[1] == pytest.approx(one[1], rel=1e-6)
    assert abs(one[0][1] - 0.4) < 4 * one[1][1]


def test_separated_data_needs_the_penalty():
    x = np.array([[1, 0], [1, 1], [1, 2]], float)
    n, cases = np.array([50.0, 20, 5]), np.array([0.0, 0, 5])
    beta, se, ok = stats.irls(x[None], n[None], cases[None], firth=True)
    assert ok[0] and np.isfinite(beta).all() and np.isfinite(se).all() and beta[0, 1] > 0


def test_ridge_with_a_large_budget_is_least_squares():
    r = np.random.default_rng(2)
    x = np.column_stack([np.ones(500), r.normal(size=(500, 3))])
    y = x @ np.array([1.0, 2, 0, -1]) + r.normal(size=500)
    beta, se, sse = stats.ridge((x.T @ x)[None], (x.T @ y)[None], np.array([y @ y]), np.array([500]), 0.0)
    assert beta[0] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-6)
    assert sse[0] == pytest.approx(float(((y - x @ beta[0]) ** 2).sum()), rel=1e-6)


def test_noisy_sums_that_are_not_positive_are_mended():
    m = np.array([[1.0, 5.0], [5.0, 1.0]])
    stack = np.stack([m, m * 1000, np.eye(2), m * 1e-7, np.zeros((2, 2))])
    near = stats.positive(stack)
    assert (np.linalg.eigvalsh(near) > 0).all()
    lift = near[:, 0, 0] - stack[:, 0, 0]
    # the first of 1e-6, 1e-5 ... that exceeds minus the lowest eigenvalue; of the second, none does
    assert lift[[0, 2, 3, 4]] == pytest.approx([10, 1e-6, 1e-6, 1e-6], rel=1e-6)
    assert np.linalg.eigvalsh(near[1]) == pytest.approx([1e-8, 6000], rel=1e-3)


def test_noise_that_leaves_no_residual_has_fixed_stand_ins():
    beta, se, sse = stats.ridge(np.eye(2)[None] * 4, np.array([[8.0, 0.0]]), np.array([1.0]), np.array([10]), 0.0)
    assert sse[0] == 1.0 and beta[0] == pytest.approx([2, 0], abs=1e-5) and np.isfinite(se).all()

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verispan.kernels import tree as K


def _tree(seed, n):
    r = np.random.default_rng(seed)
    return K.Tree(r.normal(size=n), [(i, int(r.integers(0, i)), float(r.uniform(0, 1))) for i in range(1, n)], r.uniform(0, 1, n))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 7))
def test_marginals_equal_enumeration(seed, n):
    t = _tree(seed, n)
    assert np.allclose(K.marginals(t), K.enumerate_marginals(t))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.floats(0.1, 2))
def test_bounds_hold_and_are_reached(seed, n, budget):
    t = _tree(seed, n)
    b = K.solve(t, 0, budget, 12)
    assert b.lower_certified <= b.lower_grid <= b.nominal + 1e-12 and b.nominal <= b.upper_grid + 1e-12 <= b.upper_certified + 1e-9
    for d, p in ((b.delta_lower, b.lower_grid), (b.delta_upper, b.upper_grid)):
        assert np.isclose(K.marginals(t, d)[0], p) and np.abs(d).sum() <= budget + 1e-9 and (np.abs(d) <= t.eps + 1e-9).all()
    r = np.random.default_rng(seed)
    for _ in range(30):  # nothing inside the set gets past the certified bounds
        d = r.uniform(-1, 1, n) * t.eps
        d *= min(1, budget / max(np.abs(d).sum(), 1e-12))
        assert b.lower_certified - 1e-9 <= K.marginals(t, d)[0] <= b.upper_certified + 1e-9


def test_small_cases():
    one = K.Tree([0.3], [], [0.2])
    assert K.solve(one, 0, 0.0).upper_grid == K.solve(one, 0, 0.0).nominal
    assert K.box_bounds(one, 0)[1] == pytest.approx(float(K.sigma(0.5)))
    assert list(K.max_plus([0, 1], [0, 5])) == [0, 5] and list(K.min_plus([0, 1], [0, -5])) == [0, -5]
    for bad in (([], [], None), ([0, 0], [], None), ([0, 0], [(0, 1, -1.0)], None), ([0, 0, 0], [(0, 1, 1.0), (0, 1, 1.0)], None)):
        with pytest.raises(ValueError):
            K.Tree(*bad)
    assert K.maximum_spanning_tree([(0, 1, 0.5), (1, 2, 0.9), (0, 2, 0.7)]) == [(1, 2, 0.9), (0, 2, 0.7)]
    assert K.critical_radius(K.Tree([-0.5], []), 0) == pytest.approx(0.5, abs=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.floats(0.1, 2))
def test_grid_bounds_equal_trying_all_allocations(seed, n, budget):
    t = _tree(seed, n)
    b = K.solve(t, n - 1, budget, 6)
    assert np.allclose(K.enumerate_bounds(t, n - 1, budget, 6), (b.lower_grid, b.upper_grid))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 7), st.floats(0, 3))
def test_many_chains_at_once_equal_one_tree_each(seed, n, budget):
    r = np.random.default_rng(seed)
    th, ep, j = r.normal(size=(3, n)), r.uniform(0, 1, (3, n)) * r.integers(0, 2, (3, n)), r.uniform(0, 1, (3, n - 1))
    got = K.chain_bounds(th, ep, j, budget, 15)
    for i in range(3):
        t = K.Tree(th[i], [(k, k + 1, j[i, k]) for k in range(n - 1)], ep[i])
        for target in range(n):
            b = K.solve(t, target, budget, 15)
            for f in ("nominal", "lower_grid", "upper_grid", "lower_certified", "upper_certified", "gap"):
                assert np.isclose(got[f][i, target], getattr(b, f)), f
            for f, p in (("delta_lower", b.lower_grid), ("delta_upper", b.upper_grid)):
                d = got[f][i, target]
                assert np.isclose(K.marginals(t, d)[target], p) and np.abs(d).sum() <= budget + 1e-9 and (np.abs(d) <= ep[i] + 1e-9).all()


def test_topologies_and_couplings():
    w = np.array([[0, 0.2, 0.9], [0.2, 0, 0.4], [0.9, 0.4, 0]])
    assert K.topology(3, "chain", w) == [(0, 1, 0.2), (1, 2, 0.4)] and K.topology(3, "star") == [(0, 1, 1.0), (0, 2, 1.0)]
    assert K.topology(3, "mst", w) == [(0, 2, 0.9), (1, 2, 0.4)] and K.topology(3, "none") == []
    assert K.maximum_spanning_tree([(0, 1, 0.3)], 4) == [(0, 1, 0.3), (1, 2, 0.5), (2, 3, 0.5)]
    assert K.couplings([(0, 1, 0.5)], "weighted", 2.0) == [(0, 1, 1.0)] and K.couplings([(0, 1, 0.5)], "zero", 2.0)[0][2] == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6))
def test_critical_radii_of_many_chains(seed, n):
    r = np.random.default_rng(seed)
    th, j = r.normal(size=(2, n)), r.uniform(0, 1, (2, n - 1))
    got = K.chain_critical_radii(th, j)
    for i in range(2):
        t = K.Tree(th[i], [(k, k + 1, j[i, k]) for k in range(n - 1)])
        assert np.allclose(got[i], [K.critical_radius(t, k) for k in range(n)], atol=1e-6)
    assert np.isinf(K.chain_critical_radii(np.array([[-30.0]]), np.zeros((1, 0)))).all()

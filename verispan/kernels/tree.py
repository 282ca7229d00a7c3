"""Exact inference and worst-case bounds on one small tree, in numpy.

Fields only: a node's total field is its own plus, for each neighbour, the
message of that neighbour's field through the coupling. The bounds run the same
recursion on profiles over a budget grid: entry m is the best field reachable
with m grid steps spent in the subtree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_TINY = 1e-12


def message(j: float, x):
    """Half of ln(cosh(j + x) / cosh(j - x)), free of overflow."""
    x = np.asarray(x, float)
    return 0.5 * (np.logaddexp(j + x, -j - x) - np.logaddexp(j - x, x - j))


def sigma(x):
    return 1 / (1 + np.exp(-2 * np.asarray(x, float)))


class Tree:
    """theta, eps and weighted edges (u, v, j) of a connected graph without cycles."""

    def __init__(self, theta: Sequence[float], edges: Sequence[tuple[int, int, float]], eps: Sequence[float] | None = None) -> None:
        self.theta = np.array(theta, float)
        self.n = len(self.theta)
        self.eps = np.zeros(self.n) if eps is None else np.array(eps, float)
        self.near: list[dict[int, float]] = [{} for _ in range(self.n)]
        for u, v, j in edges:
            if j < 0:
                raise ValueError(f"the coupling of {u} and {v} is negative")
            self.near[u][v] = self.near[v][u] = float(j)
        if self.n == 0 or len(self.eps) != self.n or (self.eps < 0).any():
            raise ValueError("a tree needs nodes, and as many radii that are not negative")
        if len(edges) != self.n - 1 or len(self.walk(0)) != self.n:
            raise ValueError("the edges make no tree")

    def walk(self, root: int) -> list[tuple[int, int]]:
        """(node, parent) from the root outwards."""
        out, seen = [(root, -1)], {root}
        for u, _ in out:
            for v in self.near[u]:
                if v not in seen:
                    seen.add(v)
                    out.append((v, u))
        return out


def fields(t: Tree, delta: Sequence[float] | None = None) -> np.ndarray:
    """Total field of every node: one pass inwards, one outwards."""
    own = t.theta + (0 if delta is None else np.asarray(delta, float))
    order = t.walk(0)
    inward, up = own.copy(), np.zeros(t.n)
    for u, p in reversed(order):
        if p >= 0:
            up[u] = message(t.near[u][p], inward[u])
            inward[p] += up[u]
    total = inward.copy()
    for u, p in order[1:]:
        # what the parent knows without this branch
        total[u] = inward[u] + message(t.near[u][p], total[p] - up[u])
    return total


def marginals(t: Tree, delta: Sequence[float] | None = None) -> np.ndarray:
    return sigma(fields(t, delta))


def enumerate_marginals(t: Tree, delta: Sequence[float] | None = None) -> np.ndarray:
    """The same by adding up all 2^n states; for tests."""
    own = t.theta + (0 if delta is None else np.asarray(delta, float))
    s = 1 - 2 * ((np.arange(2**t.n)[:, None] >> np.arange(t.n)) & 1)
    e = s @ own + sum(j * s[:, u] * s[:, v] for u in range(t.n) for v, j in t.near[u].items() if u < v)
    w = np.exp(e - e.max())
    return (w[:, None] * (s > 0)).sum(0) / w.sum()


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best[m] = max over j of a[m - j] + b[j], and the j; the smallest on ties."""
    k = len(a)
    m, j = np.arange(k)[:, None], np.arange(k)[None, :]
    x = np.where(j <= m, a[np.maximum(m - j, 0)] + b[j], -np.inf)
    best = x.argmax(axis=1)
    return x[np.arange(k), best], best


def max_plus(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    return _merge(np.asarray(a, float), np.asarray(b, float))[0]


def min_plus(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    return -_merge(-np.asarray(a, float), -np.asarray(b, float))[0]


def _highest(t: Tree, root: int, steps: int, step: float, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Profile of sign * field at the root over the budget grid, and the perturbation that reaches its end."""
    order = t.walk(root)
    kids: list[list[int]] = [[] for _ in range(t.n)]
    for u, p in order[1:]:
        kids[p].append(u)
    up: dict[int, np.ndarray] = {}
    own_spend: dict[int, np.ndarray] = {}
    splits: dict[int, list[np.ndarray]] = {}
    grid = np.arange(steps + 1)
    profile = np.zeros(0)
    for u, p in reversed(order):
        below, splits[u] = np.zeros(steps + 1), []
        for c in kids[u]:
            below, choice = _merge(below, up[c])
            splits[u].append(choice)
        # a step moves the own field by a whole step and any other by less: the own comes first
        own_spend[u] = np.minimum(grid, min(int(np.floor(t.eps[u] / step + 1e-8)), steps))
        profile = sign * t.theta[u] + own_spend[u] * step + below[grid - own_spend[u]]
        if p >= 0:
            up[u] = message(t.near[u][p], profile)  # odd in the field: the sign passes through
    delta, todo = np.zeros(t.n), [(root, steps)]
    while todo:
        u, m = todo.pop()
        k = int(own_spend[u][m])
        delta[u], m = sign * k * step, m - k
        for c, choice in reversed(list(zip(kids[u], splits[u]))):
            j = int(choice[m])
            todo.append((c, j))
            m -= j
    return sign * profile, delta


@dataclass(frozen=True)
class Bounds:
    nominal: float
    lower_grid: float
    upper_grid: float
    lower_certified: float
    upper_certified: float
    gap: float
    lower_profile: np.ndarray
    upper_profile: np.ndarray
    delta_lower: np.ndarray
    delta_upper: np.ndarray


def grid_gap(t: Tree, root: int, budget: float, step: float) -> float:
    """How much the field can gain off the grid: path gains times what rounding down leaves, at most the budget."""
    gain = np.ones(t.n)
    for u, p in t.walk(root)[1:]:
        gain[u] = gain[p] * np.tanh(t.near[u][p])
    return float(min(budget, (gain * np.minimum(t.eps, step)).sum()))


def solve(t: Tree, target: int, budget: float, steps: int = 100) -> Bounds:
    """Bounds of the target's posterior over all perturbations in the box and the budget.

    Without budget, steps or radii all bounds are the nominal posterior. Grid
    bounds are reached by the witnesses; certified ones hold off the grid as well.
    """
    if budget < 0 or not 0 <= target < t.n:
        raise ValueError("the budget must not be negative and the target a node")
    f = float(fields(t)[target])
    p = float(sigma(f))
    if budget <= _TINY or steps <= 0 or (t.eps <= _TINY).all():
        z = np.zeros(t.n)
        return Bounds(p, p, p, p, p, 0.0, np.array([f]), np.array([f]), z, z)
    step = budget / steps
    up, d_up = _highest(t, target, steps, step, +1)
    low, d_low = _highest(t, target, steps, step, -1)
    gap = grid_gap(t, target, budget, step)
    lg, ug = float(sigma(low[-1])), float(sigma(up[-1]))
    return Bounds(p, lg, ug, min(lg, float(sigma(low[-1] - gap))), max(ug, float(sigma(up[-1] + gap))), gap, low, up, d_low, d_up)


def box_bounds(t: Tree, target: int) -> tuple[float, float]:
    """Bounds without a budget: every field at the end of its radius."""
    return float(marginals(t, -t.eps)[target]), float(marginals(t, t.eps)[target])


def critical_radius(t: Tree, target: int, tau: float = 0.5, high: float = 10.0, rounds: int = 30) -> float:
    """The smallest common radius at which the box interval of the target reaches tau, by bisection; inf beyond ``high``."""
    own = marginals(t)[target]

    def reaches(r: float) -> bool:
        d = np.full(t.n, r if own < tau else -r)
        m = marginals(t, d)[target]
        return m >= tau if own < tau else m <= tau

    if not reaches(high):
        return float("inf")
    lo, hi = 0.0, high
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reaches(mid) else (mid, hi)
    return hi


def maximum_spanning_tree(edges: Sequence[tuple[int, int, float]], nodes: int = 0, mend: float = 0.5) -> list[tuple[int, int, float]]:
    """Heaviest edges first, ties by (u, v), each kept that joins two parts. With a number of nodes, parts still apart are joined by edges (i, i + 1) of weight ``mend``."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for u, v, w in sorted(((int(min(u, v)), int(max(u, v)), float(w)) for u, v, w in edges), key=lambda e: (-e[2], e[0], e[1])):
        a, b = top(u), top(v)
        if a != b:
            parent[b] = a
            out.append((u, v, w))
    for i in range(nodes - 1):
        a, b = top(i), top(i + 1)
        if a != b:
            parent[b] = a
            out.append((i, i + 1, mend))
    return out


def topology(n: int, kind: str, weights: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Edges of a tree over n nodes: none, chain, star (around node 0) or mst; weights (n x n) are held inside [0, 1], without them all are 1."""
    w = lambda u, v: 1.0 if weights is None else float(min(max(weights[u][v], 0.0), 1.0))
    if kind in ("none", "independent"):
        return []
    if kind == "chain":
        return [(i, i + 1, w(i, i + 1)) for i in range(n - 1)]
    if kind == "star":
        return [(0, i, w(0, i)) for i in range(1, n)]
    if kind == "mst":
        return maximum_spanning_tree([(u, v, w(u, v)) for u in range(n) for v in range(u + 1, n)], n)
    raise ValueError(f"there is no topology {kind}")


def couplings(edges: Sequence[tuple[int, int, float]], strategy: str, strength: float) -> list[tuple[int, int, float]]:
    """Couplings of weighted edges: zero, the same for all (const) or in proportion to the weight (weighted)."""
    if strength < 0:
        raise ValueError("a coupling must not be negative")
    how = {"zero": lambda s: 0.0, "const": lambda s: strength, "weighted": lambda s: strength * s}[strategy]
    return [(u, v, how(s)) for u, v, s in edges]


def enumerate_bounds(t: Tree, target: int, budget: float, steps: int) -> tuple[float, float]:
    """Grid bounds by trying all allocations; for tests of small trees."""
    import itertools

    step = budget / steps
    most = [min(int(np.floor(e / step + 1e-8)), steps) for e in t.eps]
    tries = [k for k in itertools.product(*(range(m + 1) for m in most)) if sum(k) <= steps]
    values = [float(marginals(t, s * step * np.array(k))[target]) for k in tries for s in (-1, 1)]
    return min(values), max(values)


def chain_bounds(theta: np.ndarray, eps: np.ndarray, j: np.ndarray, budget: float, steps: int = 100) -> dict[str, np.ndarray]:
    """``solve`` for every target of many chains of the same length at once: theta, eps (chains, n), j (chains, n - 1).

    A step spent at a node moves its own field by a whole step, one spent further
    off by less (a message's slope is at most tanh j < 1). So a node always spends
    on itself first, and what is left goes on: profiles run along the chain from
    both ends by a shift, and only the target divides the rest between its sides.
    """
    b, n = theta.shape
    step = budget / steps if steps > 0 else 0.0
    plain = sigma(chain_fields(theta, j))
    zero = np.zeros((b, n))
    if budget <= _TINY or steps <= 0 or n == 0:
        return {"nominal": plain, "lower_grid": plain, "upper_grid": plain, "lower_certified": plain, "upper_certified": plain, "gap": zero, "delta_lower": np.zeros((b, n, n)), "delta_upper": np.zeros((b, n, n))}
    most = np.minimum(np.floor(eps / step + 1e-8), steps).astype(int)
    m = np.arange(steps + 1)[None, :]
    rows = np.arange(b)
    fields_at, deltas = {}, {}
    for sign in (1, -1):
        ahead: list[np.ndarray] = [np.zeros((b, steps + 1))]
        behind: list[np.ndarray] = [np.zeros((b, steps + 1))]
        for out, order in ((ahead, range(n - 1)), (behind, range(n - 1, 0, -1))):
            for i in order:
                own = np.minimum(m, most[:, i : i + 1])
                profile = sign * theta[:, i : i + 1] + own * step + np.take_along_axis(out[-1], m - own, axis=1)
                link = j[:, i if out is ahead else i - 1][:, None]
                out.append(message(link, profile))
        behind.reverse()
        best, delta = np.zeros((b, n)), np.zeros((b, n, n))
        for i in range(n):
            rest = steps - most[:, i : i + 1]
            there = np.where(m <= rest, np.take_along_axis(ahead[i], np.maximum(rest - m, 0), axis=1) + behind[i], -np.inf)
            x = there.argmax(axis=1)
            best[:, i] = sign * theta[:, i] + most[:, i] * step + there[rows, x]
            delta[:, i, i] = sign * most[:, i] * step
            for side, left in ((range(i - 1, -1, -1), rest[:, 0] - x), (range(i + 1, n), x)):
                for u in side:
                    k = np.minimum(left, most[:, u])
                    delta[:, i, u] = sign * k * step
                    left = left - k
        fields_at[sign], deltas[sign] = sign * best, delta
    gain = np.zeros((b, n, n))
    for i in range(n):
        gain[:, i, i] = 1.0
        for u in range(i + 1, n):
            gain[:, i, u] = gain[:, u, i] = gain[:, i, u - 1] * np.tanh(j[:, u - 1])
    gap = np.minimum(budget, np.einsum("biu,bu->bi", gain, np.minimum(eps, step)))
    gap[(eps <= _TINY).all(axis=1)] = 0.0
    low, high = sigma(fields_at[-1]), sigma(fields_at[1])
    return {"nominal": plain, "lower_grid": low, "upper_grid": high, "lower_certified": np.minimum(low, sigma(fields_at[-1] - gap)), "upper_certified": np.maximum(high, sigma(fields_at[1] + gap)), "gap": gap, "delta_lower": deltas[-1], "delta_upper": deltas[1]}


def chain_critical_radii(theta: np.ndarray, j: np.ndarray, tau: float = 0.5, high: float = 10.0, rounds: int = 30) -> np.ndarray:
    """``critical_radius`` of every target of many chains of the same length, all bisections side by side."""
    b, n = theta.shape
    edge = 0.5 * np.log(tau / (1 - tau))
    up = chain_fields(theta, j) < edge
    th, jj = np.repeat(theta, n, axis=0), np.repeat(j, n, axis=0)
    target, sign = np.tile(np.arange(n), b), np.where(up.ravel(), 1.0, -1.0)

    def reaches(r: np.ndarray) -> np.ndarray:
        f = chain_fields(th + (sign * r)[:, None], jj)[np.arange(b * n), target]
        return sign * f >= sign * edge

    lo, hi = np.zeros(b * n), np.full(b * n, high)
    far = ~reaches(hi)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        yes = reaches(mid)
        lo, hi = np.where(yes, lo, mid), np.where(yes, mid, hi)
    return np.where(far, np.inf, hi).reshape(b, n)


def chain_fields(theta: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Total fields of many chains of the same length."""
    n = theta.shape[1]
    left, right = theta.copy(), theta.copy()
    for i in range(1, n):
        left[:, i] += message(j[:, i - 1], left[:, i - 1])
    for i in range(n - 2, -1, -1):
        right[:, i] += message(j[:, i], right[:, i + 1])
    return left + right - theta

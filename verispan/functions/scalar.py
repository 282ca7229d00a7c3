"""Scalar expressions of claim reliability; all take and return Columns and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held inside [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-4) -> Column:
    """ln(p / (1 - p)) of the clipped probability."""
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def probability_to_theta(p: Column, p_min: float = 1e-5, theta_max: float | None = None) -> Column:
    """Field of P(hallucinated): half the logit, optionally held inside +-theta_max."""
    q = clip(p, p_min, 1 - p_min)
    t = 0.5 * (F.log(q) - F.log1p(-q))
    return clip(t, -theta_max, theta_max) if theta_max is not None else t


def theta_to_probability(theta: Column) -> Column:
    return sigmoid(2 * theta)


def unary_theta(det: Column, sim: Column, w_det: float = 0.6, w_sim: float = 0.4, theta_max: float = 5.0, eps: float = 1e-4) -> Column:
    """Field from *support*: a weighted mean of detector score and similarity moved to [0, 1]; a missing score counts 0.5, a missing similarity as the score."""
    d = F.coalesce(det, F.lit(0.5))
    s = F.coalesce((sim + 1) / 2, d)
    v = clip((w_det * d + w_sim * s) / (w_det + w_sim), eps, 1 - eps)
    return clip(0.5 * F.log((1 - v) / v), -theta_max, theta_max)


def evidence_epsilon(det: Column, sim: Column, base: float = 0.5493, scale: float = 1.0, w_conflict: float = 0.0, least: float = 0.0) -> Column:
    """Radius of a field: base * scale plus a share of the conflict between the two scores."""
    conflict = F.coalesce(F.abs(det - (sim + 1) / 2), F.lit(0.0))
    return F.greatest(F.lit(base * scale) + w_conflict * conflict, F.lit(least))


def ln_cosh(z: Column) -> Column:
    """ln(2 cosh z), without overflow."""
    a = F.abs(z)
    return a + F.log1p(F.exp(-2 * a))


def edge_message(j: Column, x: Column) -> Column:
    """Message through a coupling: half of ln(cosh(j + x) / cosh(j - x))."""
    return 0.5 * (ln_cosh(j + x) - ln_cosh(j - x))


def margin_uncertainty(p: Column) -> Column:
    return 1 - F.abs(2 * p - 1)


def binary_entropy(p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def threshold_uncertainty(p: Column, tau: float = 0.5) -> Column:
    """Minus the distance to the threshold."""
    return -F.abs(p - tau)


def normalized_threshold_uncertainty(p: Column, tau: float = 0.5) -> Column:
    span = F.when(p >= tau, F.lit(1 - tau)).otherwise(F.lit(tau))
    return 1 - F.when(span > 0, F.abs(p - tau) / span).otherwise(0.0)


def robust_decision(lower: Column, upper: Column, tau: float = 0.5) -> Column:
    return F.when(upper < tau, F.lit("supported")).when(lower > tau, F.lit("hallucinated")).otherwise(F.lit("evidence_sensitive"))


def kept(score: Column, tau: Column | float, eps: Column | float = 0.0) -> Column:
    """A claim is kept where its score, less the radius, is strictly over the threshold."""
    return score - eps > tau


def pgm_label(status: Column) -> Column:
    """supported -> -1, hallucinated -> +1; anything else is an error."""
    return F.when(status == "supported", F.lit(-1)).when(status == "hallucinated", F.lit(1)).otherwise(F.raise_error(F.concat(F.lit("no spin for status "), F.coalesce(status, F.lit("null")))).cast("int"))


def uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from the md5 of the parts joined by '|': the same in any SQL that has md5."""
    key = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_bounds(most: int = 8) -> list[float]:
    """Where the Poisson(1) count of a uniform number passes from k to k + 1, up to ``most``."""
    import math

    out, total = [], sum(math.exp(-1) / math.factorial(k) for k in range(most))
    for k in range(most - 1, -1, -1):
        out.append(total)
        total -= math.exp(-1) / math.factorial(k)
    return out[::-1]


def poisson_weight(u: Column, most: int = 8) -> Column:
    """Poisson(1) count of a uniform number: how often a cluster is drawn in a replicate."""
    out = F.lit(most)
    for k, bound in reversed(list(enumerate(poisson_bounds(most)))):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a norm is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), clip(dot(a, b) / (na * nb), -1.0, 1.0))

"""Row functions of the mixture update: log weights of the components, the probability of the zero component, the draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences of log weights beyond this count as certain.
FAR = 700.0


def log_weights(num: Column, n: int, sigma_g: float, sigma_e: float, pi: list[float], scale: list[float]) -> tuple[list[Column], list[Column]]:
    """Log weights per component (first: zero), and the posterior means of the others."""
    means = []
    logs = [F.ln(F.lit(pi[0]))]
    for p, c in zip(pi[1:], scale, strict=True):
        mean = num / F.lit((n - 1.0) + (sigma_e / sigma_g) / c)
        means.append(mean)
        logs.append(F.ln(F.lit(p)) - 0.5 * F.ln(F.lit(sigma_g / sigma_e * (n - 1.0) * c + 1.0)) + mean * num / F.lit(2 * sigma_e))
    return logs, means


def share(logs: list[Column], k: int, rest_only: bool = False) -> Column:
    """1 / sum of exp(log_i - log_k), 0 where a difference (among those after k, if ``rest_only``) is beyond FAR."""
    tested = logs[k + 1 :] if rest_only else logs
    far = reduce(lambda a, b: a | b, [F.abs(x - logs[k]) > FAR for x in tested], F.lit(False))
    total = reduce(lambda a, b: a + b, [F.exp(x - logs[k]) for x in logs])
    return F.when(far, 0.0).otherwise(1.0 / total)


def chosen(logs: list[Column], u: Column) -> Column:
    """The first component whose cumulated share reaches u; the last one otherwise."""
    acc, out = share(logs, 0), F.lit(None)
    steps = [acc]
    for k in range(1, len(logs)):
        acc = acc + share(logs, k, rest_only=True)
        steps.append(acc)
    out = F.lit(len(logs) - 1)
    for k in range(len(logs) - 2, -1, -1):
        out = F.when(u <= steps[k], k).otherwise(out)
    return out.cast("int")


def uniform(seed: int, iteration: Column | int, key: Column, slot: int = 0) -> Column:
    """Counter-based uniform in [0, 1): the same for any partitioning, nothing to save for a restart."""
    h = F.xxhash64(F.lit(seed), F.lit(iteration) if isinstance(iteration, int) else iteration, key, F.lit(slot))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def normal(seed: int, iteration: Column | int, key: Column, slot: int = 0) -> Column:
    """Box and Muller from two counters."""
    u, v = (uniform(seed, iteration, key, 2 * slot + 10 + i) for i in range(2))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(F.lit(6.283185307179586) * v)


def lcg(seed: int, iteration: int, key: Column) -> Column:
    """Integer form of a uniform that other SQL engines evaluate alike; for single steps only, not for chains."""
    m, a = 2147483647, 48271
    return ((F.lit(a).cast("long") * ((F.lit(a).cast("long") * key + seed) % m) + iteration) % m) / F.lit(float(m))

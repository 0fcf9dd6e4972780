"""Gibbs chain of the Gaussian mixture model in synchronisation windows, by joins alone: for more individuals or effects than ``chain`` broadcasts.

Within a window every marker sees the residual as of the last synchronisation, so a window is two grouped sums: the numerators per
marker and the change of the residual per individual. Draws come from counters (seed, iteration, marker), so a chain doesn't
depend on partitioning and resumes from its last sample alone. Hyper-parameters (a few numbers per group) live on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mixture
from . import stats


@dataclass(frozen=True)
class Settings:
    seed: int = 1
    windows: int = 4
    scale: tuple[float, ...] = (0.001, 0.01, 0.1)
    v0: float = 1e-4
    s0: float = 1e-4


@dataclass(frozen=True)
class Hyper:
    iteration: int
    mu: float
    sigma_g: float
    sigma_e: float
    pi: tuple[float, ...]
    m0: int = 0
    h2: float = field(default=0.0)


def start(y: DataFrame, s: Settings) -> Hyper:
    r = y.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    pi = (0.5, *(0.5 * np.array(s.scale) / sum(s.scale)).tolist())
    return Hyper(0, 0.0, float(np.random.Generator(np.random.Philox(key=s.seed)).beta(1, 1)), 0.5 * r.yy / r.n, pi)


def numerators(geno: DataFrame, marker: DataFrame, eps: DataFrame, beta: DataFrame, n: int) -> DataFrame:
    """``marker`` with its row of ``beta`` and num: the product of its standardised column with the residual, its own effect put back."""
    total = eps.agg(F.sum("e")).first()[0]
    cells = geno.join(marker, "marker_id").join(eps, "ind_id")
    x = F.when(F.col("d").isNull(), F.col("mave")).otherwise(F.col("d"))
    dots = cells.groupBy("marker_id").agg(F.sum(x * F.col("e")).alias("xe"))
    num = F.col("mstd") * (F.coalesce("xe", F.lit(0.0)) - F.col("mave") * F.lit(total)) + F.col("beta") * F.lit(n - 1.0)
    return marker.join(dots, "marker_id", "left").join(beta, "marker_id").withColumn("num", num)


def iterate(geno: DataFrame, marker: DataFrame, eps: DataFrame, beta: DataFrame, h: Hyper, s: Settings, save) -> tuple[DataFrame, DataFrame, Hyper]:
    """One sweep. ``marker``: marker_id, mave, mstd; ``eps``: ind_id, e; ``beta``: marker_id, beta, component. ``save`` writes a
    DataFrame to the shared folder and reads it back, which cuts lineage."""
    it = h.iteration + 1
    rng = np.random.Generator(np.random.Philox(key=[s.seed, it]))
    m = eps.agg(F.count("*").alias("n"), F.sum("e").alias("s")).first()
    n = m.n
    mu = float(rng.normal((m.s + n * h.mu) / n, np.sqrt(h.sigma_e / n)))
    eps = eps.withColumn("e", F.col("e") + F.lit(h.mu - mu))
    window = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(it), "marker_id"), F.lit(s.windows))
    if not h.sigma_g:  # no effects are left, and none come back: only the mean and the residual's variance move on
        eps = save(eps)
    for w in range(s.windows if h.sigma_g else 0):
        mine = marker.filter(window == w)
        now = numerators(geno, mine, eps, beta, n)
        logs, means = mixture.log_weights(F.col("num"), n, h.sigma_g, h.sigma_e, list(h.pi), list(s.scale))
        now = now.withColumn("k", mixture.chosen(logs, mixture.uniform(s.seed, it, F.col("marker_id"))))
        new = F.lit(0.0)
        for i, (mean, c) in enumerate(zip(means, s.scale, strict=True)):
            sd = float(np.sqrt(h.sigma_e / ((n - 1.0) + h.sigma_e / h.sigma_g / c)))
            new = F.when(F.col("k") == i + 1, mean + F.lit(sd) * mixture.normal(s.seed, it, F.col("marker_id"))).otherwise(new)
        drawn = save(now.select("marker_id", new.alias("new"), F.col("k").alias("new_k"), (F.col("beta") - new).alias("delta_beta")))
        moved = stats.residual_update(geno, mine, drawn.select("marker_id", "delta_beta"), eps)
        eps = save(eps.join(moved, "ind_id").select("ind_id", (F.col("e") + F.col("delta_eps")).alias("e")))
        beta = beta.join(drawn, "marker_id", "left").select("marker_id", F.coalesce("new", "beta").alias("beta"), F.coalesce("new_k", "component").alias("component"))
        beta = save(beta)
    counts = {r.component: (r.n, r.b) for r in beta.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("beta") * F.col("beta")).alias("b")).collect()}
    cass = np.array([counts.get(k, (0, 0.0))[0] for k in range(len(h.pi))])
    sq, m0 = sum(b for _, b in counts.values()), int(cass[1:].sum())
    inv_chi = lambda dof, scale: float(1 / rng.gamma(dof / 2, 2 / (dof * scale)))
    sigma_g = inv_chi(s.v0 + m0, (sq * m0 + s.v0 * s.s0) / (s.v0 + m0)) if m0 else 0.0
    pi = tuple(rng.dirichlet(cass + 1.0).tolist()) if m0 else h.pi
    ee = eps.agg(F.sum(F.col("e") * F.col("e"))).first()[0]
    sigma_e = inv_chi(s.v0 + n, (ee + s.v0 * s.s0) / (s.v0 + n))
    return eps, beta, replace(h, iteration=it, mu=mu, sigma_g=sigma_g, sigma_e=sigma_e, pi=pi, m0=m0, h2=sigma_g / (sigma_g + sigma_e))


def run(geno: DataFrame, y: DataFrame, iterations: int, s: Settings, save, state=None):
    """Run ``iterations`` sweeps from the start or from ``state`` (eps, beta, hyper); returns the last state and the hyper-parameters
    of every sweep. ``y``: ind_id, y, standardised."""
    n = y.count()
    geno, marker = save(geno), save(stats.marker_stats(geno, n).select("marker_id", "mave", "mstd"))
    if state is None:
        state = (y.select("ind_id", F.col("y").alias("e")), marker.select("marker_id", F.lit(0.0).alias("beta"), F.lit(0).alias("component")), start(y, s))
    trace = []
    for _ in range(iterations):
        state = iterate(geno, marker, *state, s, save)
        trace.append(state[2])
    return state, trace

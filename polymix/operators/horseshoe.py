"""Gibbs chain of the regularised horseshoe in synchronisation windows.

As the Gaussian mixture chain, with one component besides zero whose variance is a marker's own: local scales are drawn per marker
from counters inside the window, the global scale, its mixing parameter and the slab on the driver. The state holds all of
them, so a chain resumes from its last sweep.

``Horseshoe`` is the model for ``chain.run``: windows and blocks, groups with a slab each, covariates, restart. ``run`` makes the chain by joins alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mixture
from ..functions import sampling
from . import chain, gibbs, stats


@dataclass(frozen=True)
class Settings:
    """``v0_local`` is odd: the local scales' gamma draws then have a whole shape and are sums of exponentials."""

    seed: int = 1
    windows: int = 4
    tau0: float = 1.0
    v0_local: int = 3
    v0_tau: float = 3.0
    v0_slab: float = 3.0
    s0_slab: float = 1.0
    v0: float = 1e-4
    s0: float = 1e-4


@dataclass(frozen=True)
class Hyper:
    iteration: int
    mu: float
    sigma_g: float
    sigma_e: float
    pi: tuple[float, float]
    tau: float
    mixing: float
    slab: float
    m0: int = 0
    h2: float = 0.0


def inverse_gamma(rng: np.random.Generator, shape: float, rate: float) -> float:
    return float(rate / rng.gamma(shape))


class Horseshoe(chain.Gaussian):
    """The model of ``chain.run``; the mixture of its settings has one component, whose value is not used. A window's markers get their scales of
    the sweep before; each draws its own anew after its effect."""

    name, scales = "horseshoe", True

    def __init__(self, s: chain.Settings, groups: int, prior: Settings = Settings()):  # noqa: B008
        super().__init__(s, groups)
        if any(len(row) != 1 for row in s.mixture):
            raise ValueError("the horseshoe has one component besides zero")
        self.prior = prior

    def start(self, y: np.ndarray, sizes: np.ndarray, features: int) -> chain.State:
        st, p, rng = super().start(y, sizes, features), self.prior, sampling.generator(self.s.seed, 1 << 40)
        mixing = inverse_gamma(rng, 0.5, 1 / p.tau0**2)
        tau = inverse_gamma(rng, p.v0_tau / 2, p.v0_tau / mixing)
        slab = tuple(inverse_gamma(rng, p.v0_slab / 2, p.v0_slab * p.s0_slab / 2) for _ in sizes)
        st.hyper = replace(st.hyper, tau=tau, mixing=mixing, slab=slab, first_local=slab[0] / max(1, int(sizes.sum())), pi=((0.5, 0.5),) * len(sizes))
        return st

    def _local(self, it: int, key: np.ndarray, slot: int, rate: np.ndarray) -> np.ndarray:
        """An inverse gamma draw per marker, of shape (1 + v0_local) / 2: a sum of exponentials where that is whole."""
        if self.prior.v0_local % 2 == 0:
            raise ValueError("v0_local must be odd")
        u = [sampling.uniform(self.s.seed, it, key, slot + i) for i in range((1 + self.prior.v0_local) // 2)]
        return rate / -sum(np.log1p(-x) for x in u)

    def draw(self, c: chain.Columns, e: np.ndarray, total: float, old: np.ndarray, h: chain.Hyper, it: int):
        n, p = len(e), self.prior
        num = c.products(e, total) + old * (n - 1.0)
        on, slab, pi = ~np.array(h.disabled)[c.grp], np.array(h.slab)[c.grp], np.array(h.pi)[c.grp]
        wide = h.tau * slab / (h.tau + slab * c.local)
        denom = n - 1.0 + h.sigma_e / wide
        mean = num / denom
        with np.errstate(divide="ignore"):
            logs = np.log(pi)
        logs[:, 1] += -0.5 * np.log(wide / h.sigma_e * (n - 1.0) + 1) + mean * num / (2 * h.sigma_e)
        k, acum = chain.choose(logs, sampling.uniform(self.s.seed, it, c.key))
        k = np.where(on, k, 0)
        new = np.where(k > 0, mean + np.sqrt(h.sigma_e / denom) * sampling.normal(self.s.seed, it, c.key), 0.0)
        nu = self._local(it, c.key, 20, p.v0_local / c.local + 1)
        return new, k, np.where(on, acum, 1.0), self._local(it, c.key, 40, 0.5 * new * new / h.tau + p.v0_local / nu)

    def after(self, st: chain.State, counts: np.ndarray, squares: np.ndarray, rng: np.random.Generator, scaled: float = 0.0) -> None:
        h, s, p, n = st.hyper, self.s, self.prior, len(st.eps)
        sigma, pi, slab, off, tau, mixing = list(h.sigma_g), list(h.pi), list(h.slab), list(h.disabled), h.tau, h.mixing
        for g in range(self.groups):
            m0 = int(counts[g, 1:].sum())
            if off[g] or m0 == 0:
                sigma[g], off[g] = 0.0, True
                continue
            mixing = inverse_gamma(rng, 0.5 + 0.5 * p.v0_tau, 1 / p.tau0**2 + 1 / tau)
            tau = inverse_gamma(rng, 0.5 * (m0 + p.v0_tau), p.v0_tau / mixing + 0.5 * scaled)
            slab[g] = sampling.inverse_scaled_chi2(rng, p.v0_slab + m0, (squares[g] * m0 + p.v0_slab * p.s0_slab) / (p.v0_slab + m0))
            sigma[g] = float(squares[g])
            pi[g] = tuple(rng.dirichlet(counts[g] + (np.array(s.dirichlet[g]) if s.dirichlet else 1.0)).tolist())
        sigma_e = sampling.inverse_scaled_chi2(rng, s.v0 + n, (float(st.eps @ st.eps) + s.v0 * s.s0) / (s.v0 + n))
        total = sum(sigma)
        st.hyper = replace(h, sigma_g=tuple(sigma), pi=tuple(pi), slab=tuple(slab), disabled=tuple(off), tau=tau, mixing=mixing, sigma_e=sigma_e, m0=int(counts[:, 1:].sum()), h2=total / (total + sigma_e))


def local_inverse_gamma(s: Settings, iteration: int, slot: int, rate: Column) -> Column:
    """A draw per marker, of shape (1 + v0_local) / 2."""
    if s.v0_local % 2 == 0:
        raise ValueError("v0_local must be odd")
    us = [mixture.uniform(s.seed, iteration, F.col("marker_id"), slot + i) for i in range((1 + s.v0_local) // 2)]
    return rate / reduce(lambda a, b: a + b, [-F.ln(1 - u) for u in us])


def lambda_tilde(tau: float, slab: float, local: Column) -> Column:
    return F.lit(tau * slab) / (F.lit(tau) + F.lit(slab) * local)


def start(y: DataFrame, s: Settings) -> Hyper:
    rng = np.random.Generator(np.random.Philox(key=s.seed))
    r = y.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    mixing = inverse_gamma(rng, 0.5, 1 / s.tau0**2)
    tau = inverse_gamma(rng, s.v0_tau / 2, s.v0_tau / mixing)
    slab = inverse_gamma(rng, s.v0_slab / 2, s.v0_slab * s.s0_slab / 2)
    return Hyper(0, 0.0, 0.0, 0.5 * r.yy / r.n, (0.5, 0.5), tau, mixing, slab)


def iterate(geno: DataFrame, marker: DataFrame, eps: DataFrame, beta: DataFrame, h: Hyper, s: Settings, save) -> tuple[DataFrame, DataFrame, Hyper]:
    """One sweep. ``marker``: marker_id, mave, mstd; ``eps``: ind_id, e; ``beta``: marker_id, beta, component, local."""
    it = h.iteration + 1
    rng = np.random.Generator(np.random.Philox(key=[s.seed, it]))
    m = eps.agg(F.count("*").alias("n"), F.sum("e").alias("s")).first()
    n = m.n
    mu = float(rng.normal((m.s + n * h.mu) / n, np.sqrt(h.sigma_e / n)))
    eps = eps.withColumn("e", F.col("e") + F.lit(h.mu - mu))
    window = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(it), "marker_id"), F.lit(s.windows))
    key = F.col("marker_id")
    for w in range(s.windows):
        mine = marker.filter(window == w)
        now = gibbs.numerators(geno, mine, eps, beta, n)
        now = now.withColumn("nu", local_inverse_gamma(s, it, 20, s.v0_local / F.col("local") + 1))
        wide = lambda_tilde(h.tau, h.slab, F.col("local"))
        now = now.withColumn("wide", wide).withColumn("denom", F.lit(n - 1.0) + F.lit(h.sigma_e) / F.col("wide"))
        mean = F.col("num") / F.col("denom")
        logs = [F.ln(F.lit(h.pi[0])), F.ln(F.lit(h.pi[1])) - 0.5 * F.ln(F.col("wide") / F.lit(h.sigma_e) * F.lit(n - 1.0) + 1) + mean * F.col("num") / F.lit(2 * h.sigma_e)]
        now = now.withColumn("k", mixture.chosen(logs, mixture.uniform(s.seed, it, key)))
        drawn = mean + F.sqrt(F.lit(h.sigma_e) / F.col("denom")) * mixture.normal(s.seed, it, key)
        now = now.withColumn("new", F.when(F.col("k") == 1, drawn).otherwise(0.0))
        local = local_inverse_gamma(s, it, 40, 0.5 * F.col("new") * F.col("new") / F.lit(h.tau) + s.v0_local / F.col("nu"))
        drawn = save(now.select("marker_id", "new", F.col("k").alias("new_k"), local.alias("new_local"), (F.col("beta") - F.col("new")).alias("delta_beta")))
        moved = stats.residual_update(geno, mine, drawn.select("marker_id", "delta_beta"), eps)
        eps = save(eps.join(moved, "ind_id").select("ind_id", (F.col("e") + F.col("delta_eps")).alias("e")))
        after = [F.coalesce(a, b).alias(b) for a, b in (("new", "beta"), ("new_k", "component"), ("new_local", "local"))]
        beta = save(beta.join(drawn, "marker_id", "left").select("marker_id", *after))
    sq = F.col("beta") * F.col("beta")
    r = beta.agg(F.count("*").alias("m"), F.count_if(F.col("component") > 0).alias("m0"), F.sum(sq).alias("sq"), F.sum(sq / F.col("local")).alias("scaled")).first()
    mixing = inverse_gamma(rng, 0.5 + 0.5 * s.v0_tau, 1 / s.tau0**2 + 1 / h.tau)
    tau = inverse_gamma(rng, 0.5 * (r.m0 + s.v0_tau), s.v0_tau / mixing + 0.5 * r.scaled)
    slab = inverse_gamma(rng, (s.v0_slab + r.m0) / 2, (r.sq * r.m0 + s.v0_slab * s.s0_slab) / 2)
    pi = tuple(rng.dirichlet([r.m - r.m0 + 1.0, r.m0 + 1.0]).tolist())
    ee = eps.agg(F.sum(F.col("e") * F.col("e"))).first()[0]
    sigma_e = inverse_gamma(rng, (s.v0 + n) / 2, (ee + s.v0 * s.s0) / 2)
    return eps, beta, replace(h, iteration=it, mu=mu, sigma_g=r.sq, sigma_e=sigma_e, pi=pi, tau=tau, mixing=mixing, slab=slab, m0=r.m0, h2=r.sq / (r.sq + sigma_e))


def run(geno: DataFrame, y: DataFrame, iterations: int, s: Settings, save, state=None):
    """``iterations`` sweeps from the start or from ``state`` (eps, beta, hyper); the last state and the trace of hyper-parameters."""
    n = y.count()
    geno, marker = save(geno), save(stats.marker_stats(geno, n).select("marker_id", "mave", "mstd"))
    if state is None:
        h = start(y, s)
        beta = marker.select("marker_id", F.lit(0.0).alias("beta"), F.lit(0).alias("component"), F.lit(h.slab / max(1, marker.count())).alias("local"))
        state = (y.select("ind_id", F.col("y").alias("e")), beta, h)
    trace = []
    for _ in range(iterations):
        state = iterate(geno, marker, *state, s, save)
        trace.append(state[2])
    return state, trace

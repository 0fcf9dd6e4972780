"""The survival model of the chain: log times with an extreme-value residual of shape alpha, effects a mixture of normals per group.

For a marker the likelihood hangs on three sums over individuals (those without a copy, with one, with two), so a marker's class is drawn from
marginal likelihoods by adaptive Gauss-Hermite quadrature, and its effect by adaptive rejection sampling, from its row alone.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ..functions import sampling
from . import chain

EULER = 0.57721566490153286
#: Variance of the intercept and the covariates' effects; shape and rate of alpha.
SIGMA_MU, ALPHA_0, KAPPA_0 = 100.0, 0.01, 0.01
NODES = (3, 5, 7, 9, 11, 13, 15, 17, 25)


def quadrature(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and weights times exp(x^2)."""
    if nodes not in NODES:
        raise ValueError(f"nodes must be one of {NODES}")
    x, w = np.polynomial.hermite.hermgauss(nodes)
    return x, w * np.exp(x * x)


def log_marginals(v: tuple[np.ndarray, np.ndarray, np.ndarray], m: np.ndarray, s: np.ndarray, sf: np.ndarray, alpha: float, variance: np.ndarray, nodes: int) -> np.ndarray:
    """Log of the integral of the likelihood over an effect, with its prior's variance, per marker. The likelihood at no effect is 1 times
    the integral of exp(-t^2)."""
    v0, v1, v2 = v
    sv = v0 + v1 + v2
    root = np.sqrt(2 * variance)
    around = (v1 * (1 - 2 * m) + 4 * (1 - m) * v2 + m * m * sv) / (s * s)
    width = 1 / np.sqrt(1 + alpha * alpha * variance * around)
    logs = []
    for x, w in zip(*quadrature(nodes), strict=True):
        t = width * x
        b = alpha * t * root
        with np.errstate(over="ignore"):
            inner = v0 * np.exp(b * m / s) + v1 * np.exp(b * (m - 1) / s) + v2 * np.exp(b * (m - 2) / s)
        logs.append(np.log(w) - b * sf + sv - inner - t * t)
    logs = np.stack(logs)
    top = logs.max(0)
    return np.log(width) + top + np.log(np.exp(logs - top).sum(0))


class Weibull:
    name, scales = "weibull", False

    def __init__(self, s: chain.Settings, groups: int, fail: np.ndarray, nodes: int = 15):
        self.s, self.groups, self.fail, self.nodes = s, groups, fail, nodes

    def start(self, y: np.ndarray, sizes: np.ndarray, features: int) -> chain.State:
        mu, alpha = float(y.mean()), float(np.pi / np.sqrt(6 * y.var(ddof=1)))
        sigma = float(np.pi**2 / (6 * alpha**2)) / self.groups
        h = chain.Hyper(0, mu, tuple(sigma if m else 0.0 for m in sizes), float(np.pi**2 / (6 * alpha**2)), chain.initial_pi(self.s.mixture), alpha=alpha, gamma=(0.0,) * features, disabled=tuple(not m for m in sizes))
        return chain.State(y - mu, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), h)

    def before(self, st: chain.State, x: np.ndarray, rng: np.random.Generator) -> None:
        h, fails = st.hyper, self.fail
        d, a, gamma = float(fails.sum()), h.alpha, list(h.gamma)
        e = st.eps + h.mu
        total = float(np.exp(a * e - EULER).sum())
        log_mu = lambda m: (-a * m * d - total * np.exp(-a * m) - m * m / (2 * SIGMA_MU), -a * d + a * total * np.exp(-a * m) - m / SIGMA_MU)
        near = float(np.log(total / d) / a) if d else h.mu  # the mode, but for the prior
        wide = 20 / (a * np.sqrt(max(d, 1.0)))
        mu = sampling.adaptive_rejection(rng, log_mu, near - wide, near + wide, (near - wide / 10, near, near + wide / 10))
        st.eps = e - mu
        for f in rng.permutation(len(gamma)):
            c, e = x[:, f], st.eps + gamma[f] * x[:, f]
            cf = float(fails @ c)

            def log_gamma(g: float, c=c, e=e, cf=cf) -> tuple[float, float]:
                v = np.exp(a * (e - c * g) - EULER)
                return -a * g * cf - v.sum() - g * g / (2 * SIGMA_MU), -a * cf + a * (c @ v) - g / SIGMA_MU

            old = gamma[f]
            gamma[f] = sampling.adaptive_rejection(rng, log_gamma, old - 0.075, old + 0.075, (old - 0.05, old, old + 0.05))
            st.eps = e - gamma[f] * c
        ef = float(st.eps @ fails)

        def log_alpha(al: float) -> tuple[float, float]:
            v = np.exp(al * st.eps - EULER)
            return (ALPHA_0 + d - 1) * np.log(al) + al * (ef - KAPPA_0) - v.sum(), (ALPHA_0 + d - 1) / al + ef - KAPPA_0 - st.eps @ v

        alpha = sampling.adaptive_rejection(rng, log_alpha, 1e-9 * a, 1.3 * a, (0.8 * a, a, 1.2 * a))
        st.hyper = replace(h, mu=mu, gamma=tuple(gamma), alpha=alpha, sigma_e=float(np.pi**2 / (6 * alpha**2)))

    def vector(self, eps: np.ndarray, h: chain.Hyper) -> np.ndarray:
        return np.exp(h.alpha * eps - EULER)

    def shifted(self, v: chain.Moved, by: float, h: chain.Hyper) -> None:
        v.factor = float(np.exp(h.alpha * by))

    def draw(self, c: chain.Columns, v: chain.Moved, total: float, old: np.ndarray, h: chain.Hyper, it: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, m, s, grp = h.alpha, c.mave, 1 / c.mstd, c.grp
        v1, v2 = c.sums("one", v), c.sums("two", v)
        # the marker's own effect taken out
        sums = tuple(x * np.exp(a * old * (k - m) / s) for k, x in enumerate((total - v1 - v2, v1, v2)))
        on = ~np.array(h.disabled)[grp]
        sigma = np.where(on, np.array(h.sigma_g)[grp], 1.0)
        scale, pi = np.array(self.s.mixture)[grp], np.array(h.pi)[grp]
        with np.errstate(divide="ignore"):
            logs = np.log(pi)
        logs[:, 0] += 0.5 * np.log(np.pi)
        for k in range(scale.shape[1]):
            logs[:, k + 1] += log_marginals(sums, m, s, c.fails, a, sigma * scale[:, k], self.nodes)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        k = np.minimum((np.cumsum(p, 1) < sampling.uniform(self.s.seed, it, c.key)[:, None]).sum(1), p.shape[1] - 1)
        k = np.where(on, k, 0)
        new, all_sigma = np.zeros(len(k)), float(sum(h.sigma_g))
        for i in np.flatnonzero(k):
            var, own, mi, si, sf = sigma[i] * scale[i, k[i] - 1], [x[i] for x in sums], m[i], s[i], c.fails[i]

            def log_beta(b: float, var=var, own=own, mi=mi, si=si, sf=sf) -> tuple[float, float]:
                t = [x * np.exp(a * b * (mi - j) / si) for j, x in enumerate(own)]
                return -a * b * sf - sum(t) - b * b / (2 * var), -a * sf - a * sum((mi - j) * x for j, x in enumerate(t)) / si - b / var

            wide = 2 * np.sqrt(all_sigma * scale[i, k[i] - 1])
            rng = sampling.generator(self.s.seed * 1_000_003 + it, int(c.key[i]))
            new[i] = sampling.adaptive_rejection(rng, log_beta, old[i] - wide, old[i] + wide, (old[i] - wide / 10, old[i], old[i] + wide / 10))
        return new, k, np.where(on, p[:, 0], 1.0)

    def after(self, st: chain.State, counts: np.ndarray, squares: np.ndarray, rng: np.random.Generator) -> None:
        h, sigma, pi = st.hyper, list(st.hyper.sigma_g), list(st.hyper.pi)
        for g in range(self.groups):
            if h.disabled[g]:
                continue
            m0 = int(counts[g, 1:].sum())
            sigma[g] = sampling.inverse_gamma(rng, 1 + 0.5 * m0, 1e-4 + 0.5 * m0 * squares[g])
            pi[g] = tuple(rng.dirichlet(counts[g] + 1.0).tolist())
        total = sum(sigma)
        st.hyper = replace(h, sigma_g=tuple(sigma), pi=tuple(pi), m0=int(counts[:, 1:].sum()), h2=total / (total + np.pi**2 / (6 * h.alpha**2)))

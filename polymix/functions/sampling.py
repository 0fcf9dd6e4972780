"""Counter-based draws in numpy, and an adaptive rejection sampler for log-concave densities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def uniform(seed: int, iteration: int, key: np.ndarray, slot: int = 0) -> np.ndarray:
    """In (0, 1), by (seed, iteration, key, slot) alone: the same for any partitioning."""
    h = _mixed(np.uint64(seed & (1 << 64) - 1))
    for x in (np.uint64(iteration), np.asarray(key).astype(np.int64).view(np.uint64), np.uint64(slot)):
        h = _mixed(h ^ x)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def normal(seed: int, iteration: int, key: np.ndarray, slot: int = 10) -> np.ndarray:
    u, v = uniform(seed, iteration, key, slot), uniform(seed, iteration, key, slot + 1)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def generator(seed: int, number: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[k & (1 << 64) - 1 for k in (seed, number)]))


def inverse_gamma(rng: np.random.Generator, shape: float, rate: float) -> float:
    return float(rate / rng.gamma(shape))


def inverse_scaled_chi2(rng: np.random.Generator, dof: float, scale: float) -> float:
    return inverse_gamma(rng, dof / 2, dof * scale / 2)


def adaptive_rejection(rng: np.random.Generator, log_density: Callable, low: float, high: float, start: tuple[float, ...], tries: int = 200) -> float:
    """A draw on (low, high) from a log-concave density. ``log_density(x)`` gives its logarithm and derivative. Tangents at the points
    met so far bound it from above, chords from below; a rejected point joins them."""
    xs = sorted({min(max(x, low + 1e-9 * (high - low)), high - 1e-9 * (high - low)) for x in start})
    met = {x: log_density(x) for x in xs}
    for _ in range(tries):
        xs = sorted(x for x, (h, d) in met.items() if np.isfinite(h) and np.isfinite(d))
        if not xs:
            raise ValueError("the density is nowhere finite at the points given")
        x, h, d = np.array(xs), np.array([met[v][0] for v in xs]), np.array([met[v][1] for v in xs])
        fall = d[:-1] - d[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = np.where(fall > 1e-12, (h[1:] - h[:-1] - x[1:] * d[1:] + x[:-1] * d[:-1]) / fall, (x[1:] + x[:-1]) / 2)
        z = np.concatenate([[low], np.clip(cut, x[:-1], x[1:]), [high]])
        left, right = h + d * (z[:-1] - x), h + d * (z[1:] - x)
        top = max(left.max(), right.max())
        width, rise = np.diff(z), right - left
        flat = np.abs(rise) < 1e-9
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            mass = np.where(flat, width * np.exp((left + right) / 2 - top), width * (np.exp(right - top) - np.exp(left - top)) / np.where(flat, 1, rise))
        mass = np.where(width > 0, mass, 0)
        k = int(rng.choice(len(x), p=mass / mass.sum()))
        u = rng.random()
        if flat[k]:
            draw = z[k] + u * width[k]
        else:  # the inverse of an exponential segment, from its higher end
            s = rise[k]
            share = np.log1p(u * np.expm1(s)) / s if s < 0 else 1 + np.log(u + (1 - u) * np.exp(-s)) / s
            draw = z[k] + share * width[k]
        draw = float(min(max(draw, low), high))
        upper, log_u = h[k] + d[k] * (draw - x[k]), np.log(rng.random())
        j = int(np.searchsorted(x, draw))
        if 0 < j < len(x):
            lower = ((x[j] - draw) * h[j - 1] + (draw - x[j - 1]) * h[j]) / (x[j] - x[j - 1])
            if log_u <= lower - upper:
                return draw
        met[draw] = log_density(draw)
        if log_u <= met[draw][0] - upper:
            return draw
    raise ValueError("no draw was accepted: the density is not log-concave")

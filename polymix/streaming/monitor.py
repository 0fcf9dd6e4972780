"""Running posterior summaries of a chain that is still being written, as a stream over its sample files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chain

SAMPLES = "iter long, marker_id long, component int, beta double"
SUMMARY = "marker_id long, last long, n long, mean double, sd double, pip double, low double, high double, rhat double"
#: Of a marker: the last sweep seen, count, mean, sum of squares about it, sweeps with an effect, the same of pieces of the chain, and a sketch of the
#: distribution (values and how many samples each stands for).
STATE = "last long, n long, mean double, m2 double, effects long, piece long, ns array<long>, means array<double>, m2s array<double>, points array<double>, weights array<double>"
#: Pieces of the chain that convergence is judged by, points of a sketch: both bounded, so a marker's state is some kilobytes whatever the length of the
#: chain.
PIECES, POINTS = 16, 64


def running_summary(spark: SparkSession, path: str, burn_in: int = 0) -> DataFrame:
    """Streaming: marker_id, n, mean, pip over the samples so far (a flat table of samples); one state row per marker. Write it in complete or update
    mode."""
    s = spark.readStream.schema(SAMPLES).parquet(path).filter(F.col("iter") >= burn_in)
    pip = F.avg(F.when(F.col("component") > 0, 1.0).otherwise(0.0))
    return s.groupBy("marker_id").agg(F.count("*").alias("n"), F.avg("beta").alias("mean"), pip.alias("pip"))


class Running:
    """The state of a marker."""

    def __init__(self, held: tuple | None):
        self.last, self.n, self.mean, self.m2, self.effects, self.piece = held[:6] if held else (-1, 0, 0.0, 0.0, 0, 1)
        self.ns, self.means, self.m2s, self.points, self.weights = (list(x) for x in held[6:]) if held else ([], [], [], [], [])

    def held(self) -> tuple:
        return self.last, self.n, self.mean, self.m2, self.effects, self.piece, self.ns, self.means, self.m2s, self.points, self.weights

    def add(self, it: int, beta: float, component: int) -> None:
        """A sweep that was seen before (it ran again after a stop) adds nothing."""
        if it <= self.last:
            return
        self.last = it
        self.n, self.mean, self.m2 = _joined((self.n, self.mean, self.m2), (1, beta, 0.0))
        self.effects += component > 0
        if not self.ns or self.ns[-1] >= self.piece:
            if len(self.ns) == PIECES:  # neighbours are put together, and pieces become twice as long
                pairs = [_joined(*((self.ns[i], self.means[i], self.m2s[i]) for i in (j, j + 1))) for j in range(0, PIECES, 2)]
                self.ns, self.means, self.m2s = map(list, zip(*pairs, strict=True))
                self.piece *= 2
            self.ns.append(0), self.means.append(0.0), self.m2s.append(0.0)
        self.ns[-1], self.means[-1], self.m2s[-1] = _joined((self.ns[-1], self.means[-1], self.m2s[-1]), (1, beta, 0.0))
        at = int(np.searchsorted(self.points, beta))
        if at < len(self.points) and self.points[at] == beta:
            self.weights[at] += 1.0
            return
        self.points.insert(at, beta)
        self.weights.insert(at, 1.0)
        if len(self.points) > POINTS:  # the two neighbours that weigh least for their distance become one
            p, w = np.array(self.points), np.array(self.weights)
            i = int(np.argmin(np.diff(p) * (w[:-1] + w[1:])))
            total = w[i] + w[i + 1]
            self.points[i : i + 2], self.weights[i : i + 2] = [float((p[i] * w[i] + p[i + 1] * w[i + 1]) / total)], [float(total)]

    def quantile(self, q: float) -> float:
        w = np.array(self.weights)
        return float(np.interp(q * w.sum(), np.cumsum(w) - w / 2, self.points))

    def rhat(self) -> float | None:
        """Split-chain convergence: the variance of both halves together against that within them."""
        pieces = list(zip(self.ns, self.means, self.m2s, strict=True))
        if self.n < 4 or len(pieces) < 2:
            return None
        halves = []
        for part in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]):
            total = part[0]
            for x in part[1:]:
                total = _joined(total, x)
            halves.append(total)
        within = sum(m2 for _, _, m2 in halves) / max(1, sum(n - 1 for n, _, _ in halves))
        if within <= 0:
            return None
        between = (halves[0][1] - halves[1][1]) ** 2 / 2
        n = min(h[0] for h in halves)
        return float(np.sqrt((n - 1) / n + between / within))

    def row(self, marker: int) -> dict:
        sd = (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else None
        return {"marker_id": marker, "last": self.last, "n": self.n, "mean": self.mean, "sd": sd, "pip": self.effects / self.n, "low": self.quantile(0.025), "high": self.quantile(0.975), "rhat": self.rhat()}


def _joined(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squares of two parts together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def chain_summary(spark: SparkSession, home: str, burn_in: int = 0, files: int = 1000) -> DataFrame:
    """Streaming over the folder that ``chain.run`` writes its sweeps to: per marker whose samples came, the last sweep, n, mean, sd, share of sweeps with an
    effect, the 2.5 and 97.5 % points (of a sketch) and split-chain convergence (null as long as it can't be told). Sweeps up to ``burn_in`` don't count.
    ``files`` bounds a micro-batch. Write it in update mode."""
    s = spark.readStream.schema(f"{chain.ROWS}, iter long, window int").option("maxFilesPerTrigger", files).parquet(f"{home}/sweeps")
    s = s.filter("part is null").filter(F.col("iter") > burn_in).select("marker_id", "iter", "beta", "component")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Running(state.get if state.exists else None)
        for r in pd.concat(list(frames)).sort_values("iter").itertuples():  # a marker's sweeps of one micro-batch
            now.add(int(r.iter), float(r.beta), int(r.component))
        state.update(now.held())
        yield pd.DataFrame([now.row(int(key[0]))])

    return s.groupBy("marker_id").applyInPandasWithState(update, SUMMARY, STATE, "update", GroupStateTimeout.NoTimeout)

"""Gibbs chains over blocks of markers.

The genotype is written once, a row per marker: either the individuals with one copy, with two and with a missing cell, or, where many cells are
not zero, the packed bytes. Rows lie by window and block: a block is a range of markers, a window some of each block's markers. A window of a
sweep is one job that reads the files of that window alone, without a shuffle of genotypes; so a sweep reads the genotype once. A task gets a
block's markers of the window and, by broadcast, the residual (a double per individual, of a counted number of them) and the effects that
aren't zero. It takes the markers in an order drawn for the sweep, each with the residual that the changes before it in the block left, and
gives back its markers' samples and the residual's change. Changes of all blocks are added up by parts in parallel before the next
window: ``sync`` is how many markers of a block lie between two such sums.

A sweep's samples, the residual and the hyper-parameters are written below ``home``; a chain started again on the same ``home``, also by another
process, goes on from the last complete sweep and draws what an unbroken one would have drawn. Hyper-parameters of all sweeps stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling
from ..sources.scratch import Store
from . import packed, stats

PART = 1 << 16
#: Residuals of this many individuals (128 MB) are broadcast; ``gibbs.run`` joins instead.
MOST_INDIVIDUALS = 1 << 24
#: Effects that aren't zero: as many are sent to each task.
MOST_EFFECTS = 1 << 22
#: Markers drawn at once as long as none of them moves; bytes of a block's markers in a window.
AT_ONCE, WINDOW_BYTES = 256, 64 << 20
MOVES = 1024
FAR = 700.0
ROWS = "marker_id long, grp int, beta double, component int, acum double, old double, local double, part int, vec binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
LISTS = ("one", "two", "miss")


def indexed(geno: DataFrame, individuals: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Cells by dense number (marker_id, ind, d), the numbers (ind_id, ind), and how many there are."""
    index = stats.dense_index(individuals.select("ind_id"), "ind_id", "ind").select("ind_id", F.col("ind").cast("int").alias("ind"))
    return geno.join(index, "ind_id").select("marker_id", "ind", "d"), index, individuals.count()


def every_list(geno: DataFrame) -> DataFrame:
    """marker_id, one, two, miss (sorted individuals) of all markers with a cell. One shuffle, by marker."""
    of = lambda d: F.sort_array(F.collect_list(F.when(stats._is(d), F.col("ind"))))
    return geno.groupBy(F.col("marker_id").cast("long").alias("marker_id")).agg(of(1).alias("one"), of(2).alias("two"), of(None).alias("miss"))


def _scaled(table: DataFrame, n: int) -> DataFrame:
    """With mave and mstd from n1, n2 and nm; markers that don't vary are left out."""
    mave, ss = stats.moments(n)
    return table.withColumns({"mave": mave, "ss": ss}).filter("ss > 0").withColumn("mstd", F.sqrt(F.lit(n - 1.0) / F.col("ss"))).drop("n1", "n2", "nm", "ss")


def marker_lists(geno: DataFrame, n: int) -> DataFrame:
    """marker_id, one, two, miss, mave, mstd; markers that don't vary are left out."""
    lists = every_list(geno)
    return _scaled(lists.withColumns({"n1": F.size("one"), "n2": F.size("two"), "nm": F.size("miss")}), n)


def represented(markers: DataFrame, individuals: int, threshold: float, keep: np.ndarray | None = None) -> DataFrame:
    """marker_id, one, two, miss, packed, n1, n2, nm: lists, or packed rows where a larger share than ``threshold`` of the cells isn't zero.

    ``markers`` has lists, packed rows or both (null where the other is). ``keep`` are the individuals that stay, sorted: cells of others are
    dropped while the rows are read, and the rest is numbered anew. No shuffle.
    """
    n = individuals if keep is None else len(keep)
    place = None
    if keep is not None:
        place = np.full(individuals, -1, np.int32)
        place[keep] = np.arange(n, dtype=np.int32)
    sent = markers.sparkSession.sparkContext.broadcast((keep, place))
    given = [c for c in (*LISTS, "packed") if c in markers.columns]

    def one(row: dict) -> dict:
        kept, at = sent.value
        if row.get("packed") is not None:
            rows = packed.rows_of(pa.array([row["packed"]], pa.binary()), individuals)
            rows = rows if kept is None else packed.chosen(rows, kept)
            size = packed.counts(rows)[0]
            if size.sum() > threshold * n:
                return {"packed": rows[0].tobytes(), **dict(zip(("n1", "n2", "nm"), size.tolist(), strict=True))}
            found = {k: v[0] for k, v in packed.lists_of(rows, n).items()}
        else:
            found = {k: np.asarray(row[k], np.int64) for k in LISTS}
            if at is not None:
                found = {k: at[v][at[v] >= 0] for k, v in found.items()}
        size = {c: len(found[k]) for c, k in zip(("n1", "n2", "nm"), LISTS, strict=True)}
        if sum(size.values()) <= threshold * n:
            return {k: v.astype(np.int32) for k, v in found.items()} | size
        codes = np.full((1, n), packed.BITS[0], np.uint8)
        for k, d in zip(LISTS, (1, 2, None), strict=True):
            codes[0, found[k]] = packed.BITS[d]
        return {"packed": packed.packed_codes(codes)[0].tobytes()} | size

    types = {**{k: pa.list_(pa.int32()) for k in LISTS}, "packed": pa.binary(), "n1": pa.int64(), "n2": pa.int64(), "nm": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # markers whose lists stay as they are go on together
            same = np.zeros(b.num_rows, bool)
            if sent.value[0] is None and "one" in given:
                sizes = {c: pa.compute.fill_null(pa.compute.list_value_length(b.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c, k in zip(("n1", "n2", "nm"), LISTS, strict=True)}
                held = b.column("one").is_valid().to_numpy(zero_copy_only=False)
                same = held & (sum(sizes.values()) <= threshold * n)
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(same)) + 1):
                part = b.slice(int(own[0]), len(own))
                if same[own[0]]:
                    columns = [*(part.column(k).cast(types[k]) for k in LISTS), pa.nulls(len(own), pa.binary()), *(pa.array(x[own]) for x in sizes.values())]
                    yield pa.RecordBatch.from_arrays([part.column("marker_id"), *columns], names=["marker_id", *types])
                    continue
                for i in range(len(own)):  # a row is a whole marker
                    row = {c: (part.column(c)[i].values.to_numpy() if c in LISTS else part.column(c)[i].as_py()) if part.column(c)[i].is_valid else None for c in given}
                    made = one(row)
                    yield pa.RecordBatch.from_arrays([part.column("marker_id").slice(i, 1), *(pa.array([made.get(c)], t) for c, t in types.items())], names=["marker_id", *types])

    ddl = "marker_id long, one array<int>, two array<int>, miss array<int>, packed binary, n1 long, n2 long, nm long"
    return markers.select(F.col("marker_id").cast("long").alias("marker_id"), *given).mapInArrow(run, ddl)


def with_failures(table: DataFrame, fail: np.ndarray) -> DataFrame:
    """With ``fails``, the failures' product with each marker's column; missing cells count as no copy."""
    sent = table.sparkSession.sparkContext.broadcast(fail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, v = Columns(b, len(sent.value)), sent.value
            yield b.append_column("fails", pa.array(c.mstd * (c.sums("one", v) + 2 * c.sums("two", v) - c.mave * v.sum())))

    return table.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", fails double")


@dataclass
class Moved:
    """A vector over the individuals, ``factor`` times ``base`` plus ``shift`` (within a mask), so that what all of them share isn't written to each."""

    base: np.ndarray
    factor: float = 1.0
    shift: float = 0.0

    def __len__(self) -> int:
        return len(self.base)


class Columns:
    """The markers of a batch as arrays; ``part`` gives some of them in a row."""

    mask: np.ndarray | None = None  # individuals whose residual moves, if not all
    sizes: dict[str, np.ndarray] | None = None

    def __init__(self, batch: pa.RecordBatch, individuals: int = 0):
        names = batch.schema.names
        self.key, self.mave, self.mstd = (batch.column(c).to_numpy() for c in ("marker_id", "mave", "mstd"))
        self.grp = batch.column("grp").to_numpy() if "grp" in names else np.zeros(len(self.key), np.int32)
        self.fails = batch.column("fails").to_numpy() if "fails" in names else None
        self.local: np.ndarray | None = None  # scales of the markers' own, of a model that has them
        self.flat, self.ends = {}, {}
        for c in LISTS:
            size = pa.compute.fill_null(pa.compute.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
            self.flat[c], self.ends[c] = batch.column(c).flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
        held = batch.column("packed").is_valid().to_numpy(zero_copy_only=False) if "packed" in names else np.zeros(len(self.key), bool)
        self.at = np.flatnonzero(held)
        self.rows = packed.rows_of(batch.column("packed").drop_null(), individuals) if len(self.at) else np.zeros((0, 0), np.uint8)

    def part(self, a: int, b: int) -> Columns:
        out = object.__new__(Columns)
        for c in ("key", "mave", "mstd", "grp"):
            setattr(out, c, getattr(self, c)[a:b])
        for c in ("fails", "local"):
            setattr(out, c, None if getattr(self, c) is None else getattr(self, c)[a:b])
        out.flat = {c: self.flat[c][self.ends[c][a] : self.ends[c][b]] for c in LISTS}
        out.ends = {c: self.ends[c][a : b + 1] - self.ends[c][a] for c in LISTS}
        x, y = np.searchsorted(self.at, (a, b))
        out.at, out.rows = self.at[x:y] - a, self.rows[x:y]
        out.mask = self.mask
        if self.sizes is not None:
            out.sizes = {c: v[a:b] for c, v in self.sizes.items()}
        return out

    def count(self, individuals: int) -> None:
        """Individuals (of the mask) of each class, which a constant is added to."""
        on = np.ones(individuals) if self.mask is None else self.mask.astype(np.float64)
        self.sizes = {c: self.sums(c, on) for c in LISTS}

    def _owners(self, name: str) -> np.ndarray:
        return np.repeat(np.arange(len(self.key)), np.diff(self.ends[name]))

    def sums(self, name: str, vector: np.ndarray | Moved) -> np.ndarray:
        if isinstance(vector, Moved):
            out = vector.factor * self.sums(name, vector.base)
            return out + vector.shift * self.sizes[name] if vector.shift else out
        out = np.bincount(self._owners(name), weights=vector[self.flat[name]], minlength=len(self.key)).astype(np.float64)
        if len(self.at):
            out[self.at] += packed.sums(self.rows, vector, name)
        return out

    def products(self, e: np.ndarray | Moved, total: float) -> np.ndarray:
        """Of the standardised columns with a vector; missing cells count as zero."""
        return self.mstd * (self.sums("one", e) + 2 * self.sums("two", e) - self.mave * (total - self.sums("miss", e)))

    def change(self, delta: np.ndarray, out: np.ndarray) -> None:
        """Add each standardised column times its marker's delta."""
        a = self.mstd * delta
        out -= (a * self.mave).sum()
        for name, weight in (("one", a), ("two", 2 * a), ("miss", a * self.mave)):
            flat = self.flat[name]
            if len(self.key) == 1:  # individuals of a marker are distinct
                out[flat] += weight[0]
            elif len(flat):
                out += np.bincount(flat, weights=weight[self._owners(name)], minlength=len(out))
        if len(self.at):
            packed.change(self.rows, a[self.at], (a * self.mave)[self.at], out)


    def places(self) -> np.ndarray | slice:
        """Individuals (of the mask) with a cell of the one marker here; all, if it is packed."""
        if len(self.at):
            return slice(None)
        out = np.concatenate([self.flat[c] for c in LISTS])
        return out if self.mask is None else out[self.mask[out]]

    def move(self, delta: float, out: np.ndarray) -> float:
        """Add the one marker's column times delta, but for a constant that all individuals (of the mask) get; the constant."""
        a, m = float(self.mstd[0]) * delta, float(self.mave[0])
        for name, weight in (("one", a), ("two", 2 * a), ("miss", a * m)):
            at = self.flat[name]
            out[at if self.mask is None else at[self.mask[at]]] += weight
        if len(self.at):
            packed.change(self.rows, np.array([a]), np.array([a * m]), out)
            if self.mask is not None:
                out[~self.mask] = 0.0
        return -a * m


def _parts(vector: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(vector), PART)
    vecs = [vector[a : a + PART].tobytes() for a in cuts]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(NAMES, types, strict=True)))
    empty = [pa.nulls(len(vecs), t) for t in types[:7]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(range(len(vecs)), pa.int32()), pa.array(vecs, pa.binary())], schema=schema)


def added(rows: DataFrame) -> DataFrame:
    """part, vec: partial vectors added up, each part in a task of its own."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for v in (v for b in batches for v in b.column("vec")):
            x = np.frombuffer(v.as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "vec"])

    return rows.filter("part is not null").select("part", "vec").groupBy("part").applyInArrow(add, "part int, vec binary")


def residual_change(table: DataFrame, moved: DataFrame, n: int) -> DataFrame:
    """ind, delta_eps: the sum over markers of delta_beta times the standardised column. ``table`` has lists, packed rows or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n)
        for b in batches:
            Columns(b, n).change(b.column("delta_beta").to_numpy(), out)
        yield _parts(out)

    return _spread(added(table.join(moved, "marker_id").mapInArrow(run, ROWS)))


def packed_change(geno: DataFrame, moved: DataFrame, n: int) -> DataFrame:
    """As ``residual_change``, of cells (marker_id, ind, d): all markers are packed, in tiles, and change the residual from there."""

    def run(tiles: Iterator[packed.Tiles]) -> Iterator[pa.RecordBatch]:
        out, flat = np.zeros(n), 0.0
        for t in tiles:
            n1, n2, nm = t.counts().T
            with np.errstate(divide="ignore", invalid="ignore"):
                mave = (n1 + 2 * n2) / (n - nm)
                ss = n1 * (1 - mave) ** 2 + n2 * (2 - mave) ** 2 + (n - nm - n1 - n2) * mave**2
                a = np.where(ss > 0, np.sqrt((n - 1) / ss), 0.0) * t.value
            mean = np.where(ss > 0, a * mave, 0.0)
            t.change(a, mean, out)
            flat += mean.sum()
        yield _parts(out - flat)

    value = moved.select(F.col("marker_id").cast("long").alias("marker_id"), F.col("delta_beta").cast("double").alias("value"))
    return _spread(added(packed.by_tiles(geno, run, ROWS, value)))


def _spread(parts: DataFrame) -> DataFrame:
    """ind, delta_eps of part, vec."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, vec in zip(b.column("part").to_pylist(), b.column("vec"), strict=True):
                x = np.frombuffer(vec.as_buffer(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array((part * PART + np.arange(len(x))).astype(np.int32)), pa.array(x)], names=["ind", "delta_eps"])

    return parts.mapInArrow(spread, "ind int, delta_eps double")


@dataclass(frozen=True)
class Settings:
    """``mixture``, ``priors`` (v0, s0) and ``dirichlet`` hold a row per group; a single row of ``mixture`` serves all groups. A sweep's
    samples are kept every ``thin`` sweeps. ``sync``: markers of a block between two sums of the residual's changes; where it isn't given, a
    sweep has ``windows`` of them. ``threshold``: markers with a larger share of cells that aren't zero are kept packed.
    ``shuffle``: markers and windows come in a new order each sweep."""

    seed: int = 1
    windows: int = 4
    mixture: tuple[tuple[float, ...], ...] = ((0.001, 0.01, 0.1),)
    priors: tuple[tuple[float, float], ...] | None = None
    dirichlet: tuple[tuple[float, ...], ...] | None = None
    v0: float = 1e-4
    s0: float = 1e-4
    thin: int = 1
    blocks: int = 8
    sync: int | None = None
    threshold: float = 0.06
    shuffle: bool = True


@dataclass(frozen=True)
class Hyper:
    iteration: int
    mu: float
    sigma_g: tuple[float, ...]
    sigma_e: float
    pi: tuple[tuple[float, ...], ...]
    m0: int = 0
    h2: float = 0.0
    alpha: float = 0.0
    gamma: tuple[float, ...] = ()
    disabled: tuple[bool, ...] = field(default=())
    # of the horseshoe: global scale, its mixing parameter, the groups' slabs and the scales that markers begin with
    tau: float = 0.0
    mixing: float = 0.0
    slab: tuple[float, ...] = ()
    first_local: float = 0.0


@dataclass
class State:
    eps: np.ndarray
    key: np.ndarray  # markers whose effect isn't zero, sorted
    beta: np.ndarray
    component: np.ndarray
    hyper: Hyper


def initial_pi(mixture) -> tuple[tuple[float, ...], ...]:
    return tuple((0.5, *(0.5 * np.array(row) / sum(row)).tolist()) for row in mixture)


def choose(logs: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component per row, and the probability of the first: shares are 0 where log weights differ beyond ``FAR``."""
    with np.errstate(over="ignore"):
        share = [1 / np.exp(logs - logs[:, [m]]).sum(1) for m in range(logs.shape[1])]
    far = lambda m, rest: (np.abs(logs[:, rest] - logs[:, [m]]) > FAR).any(1)
    acum = first = np.where(far(0, slice(1, None)), 0.0, share[0])
    out = np.full(len(logs), logs.shape[1] - 1)
    open_ = np.ones(len(logs), bool)
    for m in range(logs.shape[1] - 1):
        if m:
            acum = acum + np.where(far(m, slice(m + 1, None)), 0.0, share[m])
        take = open_ & (u <= acum)
        out[take] = m
        open_ &= ~take
    return out, first


class Gaussian:
    """Mixture of normals per group, normal residual."""

    name = "gaussian"
    #: Individuals whose trait is known, if not all; whether markers have scales of their own.
    n: int | None = None
    scales = False

    def __init__(self, s: Settings, groups: int):
        self.s, self.groups = s, groups

    def shifted(self, e: Moved, by: float, h: Hyper) -> None:
        """The vector of a residual to whose every individual ``by`` is added."""
        e.shift = by

    def start(self, y: np.ndarray, sizes: np.ndarray, features: int) -> State:
        rng = sampling.generator(self.s.seed)
        sigma = tuple(float(rng.beta(1, 1)) if m else 0.0 for m in sizes)
        h = Hyper(0, 0.0, sigma, float(0.5 * (y * y).mean()), initial_pi(self.s.mixture), gamma=(0.0,) * features, disabled=tuple(not m for m in sizes))
        return State(y.copy(), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), h)

    def before(self, st: State, x: np.ndarray, rng: np.random.Generator) -> None:
        h, n = st.hyper, len(st.eps)
        mu = float(rng.normal((st.eps.sum() + n * h.mu) / n, np.sqrt(h.sigma_e / n)))
        st.eps += h.mu - mu
        gamma = list(h.gamma)
        for f in rng.permutation(len(gamma)):
            num = float(x[:, f] @ (st.eps + gamma[f] * x[:, f]))
            denom = n - 1.0 + h.sigma_e  # the effects' variance is 1
            new = float(rng.normal(num / denom, np.sqrt(h.sigma_e / denom)))
            st.eps += (gamma[f] - new) * x[:, f]
            gamma[f] = new
        st.hyper = replace(h, mu=mu, gamma=tuple(gamma))

    def vector(self, eps: np.ndarray, h: Hyper) -> np.ndarray:
        return eps

    def draw(self, c: Columns, e: np.ndarray, total: float, old: np.ndarray, h: Hyper, it: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, grp = self.n or len(e), c.grp
        num = c.products(e, total) + old * (n - 1.0)
        on = ~np.array(h.disabled)[grp]
        sigma = np.where(on, np.array(h.sigma_g)[grp], 1.0)
        scale, pi = np.array(self.s.mixture)[grp], np.array(h.pi)[grp]
        denom = n - 1.0 + (h.sigma_e / sigma)[:, None] / scale
        mean = num[:, None] / denom
        with np.errstate(divide="ignore"):
            logs = np.log(pi)
        logs[:, 1:] += -0.5 * np.log((sigma / h.sigma_e)[:, None] * (n - 1.0) * scale + 1) + mean * num[:, None] / (2 * h.sigma_e)
        k, acum = choose(logs, sampling.uniform(self.s.seed, it, c.key))
        k = np.where(on, k, 0)
        at = np.maximum(k - 1, 0)
        rows = np.arange(len(k))
        drawn = mean[rows, at] + np.sqrt(h.sigma_e / denom[rows, at]) * sampling.normal(self.s.seed, it, c.key)
        return np.where(k > 0, drawn, 0.0), k, np.where(on, acum, 1.0)

    def after(self, st: State, counts: np.ndarray, squares: np.ndarray, rng: np.random.Generator) -> None:
        h, s, n = st.hyper, self.s, len(st.eps)
        sigma, pi, off = list(h.sigma_g), list(h.pi), list(h.disabled)
        for g in range(self.groups):
            m0 = int(counts[g, 1:].sum())
            if off[g] or m0 == 0:
                sigma[g], off[g] = 0.0, True  # a group without effects stays without
                continue
            v0, s0 = s.priors[g] if s.priors else (s.v0, s.s0)
            sigma[g] = sampling.inverse_scaled_chi2(rng, v0 + m0, (squares[g] * m0 + v0 * s0) / (v0 + m0))
            pi[g] = tuple(rng.dirichlet(counts[g] + (np.array(s.dirichlet[g]) if s.dirichlet else 1.0)).tolist())
        sigma_e = sampling.inverse_scaled_chi2(rng, s.v0 + n, (float(st.eps @ st.eps) + s.v0 * s.s0) / (s.v0 + n))
        total = sum(sigma)
        st.hyper = replace(h, sigma_g=tuple(sigma), pi=tuple(pi), disabled=tuple(off), sigma_e=sigma_e, m0=int(counts[:, 1:].sum()), h2=total / (total + sigma_e))


def _write_state(store: Store, st: State, name: str) -> None:
    """A row per part of each vector; the task that writes them gets the vectors by broadcast, rows by rows through the driver would be held there many times."""
    given = {"hyper": np.frombuffer(json.dumps(asdict(st.hyper)).encode(), np.uint8), "eps": st.eps, "key": st.key, "beta": st.beta, "component": st.component.astype(np.int32)}
    parts = [(n, i // PART) for n, a in given.items() for i in (range(0, len(a), PART) if n != "hyper" else (0,))]
    sent = store.spark.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, i in zip(b.column("name").to_pylist(), b.column("part").to_pylist(), strict=True):
                a = sent.value[n]
                vec = (a if n == "hyper" else a[i * PART : (i + 1) * PART]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([i], pa.int32()), pa.array([vec], pa.binary())], names=["name", "part", "vec"])

    store.write(store.spark.createDataFrame(parts, "name string, part int").coalesce(1).mapInArrow(run, "name string, part int, vec binary"), name)
    sent.destroy()


def _hyper_of(text: bytes | str) -> Hyper:
    deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x  # noqa: E731  (JSON has no tuples)
    return Hyper(**{k: deep(v) for k, v in json.loads(text).items()})


def _state_of(rows) -> State:
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows:
        found.setdefault(r["name"], []).append((r["part"], bytes(r["vec"])))
    a = {k: np.frombuffer(b"".join(x for _, x in sorted(found.get(k, []))), t).copy() for k, t in (("eps", np.float64), ("key", np.int64), ("beta", np.float64), ("component", np.int32))}
    return State(**a, hyper=_hyper_of(found["hyper"][0][1]))


def swept(c: Columns, eps: np.ndarray, model, h: Hyper, it: int, old: np.ndarray) -> list[np.ndarray]:
    """One update of each marker in its order, with the residual (changed in place) that the changes before it left: effect, component,
    the first component's probability, and the marker's own scale if the model has one. Markers are drawn some at a time; up to the first that moves,
    nothing that they saw has changed. A move costs what the marker's cells do: what it adds to all individuals is kept as one number, and put into the
    residual every ``MOVES`` moves, when sums are taken anew as well."""
    n = len(old)
    outs = [np.zeros(n), np.zeros(n, np.int64), np.zeros(n), *([np.zeros(n)] if c.local is not None else [])]
    new = outs[0]
    known = len(eps) if c.mask is None else int(c.mask.sum())
    c.count(len(eps))
    a, many, moved, by = 0, 16, 0, 0.0

    def settled() -> tuple[Moved, float]:
        if by:
            eps[slice(None) if c.mask is None else c.mask] += by
        e = Moved(model.vector(eps, h))
        return e, float(e.base.sum())

    e, sum_ = settled()
    while a < n:
        b = min(n, a + many)
        drawn = model.draw(c.part(a, b), e, e.factor * sum_ + e.shift * known, old[a:b], h, it)
        moves = np.flatnonzero(drawn[0] != old[a:b])
        stop = a + int(moves[0]) + 1 if len(moves) else b
        for out, x in zip(outs, drawn, strict=True):
            out[a:stop] = x[: stop - a]
        if len(moves):
            one = c.part(stop - 1, stop)
            at = one.places()
            was = float(e.base[at].sum())
            by += one.move(float(old[stop - 1] - new[stop - 1]), eps)
            moved += 1
            if moved % MOVES == 0:
                e, sum_ = settled()
                by = 0.0
            else:
                if e.base is not eps:
                    e.base[at] = model.vector(eps[at], h)
                sum_ += float(e.base[at].sum()) - was
                model.shifted(e, by, h)
        many = max(1, many // 2) if len(moves) else min(AT_ONCE, 2 * many)
        a = stop
    settled()
    return outs


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block as one batch. Blocks of a window lie in files of their own, bounded by ``WINDOW_BYTES``."""
    held, now = [], None
    for b in batches:
        blocks = b.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y == x:
                continue
            if held and blocks[x] != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = blocks[x]
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def found(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: float) -> np.ndarray:
    """Of each key its value, by the sorted ``known`` ones."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return np.where(known[at] == keys, values[at], otherwise) if len(known) else np.full(len(keys), otherwise)


def window(table: DataFrame, model, st: State, it: int, w: int, s: Settings, local: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, Broadcast]:
    """The samples of the window's markers, and each block's change of the residual. ``local``: markers and their own scales. Also what the tasks are sent, to
    be given up once the rows are written."""
    sent = table.sparkSession.sparkContext.broadcast((st.eps, st.key, st.beta, st.hyper, local))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eps, key, beta, h, own_scales = sent.value
        for b in _by_block(batches):
            draw = sampling.uniform(s.seed, it, b.column("marker_id").to_numpy(), 5) if s.shuffle else b.column("marker_id").to_numpy()
            c = Columns(b.take(pa.array(np.argsort(draw, kind="stable"))), len(eps))
            old, own = found(c.key, key, beta, 0.0), eps.copy()
            if own_scales is not None:
                c.local = found(c.key, *own_scales, h.first_local)
            new, k, acum, *scale = swept(c, own, model, h, it, old)
            yield sample_rows(c, new, k, acum, old, *scale)
            if (old != new).any():
                yield _parts(own - eps)

    return table.filter(F.col("window") == w).mapInArrow(run, ROWS), sent


def sample_rows(c: Columns, new: np.ndarray, k: np.ndarray, acum: np.ndarray, old: np.ndarray, scale: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(c.key)
    cols = [pa.array(c.key), pa.array(c.grp.astype(np.int32)), pa.array(new), pa.array(k.astype(np.int32)), pa.array(acum), pa.array(old), pa.nulls(n, pa.float64()) if scale is None else pa.array(scale), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def _own_scales(store: Store, it: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the window's markers, from the sweep before: as many as a window holds, which are sent to its tasks."""
    if it == 1:
        return np.zeros(0, np.int64), np.zeros(0)
    rows = store.read(f"sweeps/iter={it - 1}/window={w}").filter("part is null").select("marker_id", "local")
    if rows.count() > MOST_EFFECTS:
        raise ValueError("too many markers in a window to send their scales: take more windows")
    key, local = stats.arrays(rows)
    order = np.argsort(key)
    return key[order], local[order]


def updated(st: State, key: np.ndarray, beta: np.ndarray, component: np.ndarray) -> None:
    """Markers that have or had an effect, in a window; the others stay as they are."""
    on, stay = component > 0, ~np.isin(st.key, key)
    key = np.concatenate([st.key[stay], key[on]])
    order = np.argsort(key)
    st.beta, st.component = np.concatenate([st.beta[stay], beta[on]])[order], np.concatenate([st.component[stay], component[on]])[order]
    st.key = key[order]


def sweep(table: DataFrame, store: Store, model, st: State, x: np.ndarray, s: Settings, windows: int, kept: Callable[[Hyper], None] | None = None) -> State:
    it = st.hyper.iteration + 1
    rng = sampling.generator(s.seed, it)
    model.before(st, x, rng)
    groups, k = model.groups, len(s.mixture[0]) + 1
    counts, squares, scaled = np.zeros((groups, k)), np.zeros(groups), 0.0
    for w in rng.permutation(windows).tolist() if s.shuffle else range(windows):
        rows, sent = window(table, model, st, it, w, s, _own_scales(store, it, w) if model.scales else None)
        rows = store.write(rows, f"sweeps/iter={it}/window={w}")
        sent.destroy()
        own = rows.filter("part is null")
        for r in own.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum(F.col("beta") * F.col("beta")).alias("b"), F.sum(F.col("beta") * F.col("beta") / F.col("local")).alias("q")).collect():
            counts[r.grp, r.component] += r.n
            squares[r.grp] += r.b
            scaled += r.q or 0.0
        for r in added(rows).collect():
            st.eps[r.part * PART : (r.part + 1) * PART] += np.frombuffer(r.vec, np.float64)
        if counts[:, 1:].sum() > MOST_EFFECTS:
            raise ValueError("too many effects to send to each task: use gibbs.run, which joins")
        # effects of other windows stay as they are
        updated(st, *stats.arrays(own.filter("component > 0 or old <> 0").select("marker_id", "beta", "component")))
    model.after(st, counts, squares, rng, *([scaled] if model.scales else []))
    st.hyper = replace(st.hyper, iteration=it)
    # before the state: a sweep that is stopped between them runs again and replaces what it wrote here
    store.write(store.spark.createDataFrame([(json.dumps(asdict(st.hyper)),)], "hyper string").coalesce(1), f"hypers/iter={it}")
    if kept is not None and it % s.thin == 0:
        kept(st.hyper)
    _write_state(store, st, f"states/iter={it}")
    store.drop(f"states/iter={it - 2}")
    if (it - 1) % s.thin:
        store.drop(f"sweeps/iter={it - 1}")
    return st


def laid_out(table: DataFrame, s: Settings, blocks: DataFrame | None) -> DataFrame:
    """With block and window: blocks are ranges of markers, as even as can be or as given (block, start, end: places from 1, inclusive); a
    marker's window in its block is drawn once."""
    table = stats.dense_index(table, "marker_id", "place")
    many = table.count()
    if blocks is None:
        table = table.withColumn("block", stats.block_of(F.col("place"), many, max(1, min(s.blocks, many))))
        largest = -(-many // max(1, min(s.blocks, many)))
    else:
        bounds = blocks.select("block", F.col("start").alias("_s"), F.col("end").alias("_e"))  # a row per block of work
        table = table.join(F.broadcast(bounds), (F.col("place") + 1 >= F.col("_s")) & (F.col("place") + 1 <= F.col("_e"))).drop("_s", "_e")
        largest = blocks.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
    size = F.coalesce(F.length("packed"), 4 * (F.size("one") + F.size("two") + F.size("miss")))
    most = table.groupBy("block").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0
    windows = max(-(-largest // s.sync) if s.sync else s.windows, -(-most // WINDOW_BYTES), 1)
    return table.withColumn("window", F.pmod(F.xxhash64(F.lit(s.seed), "marker_id"), F.lit(windows)).cast("int")).withColumn("windows", F.lit(windows)).drop("place")


def prepared(store: Store, table: DataFrame, s: Settings, groups: DataFrame | None, blocks: DataFrame | None) -> DataFrame:
    """The genotype of the chain, written once: a folder per window, a file per block in it, so that a window reads its files alone and a task
    whole blocks."""
    if not store.has("lists"):
        if groups is not None:
            table = table.join(groups.select(F.col("marker_id").cast("long").alias("marker_id"), F.col("grp").cast("int").alias("grp")), "marker_id", "left")
        else:
            table = table.withColumn("grp", F.lit(0))
        table = laid_out(store.write(table.withColumn("grp", F.coalesce("grp", F.lit(0))), "table"), s, blocks)
        rows = table.repartition("window", "block").sortWithinPartitions("window", "block", "marker_id")
        rows.write.mode("overwrite").option("parquet.block.size", 4 * WINDOW_BYTES).partitionBy("window", "block").parquet(f"{store.home}/lists")
        store.drop("table")
    return store.read("lists")


def run(
    spark: SparkSession, geno: DataFrame | None, y: DataFrame, iterations: int, s: Settings, home: str | None = None, groups: DataFrame | None = None,
    covariates: DataFrame | None = None, fail: DataFrame | None = None, model: Callable = Gaussian, markers: DataFrame | None = None,
    individuals: int = 0, blocks: DataFrame | None = None, resume: bool | None = None, kept: Callable[[Hyper], None] | None = None,
) -> tuple[State, list[Hyper], Store]:
    """Sweeps up to number ``iterations``, from the last complete one below ``home`` if there is any (``resume``: there must be one, or there must
    be none). A chain is only taken up with the settings that it began with.

    ``geno``: ind_id, marker_id, d; ``y``: ind_id, y; ``groups``: marker_id, grp (from 0; markers without a row are in group 0);
    ``covariates``: ind_id, x (array of doubles); ``fail``: ind_id, fail, for the survival model; ``blocks``: block, start, end. Instead of ``geno``,
    ``markers`` may give marker_id with lists or packed rows over ``individuals`` places, which are the ``ind_id`` of ``y``; places without a row
    there are dropped as the rows are read. ``kept`` is called with the hyper-parameters of each sweep whose samples are kept, before the sweep counts
    as complete (so perhaps twice, for a sweep that was stopped). Returns the last state,
    the hyper-parameters of the sweeps made now, and the store (``samples`` reads the kept sweeps).
    """
    store = Store(spark, home)
    last = store.last("states", "iter")
    if resume is not None and resume != bool(last):
        raise ValueError("there is no complete sweep to go on from" if resume else "the folder already holds a chain")
    known = y.select("ind_id")
    n = known.count()
    if n > MOST_INDIVIDUALS:
        raise ValueError("too many individuals to broadcast a residual: use gibbs.run, which joins")
    given = json.dumps(asdict(s) | {"model": getattr(model, "func", model).name, "individuals": n}, sort_keys=True)
    if store.has("settings"):
        if (began := store.read("settings").first()["settings"]) != given:
            raise ValueError(f"the chain began with other settings: {began}")
    else:
        store.write(spark.createDataFrame([(given,)], "settings string").coalesce(1), "settings")
    if not store.has("index"):
        index = stats.dense_index(known, "ind_id", "ind").select("ind_id", F.col("ind").cast("int").alias("ind"))
        store.write(index, "index")
    index = store.read("index")
    wide = y.join(index, "ind_id").select("ind", "y", "ind_id")
    if covariates is not None:
        wide = wide.join(covariates, "ind_id")
    if fail is not None:
        wide = wide.join(fail.select("ind_id", F.col("fail").cast("double").alias("fail")), "ind_id")
    # column by column, as vectors: a double per individual, of a counted number of them
    wide = store.write(wide.drop("ind_id"), "people")
    if wide.count() != n:
        raise ValueError("covariates or failures are missing for some individuals")
    features = (wide.agg(F.max(F.size("x"))).first()[0] or 0) if covariates is not None else 0
    x = np.zeros((n, features), order="F")
    for f in range(features):
        x[:, f] = stats.vector(wide.select("ind", F.col("x")[f].alias("x")), "ind", "x", n)
    fails = None if fail is None else stats.vector(wide, "ind", "fail", n)
    first = None if last else stats.vector(wide, "ind", "y", n)
    store.drop("people")
    if not store.has("lists"):
        if markers is None:
            table = represented(every_list(geno.join(index, "ind_id").select("marker_id", "ind", "d")), n, s.threshold)
        else:
            keep = np.sort(stats.arrays(index.select("ind_id"))[0].astype(np.int64))  # counted above
            table = represented(markers, individuals, s.threshold, None if n == individuals else keep)
        table = _scaled(table, n)
        if fail is not None:
            table = with_failures(table, fails)
        prepared(store, table, s, groups, blocks)
    table = store.read("lists")
    facts = table.groupBy("grp").agg(F.count("*").alias("n"), F.max("windows").alias("w")).collect()
    sizes, windows = {r.grp: r.n for r in facts}, max((r.w for r in facts), default=1)
    count = max([*sizes, len(s.mixture) - 1]) + 1
    if len(s.mixture) == 1 and count > 1:
        s = replace(s, mixture=s.mixture * count)
    if any(v is not None and len(v) != count for v in (s.mixture, s.priors, s.dirichlet)):
        raise ValueError("mixtures and priors need a row per group")
    m = model(s, count) if fail is None else model(s, count, fails)
    st = _state_of(store.read(f"states/iter={last}").collect()) if last else m.start(first, np.array([sizes.get(g, 0) for g in range(count)]), x.shape[1])
    trace = []
    while st.hyper.iteration < iterations:
        st = sweep(table, store, m, st, x, s, windows, kept)
        trace.append(st.hyper)
    return st, trace, store


def samples(store: Store, thin: int = 1) -> DataFrame:
    """iter, marker_id, grp, beta, component, acum of the complete sweeps that were kept."""
    rows = store.read("sweeps").filter("part is null")
    last = store.last("states", "iter") or 0
    return rows.filter((F.col("iter") % thin == 0) & (F.col("iter") <= last)).select("iter", "marker_id", "grp", "beta", "component", "acum")


def hypers(store: Store) -> DataFrame:
    """The hyper-parameters of all complete sweeps: iter, mu, sigma_g, sigma_e, alpha, h2, m0, pi, gamma (columns of the text files, see
    ``chain_files``). A row per sweep."""
    last = store.last("states", "iter") or 0
    rows = store.read("hypers").filter(F.col("iter") <= last).select("iter", "hyper")
    shape = "mu double, sigma_g array<double>, sigma_e double, alpha double, h2 double, m0 int, pi array<array<double>>, gamma array<double>"
    return rows.select(F.col("iter").cast("int").alias("iter"), F.from_json("hyper", shape).alias("h")).select("iter", "h.*")

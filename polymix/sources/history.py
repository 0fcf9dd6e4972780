"""Data source ``chainhistory``: what a chain keeps of each sweep, in the files of its model.

``kind`` names the file: ``csv`` (a line of hyper-parameters per kept sweep), ``gam`` (a line of covariates' effects, survival model) or ``mus``
(binary: an unsigned 32-bit iteration and a double). Tasks make the records; the commit, on the driver, adds them to the file: a record
per kept sweep, some hundred bytes each. Records from the first new iteration on are replaced, so a sweep that runs again after a stop leaves
one record, and nothing is seen of a write that is aborted.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .places import local_path

#: Fixed formats of the files.
NUMBER, MUS = "%20.15f", struct.Struct("<Id")
COLUMNS = "iter int, mu double, sigma_g array<double>, sigma_e double, alpha double, h2 double, m0 int, pi array<array<double>>, gamma array<double>"


def line(kind: str, model: str, r: Row) -> bytes:
    if kind == "mus":
        return MUS.pack(r.iter, r.mu)
    number = lambda x: NUMBER % x
    if kind == "gam":
        return ", ".join(["%5d" % r.iter, *map(number, r.gamma)]).encode() + b"\n"
    groups, shares = "%4d" % len(r.sigma_g), [x for row in r.pi for x in row]
    sizes = [groups, "%2d" % len(r.pi[0])]
    if model == "gaussian":
        parts = ["%5d" % r.iter, groups, *map(number, r.sigma_g), number(r.sigma_e), number(r.h2), "%7d" % r.m0, *sizes, *map(number, shares)]
    else:
        parts = ["%5d" % r.iter, number(r.mu), number(sum(r.sigma_g)), number(r.alpha), number(r.h2), "%7d" % r.m0, *sizes, *map(number, r.sigma_g), *map(number, shares)]
    return ", ".join(parts).encode() + b"\n"


def records(kind: str, held: bytes) -> list[tuple[int, bytes]]:
    """(iteration, record) of a file; a record that was cut short is left out."""
    if kind == "mus":
        whole = len(held) - len(held) % MUS.size
        return [(MUS.unpack_from(held, a)[0], held[a : a + MUS.size]) for a in range(0, whole, MUS.size)]
    return [(int(x.split(b",")[0]), x) for x in held.splitlines(keepends=True) if x.endswith(b"\n") and x.strip()]


@dataclass
class Made(WriterCommitMessage):
    found: list[tuple[int, bytes]]


class HistoryWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.model, self.overwrite = options["path"], options.get("kind", "csv"), options.get("model", "gaussian"), overwrite
        if self.kind not in ("csv", "gam", "mus") or self.model not in ("gaussian", "weibull"):
            raise ValueError("kind is csv, gam or mus, model gaussian or weibull")

    def write(self, rows: Iterator[Row]) -> Made:
        found = [(r.iter, line(self.kind, self.model, r)) for r in rows]
        if any(i < 1 for i, _ in found):
            raise ValueError("iteration 0 is no sweep")
        return Made(found)

    def commit(self, messages: list[Made | None]) -> None:
        path, new = local_path(self.path), sorted(x for m in messages if m is not None for x in m.found)
        old = []
        if not self.overwrite and os.path.exists(path):
            with open(path, "rb") as f:
                old = records(self.kind, f.read())
        first = new[0][0] if new else 1 << 62
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.draft", "wb") as f:
            f.writelines(x for i, x in [*(o for o in old if o[0] < first), *new])
        os.replace(f"{path}.draft", path)

    def abort(self, messages: list[Made | None]) -> None:
        """Nothing was written."""


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.model = options["path"], options.get("kind", "csv"), options.get("model", "gaussian")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one file of a line per kept sweep

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(local_path(self.path), "rb") as f:
            held = f.read()
        for it, x in records(self.kind, held):
            if self.kind == "mus":
                yield it, MUS.unpack(x)[1], None, None, None, None, None, None, None
                continue
            f = [v.strip().decode() for v in x.split(b",")]
            if self.kind == "gam":
                yield it, None, None, None, None, None, None, None, [float(v) for v in f[1:]]
                continue
            if self.model == "gaussian":
                g = int(f[1])
                sigma, rest = [float(v) for v in f[2 : 2 + g]], f[2 + g :]
                e, h2, m0, k, pi = float(rest[0]), float(rest[1]), int(rest[2]), int(rest[4]), [float(v) for v in rest[5:]]
                mu = alpha = None
            else:
                mu, alpha, h2, m0, g, k = float(f[1]), float(f[3]), float(f[4]), int(f[5]), int(f[6]), int(f[7])
                sigma, pi, e = [float(v) for v in f[8 : 8 + g]], [float(v) for v in f[8 + g :]], None
            if len(pi) != g * k:
                raise ValueError(f"the line of iteration {it} does not fit its groups and components")
            yield it, mu, sigma, e, alpha, h2, m0, [pi[i * k : (i + 1) * k] for i in range(g)], None


class HistorySource(DataSource):
    """``df.write.format("chainhistory").option("kind", ...).option("model", ...).mode("append").save(path)``, columns as ``chain.hypers``."""

    @classmethod
    def name(cls) -> str:
        return "chainhistory"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def writer(self, schema, overwrite: bool) -> HistoryWriter:
        return HistoryWriter(self.options, overwrite)

"""Files of a chain: the text of hyper-parameters, and binary samples (an unsigned 32-bit count M, then records of an unsigned 32-bit
iteration and M values, doubles or 32-bit integers, little-endian)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import places

#: Markers without a row that are written as zeros between others.
GAP = 1 << 16
TYPES = {"double": ("<f8", pa.float64(), "double"), "int": ("<i4", pa.int32(), "int")}


def open_fs(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def hyper_lines(h: DataFrame) -> DataFrame:
    """A line per iteration: iter, G, variance of each group, residual variance, h2, markers in the model, G, K, shares by group. ``h``: iter,
    sigma_g, sigma_e, h2, m0, pi."""
    number = lambda c: F.format_string("%20.15f", c)
    many = lambda a: F.array_join(F.transform(a, number), ", ")
    groups = F.format_string("%4d", F.size("sigma_g"))
    parts = [F.format_string("%5d", F.col("iter").cast("long")), groups, many(F.col("sigma_g")), number(F.col("sigma_e")), number(F.col("h2")), F.format_string("%7d", F.col("m0").cast("long")), groups, F.format_string("%2d", F.size(F.col("pi")[0])), many(F.flatten("pi"))]
    return h.select(F.col("iter"), F.concat_ws(", ", *parts).alias("value")).select("value")


def parse_hyper(lines: DataFrame) -> DataFrame:
    """Names and types for the lines (column ``value``) of such a text: iter, num_groups, sigma_g, sigma_e, h2, m0, num_mixtures, pi."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    df = lines.filter(F.trim("value") != "").select(f.alias("f")).withColumn("g", F.col("f")[1].cast("int"))
    real = lambda first, n: F.transform(F.slice("f", first, n), lambda x: x.cast("double"))
    at = lambda i: F.element_at("f", F.col("g") + i)
    k, flat = at(7).cast("int"), real(F.col("g") + 8, F.col("g") * at(7).cast("int"))
    pi = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda i: F.slice(flat, i * k + 1, k))
    return df.select(F.col("f")[0].cast("long").alias("iter"), F.col("g").alias("num_groups"), real(F.lit(3), F.col("g")).alias("sigma_g"), at(3).cast("double").alias("sigma_e"), at(4).cast("double").alias("h2"), at(5).cast("int").alias("m0"), k.alias("num_mixtures"), pi.alias("pi"))


def write_records(samples: DataFrame, uri: str, markers: int, value: str, kind: str, thin: int | None = None) -> None:
    """Write column ``value`` of ``samples`` (iter, marker_id from 0, value) as a binary file of ``markers`` values a record; markers without
    a row get 0. Tasks write ranges of iterations and markers at their places. With ``thin`` the record of an iteration is number
    iter / thin - 1 of a file that may hold others, which stay; without it the file is made anew, a record per iteration."""
    code, _, name = TYPES[kind]
    width = np.dtype(code).itemsize
    size = 4 + markers * width
    rows = samples.select(F.col("iter").cast("long").alias("iter"), F.col("marker_id").cast("long").alias("marker_id"), F.col(value).cast(name).alias("v"))
    iters = sorted(r.iter for r in rows.select("iter").distinct().collect())  # a number per record
    place = {it: it // thin - 1 if thin else k for k, it in enumerate(iters)}
    if thin and any(it % thin or it < 1 for it in iters):
        raise ValueError("an iteration is not one of those that are kept")
    end = 4 + size * (max(place.values(), default=-1) + 1)
    if thin:
        places.extend(uri, end)
    else:
        places.begin(uri, end)
    head = places.Writer(uri, not thin)
    head.put(0, struct.pack("<I", markers))
    for it, k in place.items():
        head.put(4 + k * size, struct.pack("<I", it))
    head.close()
    rows = rows.repartitionByRange("iter", "marker_id").sortWithinPartitions("iter", "marker_id")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = places.Writer(uri, not thin), 0
        for b in batches:
            it, m, v = (b.column(c).to_numpy() for c in ("iter", "marker_id", "v"))
            if len(m) and (m.min() < 0 or m.max() >= markers):
                raise ValueError("a marker is beyond the file's")
            for own in np.split(np.arange(len(it)), np.flatnonzero(np.diff(it)) + 1):
                # markers between those of a range have no row: they are 0
                for cut in np.split(own, np.flatnonzero(np.diff(m[own]) > GAP) + 1):
                    if len(cut):
                        held = np.zeros(m[cut[-1]] - m[cut[0]] + 1, code)
                        held[m[cut] - m[cut[0]]] = v[cut]
                        file.put(8 + place[int(it[cut[0]])] * size + int(m[cut[0]]) * width, held.tobytes())
            done += len(it)
        file.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    rows.mapInArrow(put, "done long").agg(F.sum("done")).collect()
    if not thin:
        places.end(uri, end)


class Record(InputPartition):
    def __init__(self, number: int):
        self.number = number


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.code, self.type = options["path"], *TYPES[options.get("kind", "double")][:2]
        fs, path = open_fs(self.path)
        with fs.open_input_stream(path) as f:
            head = f.read(4)
        if len(head) < 4:
            raise ValueError("the file has no count of markers")
        self.markers = struct.unpack("<I", head)[0]
        self.size = 4 + self.markers * np.dtype(self.code).itemsize
        self.records, rest = divmod(fs.get_file_info(path).size - 4, self.size)
        if rest:
            raise ValueError("the last record is cut")

    def partitions(self) -> list[Record]:
        return [Record(i) for i in range(self.records)]

    def read(self, part: Record) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(self.path)
        with fs.open_input_file(path) as f:
            f.seek(4 + part.number * self.size)
            it = struct.unpack("<I", f.read(4))[0]
            for a in range(0, self.markers, 1 << 20):
                v = np.frombuffer(f.read(min(1 << 20, self.markers - a) * np.dtype(self.code).itemsize), self.code)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), it, np.int64)), pa.array(np.arange(a, a + len(v))), pa.array(v, self.type)], names=["iter", "marker_id", "value"])


class ChainSource(DataSource):
    """``spark.read.format("chain").option("kind", "double" or "int").load(path)``: iter, marker_id, value; a partition per record."""

    @classmethod
    def name(cls) -> str:
        return "chain"

    def schema(self) -> str:
        return f"iter bigint, marker_id bigint, value {TYPES[self.options.get('kind', 'double')][2]}"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

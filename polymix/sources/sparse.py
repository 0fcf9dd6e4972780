"""The sparse set of a genotype: ``.dim`` (text, N and M), and for one copy, two copies and missing cells (``1``, ``2``, ``m``) the individuals in
a row (``.si``, unsigned 32 bits), how many each marker has (``.sl``) and where they start (``.ss``, both unsigned 64 bits)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import packed
from ..operators.stats import prefix
from . import places
from .bed import BedSource
from .chain_files import open_fs

#: Indices of a batch, in bytes, as a rule (a marker is never cut).
BYTES = 16 << 20
#: Bytes of packed rows that are unpacked at a time.
AT_ONCE = 2 << 20
CLASSES = (("1", "one"), ("2", "two"), ("m", "miss"))


def _files(uri: str) -> dict[tuple[str, str], str]:
    return {(k, c): f"{uri}.{k}{c}" for c, _ in CLASSES for k in ("si", "sl", "ss")}


def _begin(uri: str, totals: dict[str, int], markers: int) -> dict[str, int]:
    sizes = {f: 4 * totals[c] if k == "si" else 8 * markers for (k, c), f in _files(uri).items()}
    for f, size in sizes.items():
        places.begin(f, size)
    return sizes


def _end(uri: str, sizes: dict[str, int], individuals: int, markers: int) -> None:
    for f, size in sizes.items():
        places.end(f, size)
    with open(places.local_path(f"{uri}.dim"), "w") as f:
        f.write(f"{individuals} {markers}\n")


def _put(files: dict[tuple[str, str], places.Writer], c: str, marker: int, start: int, sizes: np.ndarray, flat: np.ndarray) -> None:
    """Markers in a row, from ``marker`` on, whose individuals begin at ``start``."""
    files["si", c].put(4 * start, flat.astype("<u4").tobytes())
    files["sl", c].put(8 * marker, sizes.astype("<u8").tobytes())
    files["ss", c].put(8 * marker, (start + np.cumsum(sizes) - sizes).astype("<u8").tobytes())


def write_sparse(lists: DataFrame, uri: str, individuals: int, markers: int) -> None:
    """``lists``: marker_id (0 to markers - 1, each once at most), one, two, miss; a marker without a row or without cells has empty lists, one that doesn't
    vary is kept. Two passes: sizes give each marker's place, then tasks write ranges of markers there."""
    rows = lists.select(F.col("marker_id").cast("long").alias("marker_id"), *(F.sort_array(F.coalesce(F.col(n).cast("array<int>"), F.array().cast("array<int>"))).alias(n) for _, n in CLASSES))
    count = rows.agg(F.count("*").alias("n"), F.min("marker_id").alias("low"), F.max("marker_id").alias("high")).first()
    twice = rows.groupBy("marker_id").count().filter("count > 1").limit(1).count()
    if twice or (count.n and (count.low < 0 or count.high >= markers)):
        raise ValueError("the lists do not hold each marker once")
    every = lists.sparkSession.range(markers).withColumnRenamed("id", "marker_id").join(rows.select("marker_id", *(F.size(n).alias(f"n{c}") for c, n in CLASSES)), "marker_id", "left").fillna(0)
    starts, totals = every, {c: 0 for c, _ in CLASSES}
    for c, _ in CLASSES:
        starts = prefix(starts, "marker_id", F.col(f"n{c}").cast("long"), f"start{c}")
    if markers:
        sums = every.agg(*(F.sum(f"n{c}").alias(c) for c, _ in CLASSES)).first()
        totals = {c: int(sums[c]) for c, _ in CLASSES}
    sizes = _begin(uri, totals, markers)
    placed = starts.select("marker_id", *(f"start{c}" for c, _ in CLASSES)).join(rows, "marker_id", "left")
    placed = placed.repartitionByRange("marker_id").sortWithinPartitions("marker_id")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = {k: places.Writer(f) for k, f in _files(uri).items()}, 0
        for b in batches:
            if not b.num_rows:
                continue
            for c, name in CLASSES:
                own = pa.compute.fill_null(pa.compute.list_value_length(b.column(name)), 0).to_numpy(zero_copy_only=False)
                _put(files, c, b.column("marker_id")[0].as_py(), b.column(f"start{c}")[0].as_py(), own.astype(np.int64), b.column(name).flatten().to_numpy())
            done += b.num_rows
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    placed.mapInArrow(put, "done long").agg(F.sum("done")).collect()
    _end(uri, sizes, individuals, markers)


def bed_to_sparse(spark: SparkSession, bed: str, uri: str, individuals: int, keep: np.ndarray | None = None, block: int = 4096) -> None:
    """The sparse set of a packed genotype file, all markers of it; ``keep``: the individuals that stay, sorted. Two passes over the file: sums of sizes
    per block of markers (a row per block) give the blocks' places, then each block is written there. No shuffle."""
    spark.dataSource.register(BedSource)
    source = spark.read.format("bed").option("individuals", individuals).option("block", block).load(bed)
    n = individuals if keep is None else len(keep)
    sent = spark.sparkContext.broadcast(keep)
    step = max(1, min(256, AT_ONCE // max(1, -(-individuals // 4))))

    def rows_of(b: pa.RecordBatch) -> np.ndarray:
        rows = packed.rows_of(b.column("packed"), individuals)
        return rows if sent.value is None else packed.chosen(rows, sent.value)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.concatenate([packed.counts(rows_of(b.slice(a, step))) for a in range(0, b.num_rows, step)] or [np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(b.column("marker_id").to_numpy() // block), *(pa.array(c[:, i]) for i in range(3))], names=["block", "n1", "n2", "nm"])

    sums = source.mapInArrow(size, "block long, n1 long, n2 long, nm long").groupBy("block").agg(F.count("*").alias("markers"), *(F.sum(f"n{c}").alias(c) for c, _ in CLASSES)).orderBy("block").collect()
    totals, starts, markers = {c: 0 for c, _ in CLASSES}, {}, 0
    for r in sums:
        starts[r.block] = dict(totals)
        totals = {c: totals[c] + r[c] for c in totals}
        markers += r.markers
    sizes = _begin(uri, totals, markers)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, at = {k: places.Writer(f) for k, f in _files(uri).items()}, 0, {}
        for b in (x.slice(a, step) for x in batches for a in range(0, x.num_rows, step)):
            keys = b.column("marker_id").to_numpy()
            for own in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys // block)) + 1):
                if not len(own):
                    continue
                now = int(keys[own[0]]) // block
                found = packed.lists_of(rows_of(b.slice(int(own[0]), len(own))), n)
                here = at.setdefault(now, dict(starts[now]))
                for c, name in CLASSES:
                    _put(files, c, int(keys[own[0]]), here[c], np.array([len(x) for x in found[name]]), np.concatenate(found[name]))
                    here[c] += sum(map(len, found[name]))
                done += len(own)
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    source.mapInArrow(put, "done long").agg(F.sum("done")).collect()
    _end(uri, sizes, n, markers)


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class SparseReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 4096))
        fs, base = open_fs(self.path)
        with fs.open_input_stream(f"{base}.dim") as f:
            self.individuals, self.markers = map(int, f.read().split())

    def partitions(self) -> list[Span]:
        return [Span(a, min(a + self.block, self.markers)) for a in range(0, self.markers, self.block)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """Runs of markers of about ``BYTES``: starts count from the file's begin, a run's lists from its own."""
        fs, base = open_fs(self.path)
        n, at = span.end - span.start, {}
        for c, _ in CLASSES:
            for k in ("ss", "sl"):
                with fs.open_input_file(f"{base}.{k}{c}") as f:
                    f.seek(8 * span.start)
                    at[k, c] = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
        size = 4 * sum(at["sl", c] for c, _ in CLASSES)
        run = (np.cumsum(size) - size) // BYTES
        with ExitStack() as files:
            indices = {c: files.enter_context(fs.open_input_file(f"{base}.si{c}")) for c, _ in CLASSES}
            for own in np.split(np.arange(n), np.flatnonzero(np.diff(run)) + 1):
                a, b, columns = int(own[0]), int(own[-1]) + 1, []
                for c, _ in CLASSES:
                    sizes = at["sl", c][a:b]
                    indices[c].seek(4 * int(at["ss", c][a]))
                    flat = np.frombuffer(indices[c].read(4 * int(sizes.sum())), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(span.start + a, span.start + b)), *columns], names=["marker_id", *(n for _, n in CLASSES)])


class SparseSource(DataSource):
    """``spark.read.format("sparsegeno").load(base)``: marker_id, one, two, miss; a partition per ``block`` markers."""

    @classmethod
    def name(cls) -> str:
        return "sparsegeno"

    def schema(self) -> str:
        return "marker_id bigint, one array<int>, two array<int>, miss array<int>"

    def reader(self, schema) -> SparseReader:
        return SparseReader(self.options)


def cells(lists: DataFrame) -> DataFrame:
    """marker_id, ind, d of the cells that are not zero."""
    of = lambda name, d: F.transform(name, lambda i: F.struct(i.alias("ind"), F.lit(d).cast("int").alias("d")))
    every = F.concat(of("one", 1), of("two", 2), of("miss", None))
    return lists.select("marker_id", F.explode(every).alias("c")).select("marker_id", "c.ind", "c.d")

"""Data source ``bed``: packed genotype files, a row (marker_id, packed) per marker, a partition per block of markers.

Files are opened through ``pyarrow.fs``, so any store it knows will do. ``individuals`` gives the row's length. The three header bytes and the
size of the file are checked; a task reads about ``BYTES`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import packed
from . import places


#: Fixed values of the format.
HEADER = b"\x6c\x1b\x01"
BYTES = 16 << 20


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def markers_in(uri: str, individuals: int) -> int:
    """How many markers a file holds, by its size."""
    fs, path = _open(uri)
    markers, rest = divmod(fs.get_file_info(path).size - len(HEADER), -(-individuals // 4))
    if rest:
        raise ValueError("the file's size doesn't fit the number of individuals")
    return markers


def write_bed(geno: DataFrame, uri: str, individuals: int, markers: int) -> None:
    """``geno``: marker_id (0 to markers - 1), ind, d. The task that packs a marker writes its row at its place, a row at a time: no packed row is shuffled.
    A marker without a cell has no copies."""
    width = -(-individuals // 4)
    size = len(HEADER) + markers * width
    places.begin(uri, size)
    head = places.Writer(uri)
    head.put(0, HEADER)
    head.close()
    step = packed.TILE // 4

    def put(tiles: Iterator[packed.Tiles]) -> Iterator[pa.RecordBatch]:
        file, done = places.Writer(uri), 0
        for t in tiles:
            ends = np.searchsorted(t.owner, np.arange(len(t.key) + 1))
            for i, marker in enumerate(t.key.tolist()):
                row = np.full(-(-width // step) * step, 0xFF, np.uint8)
                row.reshape(-1, step)[t.at[ends[i] : ends[i + 1]]] = t.rows[ends[i] : ends[i + 1]]
                file.put(len(HEADER) + marker * width, row[:width].tobytes())
            done += len(t.key)
        file.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, row = places.Writer(uri), 0, b"\xff" * width
        for b in batches:
            for marker in b.column("marker_id").to_pylist():
                file.put(len(HEADER) + marker * width, row)
            done += b.num_rows
        file.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    packed.by_tiles(geno, put, "done long").agg(F.sum("done")).collect()
    every = geno.sparkSession.range(markers).withColumnRenamed("id", "marker_id")
    every.join(geno.select(F.col("marker_id").cast("long").alias("marker_id")).distinct(), "marker_id", "left_anti").mapInArrow(blank, "done long").agg(F.sum("done")).collect()
    places.end(uri, size)


class Block(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.row = options["path"], -(-int(options["individuals"]) // 4)
        self.block = int(options.get("block", 4096))

    def partitions(self) -> list[Block]:
        fs, path = _open(self.path)
        with fs.open_input_stream(path) as f:
            if f.read(3) != HEADER:
                raise ValueError("not a marker-major packed genotype file")
        markers, rest = divmod(fs.get_file_info(path).size - 3, self.row)
        if rest:
            raise ValueError("the file's size doesn't fit the number of individuals")
        return [Block(a, min(a + self.block, markers)) for a in range(0, markers, self.block)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        fs, path = _open(self.path)
        with fs.open_input_file(path) as f:
            f.seek(3 + part.start * self.row)
            step = max(1, BYTES // self.row)
            for a in range(part.start, part.end, step):
                n = min(step, part.end - a)
                held = f.read(n * self.row)
                rows = [held[i * self.row : (i + 1) * self.row] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(range(a, a + n), pa.int64()), pa.array(rows, pa.binary())], names=["marker_id", "packed"])


class BedSource(DataSource):
    """``spark.read.format("bed").option("individuals", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "marker_id bigint, packed binary"

    def reader(self, schema) -> BedReader:
        return BedReader(self.options)

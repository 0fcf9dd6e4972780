"""Token-ID files: Arrow stream files of fixed-size-list batches.

Layout of a shard ``NNNNN``:

* ``NNNNN.ids.arrows`` - Arrow IPC stream; columns ``ids`` fixed_size_list<uint16>[L] and ``mask``
  fixed_size_list<uint8>[L / 8] (a bit per token, low bits first; 1: a token, 0: padding). Every batch holds the same number of
  sequences, so every batch message has the same length and sequence ``i`` lies at a computed place: a memory map gives its
  ids and its mask without copying. ``tokens`` spreads the bits where a byte per token is wanted.
* ``NNNNN.docs.arrows`` - Arrow IPC stream; ``doc_id``, ``start`` (in the shard's ids), ``n_tokens``.

Shards hold documents in ascending doc_id (null first, ties by a hash of the text). ``manifest`` (Parquet) lists the
shards with the number of ids before each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunk_tokenizer
from .common import gathered, shared_dir, slices, whole_text

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long, base long"


def ids_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])


def tokens(mask: np.ndarray) -> np.ndarray:
    """Booleans from the bits of a mask."""
    return np.unpackbits(mask, axis=-1, bitorder="little").view(bool)


class ShardWriter:
    """Writes one shard; memory holds one batch. The files appear under their names only once complete."""

    def __init__(self, uri: str, shard: int, length: int, rows: int):
        if length % 8:
            raise ValueError("length must be a multiple of 8")
        self.fs, root = pa.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(root, recursive=True)
        self.names = [f"{root}/{shard:05d}.{kind}.arrows" for kind in ("ids", "docs")]
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.drafts = [f"{n}.{attempt}.part" for n in self.names]
        self.length, self.rows, self.size = length, rows, length * rows
        self.files = [self.fs.open_output_stream(n) for n in self.drafts]
        self.ids = pa.ipc.new_stream(self.files[0], ids_schema(length))
        self.docs = pa.ipc.new_stream(self.files[1], DOCS)
        self.held, self.full = np.zeros(self.size, "<u2"), 0
        self.index: list[tuple] = []
        self.n_docs = self.n_tokens = 0

    def _flush(self) -> None:
        mask = np.packbits(np.arange(self.size) < self.full, bitorder="little")
        self.held[self.full :] = 0
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((self.held, self.length), (mask, self.length // 8))]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=ids_schema(self.length)))
        self.held, self.full = np.zeros(self.size, "<u2"), 0

    def _flush_docs(self) -> None:
        columns = list(zip(*self.index, strict=True)) or [(), (), ()]
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=DOCS))
        self.index = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        while len(ids):
            n = min(len(ids), self.size - self.full)
            self.held[self.full : self.full + n] = ids[:n]
            self.full += n
            ids = ids[n:]
            if self.full == self.size:
                self._flush()
        if len(self.index) >= 50_000:
            self._flush_docs()

    def close(self) -> list[str]:
        if self.full:
            self._flush()
        if self.index:
            self._flush_docs()
        for x in (self.ids, self.docs, *self.files):
            x.close()
        for draft, name in zip(self.drafts, self.names, strict=True):
            self.fs.move(draft, name)
        return self.names


class Shard:
    """Random access to the sequences of one shard file by arithmetic on equal-length batch messages."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(source))
        self.first = source.tell()
        self.length = self.schema.field("ids").type.list_size
        message = None
        try:
            message = pa.ipc.read_message(source)
        except EOFError:
            pass
        self.stride = source.tell() - self.first if message is not None else 0
        self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows if message is not None else 0
        self.batches = (source.size() - self.first) // self.stride if self.stride else 0

    @classmethod
    def open(cls, uri: str, name: str) -> Shard:
        fs, _ = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        return cls(pa.memory_map(name) if local else fs.open_input_file(name))

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of batch ``k``, a row per sequence; both are views of the map where the file is local."""
        self.source.seek(self.first + k * self.stride)
        got = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return tuple(got.column(c).flatten().to_numpy(zero_copy_only=True).reshape(got.num_rows, -1) for c in ("ids", "mask"))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // self.rows)
        return ids[i % self.rows], mask[i % self.rows]

    def spans(self) -> Iterator[np.ndarray]:
        """The ids without padding, a batch at a time."""
        for k in range(self.batches):
            ids, mask = self.batch(k)
            yield ids.reshape(-1)[tokens(mask.reshape(-1))]


def write_token_files(
    docs: DataFrame, uri: str, tokenizer: str, spaced: bool, end_id: int, length: int = 2048, rows: int = 64
) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and write shards below ``uri``; returns the manifest.

    One range shuffle by doc_id gives the order; each task then writes a shard of its own under a fixed name, so
    a repeated task writes the same file again. Only a row per shard reaches the driver. Null or empty text gives just
    the end id; repeated rows are kept; an empty table gives shards without documents; other columns are ignored.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text").alias("tie")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).select("doc_id", tie, "text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    end = np.uint16(end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer = ShardWriter(uri, shard, length, rows)
        with chunk_tokenizer(tokenizer, spaced) as encoder:
            for part in (s for b in gathered(batches, 4_000_000) for s in slices(b, "text", 4_000_000)):
                ids, cuts = encoder.encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                    writer.add(doc_id, np.append(ids[a:b], end))
        names = writer.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids_file": names[0], "docs_file": names[1], "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], schema=pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = sorted(ordered.mapInArrow(write, MANIFEST.rpartition(",")[0]).collect())
    base, listed = 0, []
    for s in shards:
        listed.append((*s, base))
        base += s.n_tokens
    manifest = spark.createDataFrame(listed, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read_documents(manifest: DataFrame, uri: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit integers)."""
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(uri)
        for row in (r for b in batches for r in b.to_pylist()):
            spans, held = Shard.open(uri, row["ids_file"]).spans(), np.zeros(0, "<u2")
            with fs.open_input_stream(row["docs_file"]) as f:
                for docs in pa.ipc.open_stream(f):
                    sums = []
                    for size in docs.column("n_tokens").to_numpy():
                        crc = 0
                        while size:
                            if not len(held):
                                held = next(spans)
                            took, held = held[:size], held[size:]
                            crc = zlib.crc32(took.astype("<u4").tobytes(), crc)
                            size -= len(took)
                        sums.append(crc)
                    start = pa.compute.add(docs.column("start"), row["base"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, n), "shard") if n > 1 else manifest
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    """Write the files into the shared folder, then read them back."""
    uri = shared_dir(spark, "tokens")
    return read_documents(write_token_files(docs, uri, tokenizer, spaced, end_id), uri)

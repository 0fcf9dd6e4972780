"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the vocabulary crosses from a letter to a white-space marker, so merges never do either: a marked text is
the row of its chunks (markers, then everything up to the next marker), and its ids are the ids of the chunks in order.
A slice of texts lists its distinct chunks, segments and decodes the new ones once, and joins ids and texts back by position. The table lasts as
long as its task, up to a bound in bytes. (A global table would shuffle a row per word, about ten times the input.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, whole_text

MARK = "▁"
#: Bytes that an entry of a table takes besides its characters and ids.
ENTRY = 400
_RUNS = re.compile(" +[^ ]*")


class ChunkTable:
    """For each distinct chunk its ids, the same in decimal, and its text as decoded; bounded in bytes (``most``)."""

    def __init__(self, model: str, most: int = 48_000_000):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=model)
        self.most = most
        self.clear()
        every = range(self.inner.get_piece_size())
        pieces = [self.inner.id_to_piece(i) for i in every]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a white-space marker")
        if self.inner.encode("a  ") == self.inner.encode("a"):
            raise ValueError("the model normalises white space")
        # unknown, control and byte pieces have no text of their own
        odd = [self.inner.is_unknown(i) or self.inner.is_control(i) or self.inner.is_byte(i) for i in every]
        self.text = [None if o else p.replace(MARK, " ") for p, o in zip(pieces, odd, strict=True)]

    def clear(self) -> None:
        self.known: dict[str, tuple[list[int], str, str | None]] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker: the library puts one before each text it is given."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts[1:] or not parts[0]:
            parts = [x[1:] for x in _RUNS.findall(" " + text)]
        return parts

    def look(self, parts: list[list[str]]) -> list[tuple[list[int], str, str | None]]:
        """Of each text, by its chunks: ids, decimal, and decoded text (none where a piece has no text of its own)."""
        if self.held > self.most:
            self.clear()
        new = list(set().union(*parts) - self.known.keys())
        for x, ids in zip(new, self.inner.encode(new, num_threads=1) if new else [], strict=True):
            ids = ids if x else [self.inner.piece_to_id(MARK)]
            texts = [self.text[i] for i in ids]
            self.known[x] = ids, " ".join(map(str, ids)), None if None in texts else "".join(texts)
            self.held += ENTRY + 2 * len(x) + 16 * len(ids)
        out = []
        for p in parts:
            found = [self.known[x] for x in p]
            texts = [t for _, _, t in found]
            # the first marker stands for no space
            whole = None if None in texts else "".join(texts).removeprefix(" ")
            out.append(([*chain.from_iterable(ids for ids, _, _ in found)], " ".join(d for _, d, _ in found), whole))
        return out


@contextmanager
def chunk_table(model: str) -> Iterator[ChunkTable]:
    """For one task: kept for good it would hold a worker's memory."""
    table = ChunkTable(model)
    try:
        yield table
    finally:
        table.clear()
        del table
        release()


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256, and ids, decoded.

    An end id follows each text. Null and empty texts give the end id alone; rows that repeat are kept; other columns
    are ignored; an empty table gives none. ``with_ids=False`` leaves out the arrays and texts. No shuffle. A model with pieces that cross
    a white-space marker, or that changes white space, is refused with a ``ValueError``.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with chunk_table(model) as table:
            end = table.inner.eos_id()
            for part in (s for b in batches for s in slices(b, "text", 2_000_000)):
                rows: list[list] = [[] for _ in fields]
                found = table.look([table.chunks(t) for t in part.column("text").to_pylist()])
                for doc_id, (ids, decimal, text) in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(end)
                    if text is None:
                        text = table.inner.decode(ids)
                    said = f"{decimal} {end}" if decimal else str(end)
                    row = (doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text)
                    for column, x in zip(rows, row, strict=False):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, ddl)

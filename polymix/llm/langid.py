"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every row that may be learnt from. The classifier is fitted on a sample of them, bounded by
``sample`` rows in all and drawn per language, by follow-the-regularised-leader with elastic-net penalties; part of the
sample sets the temperature of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, whole_text

BITS, ORDERS, SPAN = 16, (1, 2, 3), 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them; made once a worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Hashed n-grams of lower-cased letters; anything else is one blank, so n-grams hold word edges."""

    def __init__(self):
        self.letter = _letters()

    def codes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(self.letter[c], c, 32).astype(np.uint64)
        return c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))] if len(c) else c  # blanks in a row are one

    def has_letter(self, codes: np.ndarray) -> bool:
        return bool((codes != 32).any())

    def buckets(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Bucket numbers of all n-grams, some hundred thousand at a time."""
        for at in range(0, len(codes), SPAN):
            c = codes[at : at + SPAN + max(ORDERS) - 1]
            for n in ORDERS:
                m = min(SPAN, len(c) - n + 1)
                if m > 0:
                    h = c[:m] + np.uint64(n << 40)
                    for k in range(1, n):
                        h = (h * _ODD) ^ c[k : k + m]
                    yield ((h * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray = field(repr=False)  # buckets x langs, times idf
    bias: np.ndarray = field(repr=False)
    temperature: float

    def score(self, logits: np.ndarray) -> tuple[str, float]:
        z = (logits + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.langs[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple], idf: np.ndarray, langs: list[str], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """``rows``: (doc_id, lang, buckets, shares of the document's n-grams). Every fifth row sets the temperature."""
    number = {x: i for i, x in enumerate(langs)}
    rows = [(number[lang], b, s * idf[b] * 30) for _, lang, b, s in rows]
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    size = (len(idf) + 1, len(langs))  # the last row is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(used)):
            y, b, x = used[i]
            b, x = np.append(b, len(idf)), np.append(x, 1.0)
            w = weights(b)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[b] += g - (np.sqrt(n[b] + g2) - np.sqrt(n[b])) / alpha * w
            n[b] += g2
    w = weights(slice(None))
    logits = np.array([x @ w[b] + w[-1] for _, b, x in held])
    truth = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid] if len(held) else [0.0]
    return Model(langs, (w[:-1] * idf[:, None] * 30).astype(np.float32), w[-1], float(grid[int(np.argmin(loss))]) if len(held) else 1.0)


def fit(docs: DataFrame, learn: Column, sample: int = 3000) -> Model | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) where ``learn`` holds; None if there are none.

    ``sample`` bounds the rows that reach the driver (in expectation, per language in equal parts); document frequencies
    count all rows, a total per hash bucket.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    rate = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, sample / len(totals) / n))) for lang, n in totals.items()))
    # one pass: every row counts for the frequencies, the drawn ones also give their features
    drawn = known.withColumn("drawn", F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) < rate * (1 << 30))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, seen = Grams(), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
        for part in (s for b in batches for s in slices(b, "text", 1_000_000)):
            for text in part.column("text").to_pylist():
                seen[:] = False
                for b in grams.buckets(grams.codes(text)):
                    seen[b] = True
                df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for part in (s for b in batches for s in slices(b, "text", 1_000_000)):
            rows = []
            for text in part.column("text").to_pylist():
                count = np.zeros(1 << BITS, np.int64)
                for b in grams.buckets(grams.codes(text)):
                    count += np.bincount(b, minlength=1 << BITS)
                at = np.flatnonzero(count)
                rows.append((at.astype(np.int32), (count[at] / max(1, count.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["doc_id", "lang", "at", "share"])

    total = sum(totals.values())
    df = np.zeros(1 << BITS)
    for r in known.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r.bucket] = r.df
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = drawn.filter("drawn").select("doc_id", "text", "lang").mapInArrow(features, "doc_id long, lang string, at binary, share binary").collect()
    rows = sorted(((r.doc_id or 0, r.lang, np.frombuffer(r["at"], np.int32), np.frombuffer(r.share, np.float32)) for r in rows), key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    return fit_ftrl(rows, idf, sorted(totals), epochs=3)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, lang_pred, score, and the columns ``keep`` (with ``text`` as it was).

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learnt. Rows that repeat are predicted
    each, other columns are not looked at, an empty table gives no rows. No shuffle; the weights (a bounded table) are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    names = ["doc_id", *(c for c in keep if c != "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), held.value
        for part in (s for b in batches for s in slices(b, "_text", 1_000_000)):
            found = []
            for text in part.column("_text").to_pylist():
                codes = grams.codes(text)
                if m is None or not grams.has_letter(codes):
                    found.append(("und", 0.0))
                    continue
                sums, n = np.zeros(len(m.langs)), 0
                for b in grams.buckets(codes):
                    # counts of the buckets touch each weight once
                    sums += m.weight[b].sum(0, dtype=np.float64)
                    n += len(b)
                found.append(m.score(sums / n))
            kept = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])
        release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in names[1:]), whole_text().alias("_text"))
    types = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + ", lang_pred string, score double")


def fold(col: str = "doc_id") -> Column:
    """The remainder by four of the checksum of the id as text."""
    return F.crc32(F.col(col).cast("string")) % 4


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Learn from the folds but 2, predict all: doc_id, held_out, lang_pred, score. A null id counts as not held out."""
    learn = F.coalesce(fold() != 2, F.lit(True))
    out = predict(docs, fit(docs, learn, sample))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Hard negatives by rotated one-bit codes with deterministic bounds.

Each vector x is rotated (random signs and Hadamard transforms, so nothing is stored for the rotation) and kept as the signs of
its components, one bit each, with its length and the alignment a = <s, x> / |x| of the sign vector s (of length 1) with it. A query q
is rotated alike and written as whole numbers of a few bits. Then <q, s> comes from popcounts of the query's bit planes with
the code, and <q, x> = |x| (a <q, s> + <q, r>), where the residual r is orthogonal to s and of length sqrt(1 - a^2). By Cauchy and Schwarz
|<q, r>| <= sqrt(|q|^2 - <q, s>^2) sqrt(1 - a^2), which gives an interval that always holds the score. Rows whose interval can't reach what a query
still looks for are dropped; the rest is scored in integers.

Queries (anchors) meet the rows in blocks: a block is broadcast, its size is bounded, and a scan of the coded table
compares it with all rows. Tasks keep what is best so far, so a scan gives a few rows per task and query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, release, saved
from .topk import _products, integers

#: Bits of a query's components; rows and queries compared at a time; seed of the rotation's signs.
PLANES, ROWS, AT_ONCE, SEED = 6, 4096, 256, 7
#: Relative to the lengths of both vectors: rounding of the rotation and the bounds.
SLACK = 1e-9


class Rotation:
    """Three rounds of random signs and a Hadamard transform, on vectors filled with zeros to a power of two."""

    def __init__(self, width: int):
        self.size = max(64, 1 << max(0, width - 1).bit_length())
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (3, self.size))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        x = np.zeros((len(v), self.size))
        x[:, : v.shape[1]] = v
        for s in self.signs:
            x *= s
            step = 1
            while step < self.size:
                y = x.reshape(len(x), -1, 2, step)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), self.size)
                step *= 2
            x /= np.sqrt(self.size)
        return x

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign bits (64 a word), lengths, and alignments with the sign vectors."""
        x = self(v)
        length = np.sqrt((v * v).sum(1))
        align = np.abs(x).sum(1) / np.sqrt(self.size) / np.where(length > 0, length, 1)
        return np.packbits(x >= 0, axis=1).view(np.uint64), length, np.minimum(align, 1.0)


class Queries:
    """Rotated queries as bit planes."""

    def __init__(self, v: np.ndarray, rotation: Rotation):
        x = rotation(v)
        self.size, self.square = rotation.size, (v * v).sum(1)
        self.low, top = x.min(1), x.max(1)
        self.step = np.where(top > self.low, (top - self.low) / ((1 << PLANES) - 1), 1.0)
        u = np.rint((x - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = self.low[:, None] + self.step[:, None] * u
        self.total, self.off = rounded.sum(1), np.sqrt(((x - rounded) ** 2).sum(1))
        self.planes = [np.packbits(u >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)]

    def interval(self, q: slice, codes: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products, queries by rows."""
        dot = np.zeros((len(self.low[q]), len(codes)), np.int64)
        for p, plane in enumerate(self.planes):
            own = plane[q]
            for w in range(codes.shape[1]):
                dot += np.bitwise_count(own[:, [w]] & codes[:, w]).astype(np.int64) << p
        ones = np.bitwise_count(codes).sum(1)
        along = (2 * (self.step[q, None] * dot + self.low[q, None] * ones) - self.total[q, None]) / np.sqrt(self.size)
        # what the bits of the query leave open
        off = self.off[q, None]
        away = np.sqrt(np.maximum(0, self.square[q, None] - np.maximum(0, np.abs(along) - off) ** 2))
        half = align * off + away * np.sqrt(np.maximum(0, 1 - align * align)) + SLACK * np.sqrt(self.square[q, None])
        return length * (align * along - half) - 1e-6, length * (align * along + half) + 1e-6


class Best:
    """The ``k`` highest scores of each slot so far; ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.ident = k, np.full((slots, k), -np.inf), np.zeros((slots, k), np.int64)
        self.exact = np.zeros((slots, k), np.int64)
        self.held = np.zeros(slots, np.int64)

    def floor(self) -> np.ndarray:
        """A score below this can't get in any more."""
        return np.where(self.held >= self.k, self.score[:, -1], -np.inf)

    def offer(self, slot: int, score: np.ndarray, ident: np.ndarray) -> None:
        n = self.held[slot]
        s, i = np.concatenate([self.exact[slot, :n], score]), np.concatenate([self.ident[slot, :n], ident])
        # the smallest long has no negative
        at = np.lexsort((i, ~s))[: self.k]
        n = self.held[slot] = len(at)
        self.exact[slot, :n], self.ident[slot, :n], self.score[slot, :n] = s[at], i[at], s[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, j = np.nonzero(np.arange(self.k) < self.held[:, None])
        return slot, self.ident[slot, j], self.exact[slot, j]


def coded(vectors: DataFrame, ident: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """id, label, v, code, length, align of the rows that take part, and the width of their vectors."""
    own = integers(vectors.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("long")), ident, vector, scale, keep=("_label",))
    base = saved(own.withColumnRenamed("_label", "label"), "vectors")
    width = base.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = Rotation(width)
        for b in batches:
            for c in (b.slice(a, ROWS) for a in range(0, b.num_rows, ROWS)):
                code, length, align = rotation.codes(_dense(c.column("v"), width))
                yield pa.RecordBatch.from_arrays([c.column("id"), c.column("label"), c.column("v"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(length), pa.array(align)], names=["id", "label", "v", "code", "length", "align"])
        release()

    return saved(base.mapInArrow(run, "id long, label long, v array<long>, code binary, length double, align double"), "codes"), width


def _dense(v: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros."""
    size = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), width))
    out[np.repeat(np.arange(len(v)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
    return out


class Rows:
    """A batch of ``coded``."""

    def __init__(self, b: pa.RecordBatch, width: int):
        self.ids, self.label, self.length, self.align = (b.column(c).to_numpy() for c in ("id", "label", "length", "align"))
        self.v, self.dense = b.column("v"), _dense(b.column("v"), width)
        self.most = float(np.abs(self.dense).max(initial=0)) * max(1, width)
        self.code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint64).reshape(b.num_rows, -1)

    def scores(self, v: np.ndarray, whole: list[int], at: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with a query (as doubles, and as integers): doubles are exact below 2**53."""
        if self.most * float(np.abs(v).max(initial=0)) < 1 << 53:
            return (self.dense[at] @ v).astype(np.int64)
        return _products([whole], self.v.take(pa.array(at)).to_pylist(), len(v))[0]


def _scan(codes: DataFrame, width: int, anchors: list, slots: int, k: int, look: Callable) -> DataFrame:
    """One pass over all rows for a block of anchors. ``look`` offers what it finds of anchor ``a`` to the slots."""
    sent = codes.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        own = np.zeros((len(held), width))
        for i, x in enumerate(held):
            own[i, : len(x["v"])] = x["v"]
        queries, label = Queries(own, Rotation(width)), np.array([x["label"] for x in held], np.int64)
        ident, best = np.array([x["id"] for x in held], np.int64), Best(len(held) * slots, k)
        for b in batches:
            for rows in (Rows(b.slice(a, ROWS), width) for a in range(0, b.num_rows, ROWS)):
                for a in range(0, len(held), AT_ONCE):
                    q = slice(a, a + AT_ONCE)
                    low, high = queries.interval(q, rows.code, rows.length, rows.align)
                    same, other = label[q, None] == rows.label, ident[q, None] != rows.ids
                    look(held, own, best, a, rows, same & other, ~same & other, low, high)
        slot, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ident[slot // slots]), pa.array((slot % slots).astype(np.int32)), pa.array(found), pa.array(score)], names=["anchor_id", "slot", "id", "score"])
        release()

    return codes.mapInArrow(run, "anchor_id long, slot int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A few rows per task, anchor and slot, of which the first ``k`` stay."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    ident: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """Per anchor, positive and rank (from 1): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` tells the anchors by ``id``. Scores are integer inner products of floor(scale * x); a positive is one of the anchor's
    ``positives`` best other rows of its label, its negatives are the ``negatives`` best rows of other labels with
    ``least`` * positive_score <= 100 * negative_score <= ``most`` * positive_score; ties go to the smaller id. Rows whose id, label or vector is null, or
    whose vector holds a null or a number that isn't finite, take no part. Vectors of unequal length count as filled with zeros. Rows
    that repeat an id are candidates each, none of them for an anchor of that id, which has the least label and vector of its rows. Scores
    beyond the range of long count as its end. Positives without negatives, anchors without positives and empty tables give no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    codes, width = coded(vectors, ident, vector, label, scale)
    chosen = codes.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("f"))
    many = chosen.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not many:
        return spark.createDataFrame([], out)
    # as Python's integers an anchor takes about 40 bytes a component
    blocks = -(-many * (40 * width + 1000 * positives) // BROADCAST_BYTES)
    anchors = saved(chosen.select("id", "f.label", "f.v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")), "anchors")

    def like(held, own, best, a, rows, same, other, low, high):
        ok = same & (high >= best.floor()[a : a + len(same), None])
        for i in np.flatnonzero(ok.any(1)):
            at = np.flatnonzero(ok[i])
            best.offer(a + i, rows.scores(own[a + i], held[a + i]["v"], at), rows.ids[at])

    def unlike(held, own, best, a, rows, same, other, low, high):
        floor = best.floor().reshape(-1, positives)
        for i in range(len(other)):
            wanted = [(j, *x) for j, x in enumerate(held[a + i]["range"]) if x[0] <= x[1]]
            ok = np.zeros(other.shape[1], bool)
            for j, lo, hi in wanted:
                ok |= (high[i] >= max(lo, floor[a + i, j])) & (low[i] <= hi)
            at = np.flatnonzero(ok & other[i])
            if len(at):
                score = rows.scores(own[a + i], held[a + i]["v"], at)
                for j, lo, hi in wanted:
                    fits = (score >= lo) & (score <= hi)
                    if fits.any():
                        best.offer((a + i) * positives + j, score[fits], rows.ids[at[fits]])

    made = []
    for block in range(blocks):
        held = [{"id": r.id, "label": r.label, "v": list(r.v)} for r in anchors.filter(F.col("block") == block).collect()]
        if not held:
            continue
        near = saved(_ranked(_scan(codes, width, held, 1, positives, like), positives).select("anchor_id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        scores: dict[int, list[tuple[int, int]]] = {}
        for r in near.orderBy("anchor_id", "slot").collect():
            scores.setdefault(r.anchor_id, []).append((-(-least * r.positive_score // 100), most * r.positive_score // 100))
        held = [x | {"range": scores[x["id"]]} for x in held if x["id"] in scores]
        if held:
            far = _ranked(_scan(codes, width, held, positives, negatives, unlike), negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
            made.append(saved(far.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
    if not made:
        return spark.createDataFrame([], out)
    return spark.read.schema(made[0].schema).parquet(*(m.saved_at for m in made))


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
             cast(list_sum([p[1] * p[2] for p in list_zip(a.e, c.e)]) as bigint) as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
             cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same
       and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more coordinate that makes all their lengths equal, so the largest inner product is the smallest
distance, and the triangle inequality bounds it: |d(q, p) - d(p, x)| <= d(q, x). The index keys each vector by its nearest pivot
and its distance to it, and cuts the sorted order into blocks (annuli) of rows. A query first scans the annuli with the best
bounds; its k-th score then stops the expansion: only annuli whose bound reaches it are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

PIVOTS, ROWS, ANNULI, QUERIES, SEEDS = 64, 512, 50_000, 2048, 2
#: Queries whose bounds are held at once: 256 x 50,000 doubles are 100 MB.
AT_ONCE = 256


def usable(vector: str) -> Column:
    """Whether a vector is there and all its numbers are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: DataFrame, ident: str, vector: str, scale: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, v (array<long> of floor(scale * x), at most the ends of long) and ``keep``; vectors that are null or hold a null or a number that
    isn't finite are left out."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.col(ident).isNotNull() & usable(vector)).select(F.col(ident).cast("long").alias("id"), v.alias("v"), *keep)


def _matrix(rows, width: int) -> np.ndarray:
    """Rows of arrays, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _products(a, b, width: int) -> np.ndarray:
    """Inner products of integer vectors, exact: in doubles below 2**53, in 64-bit integers below 2**62, as Python's integers beyond
    (then held to the range of long)."""
    x, y = _matrix(a, width), _matrix(b, width)
    size = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, width)
    if size < 1 << 53:
        return (x @ y.T).astype(np.int64)
    wide = lambda rows, t: np.array([[*map(int, x), *[0] * (width - len(x))] for x in rows], t).reshape(len(rows), width)
    if size < 1 << 62:
        return wide(a, np.int64) @ wide(b, np.int64).T
    return np.clip(wide(a, object) @ wide(b, object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score down, id up."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score (integer inner product); ties to the smaller vec_id.

    ``is_query`` tells the queries by ``id``. A query's own id is no candidate. Fewer candidates give fewer ranks. Vectors of
    unequal length count as filled with zeros; rows that repeat an id are candidates each, and as a query the id has the least of its
    vectors. Unusable vectors take no part; an empty table gives no rows; other columns are ignored. Inner products are exact integers for
    vectors of any size; a score beyond the range of long counts as its end. The pivots (a bounded sample, drawn by a hash) and the catalogue of annuli
    (at most about 50,000 rows: annuli hold more vectors as the table grows) are all that reaches the driver.
    """
    spark = vectors.sparkSession
    base = saved(integers(vectors, ident, vector, scale), "vectors")
    sq = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = base.agg(F.count("*").alias("n"), F.max(sq).alias("long"), F.max(F.size("v")).alias("width")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], out)
    width, longest, rows = facts.width, facts.long, max(ROWS, facts.n // ANNULI)
    pivots = _matrix([r.v for r in base.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()], width)
    pivots_sq = (pivots**2).sum(1)

    def distances(v: np.ndarray) -> np.ndarray:
        """Of vectors, each with its added coordinate, to the pivots with theirs."""
        own = np.sqrt(np.maximum(0, longest - (v**2).sum(1)))
        gap = own[:, None] - np.sqrt(np.maximum(0, longest - pivots_sq))
        return np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + pivots_sq - 2 * v @ pivots.T + gap**2))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = distances(_matrix(f["v"], width))
            near = d.argmin(1)
            yield f.assign(pivot=near.astype(np.int32), dist=d[np.arange(len(f)), near])

    ordered = base.mapInPandas(keyed, "id long, v array<long>, pivot int, dist double")
    ordered = ordered.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, None
        for f in frames:
            held = f if held is None else pd.concat([held, f])
            while len(held) >= rows:
                yield held[:rows].assign(annulus=part << 32 | number)
                held, number = held[rows:], number + 1
        if held is not None and len(held):
            yield held.assign(annulus=part << 32 | number)

    index = saved(ordered.mapInPandas(cut, "id long, v array<long>, pivot int, dist double, annulus long"), "index")
    # an annulus has rows of one pivot as a rule; where it holds more, each is an entry of its own
    catalogue = index.groupBy("annulus", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    annulus, pivot = catalogue["annulus"].to_numpy(), catalogue["pivot"].to_numpy()
    low, high = catalogue["low"].to_numpy(), catalogue["high"].to_numpy()

    def bounds(v: np.ndarray) -> np.ndarray:
        """The largest score that any vector of each entry can have, rounded up with a margin for the floating point."""
        sq = (v**2).sum(1)
        # queries have 0 as their added coordinate
        to = np.sqrt(np.maximum(0, sq[:, None] + longest - 2 * v @ pivots.T))[:, pivot]
        least = np.maximum(0, np.maximum(low - to, to - high))
        return (sq[:, None] + longest - least**2) / 2 + 1e-6 * (longest + sq[:, None]) + 1

    def seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (x.iloc[c : c + AT_ONCE] for x in frames for c in range(0, len(x), AT_ONCE)):
            most = min(4 * SEEDS, len(annulus))
            b = bounds(_matrix(f["v"], width))
            top = np.argpartition(-b, most - 1, axis=1)[:, :most]
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(b, top, 1), axis=1), 1)
            at = [(j, a) for j, row in enumerate(order) for a in list(dict.fromkeys(annulus[row].tolist()))[:SEEDS]]
            own = f.iloc[[j for j, _ in at]]
            yield pd.DataFrame({"qid": own["qid"].to_numpy(), "q": own["q"].to_numpy(), "v": own["v"].to_numpy(), "annulus": [a for _, a in at]})

    def later(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cut_ in range(0, len(f), AT_ONCE):
                g = f.iloc[cut_ : cut_ + AT_ONCE]
                ok = bounds(_matrix(g["v"], width)) >= g["least"].to_numpy()[:, None]
                j, e = np.nonzero(ok)
                pairs = pd.DataFrame({"j": j, "annulus": annulus[e]}).drop_duplicates()
                done = [set(x) for x in g["seen"]]
                keep = np.array([a not in done[i] for i, a in zip(pairs["j"], pairs["annulus"], strict=True)], bool)
                pairs = pairs[keep]
                own = g.iloc[pairs["j"].to_numpy()]
                yield pd.DataFrame({"qid": own["qid"].to_numpy(), "q": own["q"].to_numpy(), "v": own["v"].to_numpy(), "annulus": pairs["annulus"].to_numpy()})

    asked = "qid long, q int, v array<long>, annulus long"
    got = "qid long, vec_id long, score long, annulus long"
    blocks = index.select("annulus", "id", "v")

    def scan(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(block):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": [], "annulus": []}).astype("int64")
        scores = _products(mine["v"].tolist(), block["w"].tolist(), width)
        ids, found = block["id"].to_numpy(), []
        for i, qid in enumerate(mine["qid"].to_numpy()):
            other = np.flatnonzero(ids != qid)
            at = other[_best(scores[i, other], ids[other], k)]
            found.append(pd.DataFrame({"qid": qid, "vec_id": ids[at], "score": scores[i, at], "annulus": mine["annulus"].iloc[0]}))
        return pd.concat(found)

    def scanned(pairs: DataFrame) -> DataFrame:
        # queries come in blocks (q): an annulus meets a bounded number of them at a time
        met = pairs.select(F.col("annulus").alias("of"), F.col("q").alias("block")).distinct().join(blocks, F.col("of") == blocks.annulus)
        met = met.select("of", "block", "id", F.col("v").alias("w"))
        return pairs.groupBy("annulus", "q").cogroup(met.groupBy("of", "block")).applyInPandas(scan, got)

    # the number of query blocks follows the queries
    chosen = base.filter(is_query)
    many = max(1, chosen.count() // QUERIES)
    queries = saved(chosen.select(F.col("id").alias("qid"), F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("q"), "v").groupBy("qid", "q").agg(F.min("v").alias("v")), "queries")
    tasks = min(4096, max(8, queries.count() // 64))
    pairs = saved(queries.repartition(tasks).mapInPandas(seeds, asked), "seeds")
    first = saved(scanned(pairs), "first")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("qid", F.col("score").cast("double").alias("least"))
    seen = pairs.groupBy("qid").agg(F.collect_set("annulus").alias("seen"))
    rest = queries.join(kth, "qid", "left").join(seen, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    more = saved(rest.withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>"))).select("qid", "q", "v", "least", "seen").repartition(tasks).mapInPandas(later, asked), "later")
    every = first.select("qid", "vec_id", "score").union(scanned(more).select("qid", "vec_id", "score"))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
           where embedding is not null and vec_id is not null
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             cast(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

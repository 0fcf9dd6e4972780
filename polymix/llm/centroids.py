"""Clustering of integer vectors around centroids, by tables of squared differences.

Vectors are written once as blocks: for each dimension the distinct integers that occur in the block, and for each vector and dimension
the place of its integer among them. A round makes one table a block: the squared difference of each (dimension, occurring
integer) to each centroid. Distances are then gathers from that table, added over the dimensions; no vector is multiplied. Sums per
cluster are made in the tasks, so a row per task and cluster is shuffled, and the centroids are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved
from .topk import integers

#: Vectors of a block: its table holds at most as many integers a dimension.
ROWS = 4096
#: Integers up to this size keep every distance of up to 2**10 dimensions within 64 bits; larger ones are taken as Python's.
SMALL = 1 << 25
MOST = (1 << 63) - 1


def encoded(base: DataFrame, width: int, rows: int = ROWS) -> DataFrame:
    """Blocks: ids, values (the integers that occur, dimension by dimension), ends (where each dimension's integers end), codes (vector by vector, a
    place in ``values`` per dimension, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _even(batches, rows):
            flat = b.column("v").flatten().to_numpy().reshape(-1, width)
            values, ends, codes, total = [], [], np.empty(flat.shape, np.int32), 0
            for d in range(width):
                own, at = np.unique(flat[:, d], return_inverse=True)
                codes[:, d] = at.reshape(-1) + total
                total += len(own)
                values.append(own)
                ends.append(total)
            columns = [pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([np.concatenate(values)], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "values", "ends", "codes"])
        release()

    return base.select("id", "v").mapInArrow(run, "ids array<long>, values array<long>, ends array<int>, codes binary")


def _even(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while (n := sum(x.num_rows for x in held)) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole.slice(0, rows)
            held = [whole.slice(rows)] if n > rows else []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Block:
    """The vectors of a row of ``encoded``."""

    def __init__(self, row: dict):
        self.ids, self.values = np.array(row["ids"], np.int64), np.array(row["values"], np.int64)
        self.ends = np.array(row["ends"])
        self.codes = np.frombuffer(row["codes"], np.int32).reshape(len(self.ids), len(self.ends))

    def table(self, centroids: list[list[int]]) -> np.ndarray:
        """A row per occurring integer of each dimension, a column per centroid: their squared difference."""
        most = max((abs(x) for c in centroids for x in c), default=0)
        wide = max(most, int(np.abs(self.values.astype(float)).max(initial=0))) > SMALL or len(self.ends) > 1024
        kind = object if wide else np.int64
        size = np.diff(self.ends, prepend=0)
        out = np.empty((len(self.values), len(centroids)), kind)
        values = self.values.astype(kind)
        for k, c in enumerate(centroids):
            gap = values - np.repeat(np.array(c, kind), size)
            out[:, k] = gap * gap
        return out

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (the smaller number, if tied), and the squared distance."""
        table = self.table(centroids)
        total = np.zeros((len(self.ids), len(centroids)), table.dtype)
        for d in range(self.codes.shape[1]):
            total += table[self.codes[:, d]]
        best = total.argmin(1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> list[tuple[int, list[int]]]:
        """Count and componentwise sum of each cluster."""
        return [(int(m.sum()), [int(x) for x in self.values[self.codes[m]].sum(0, dtype=object if self.big else np.int64)]) for m in (cluster == c for c in range(k))]

    @property
    def big(self) -> bool:
        return float(np.abs(self.values.astype(float)).max(initial=0)) * len(self.ids) >= 1 << 62


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield Block(b.slice(i, 1).to_pylist()[0])
    release()


def first_centroids(base: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of salt and id, in that order; rows that repeat an id go by their components."""
    rows = base.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), "v").limit(k).select("v").collect()
    return [list(r.v) for r in rows]


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The next round's centroids: floor of the exact mean of each cluster; an empty one stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * len(centroids[0]) for _ in range(k)]
        for block in _blocks(batches):
            for c, (n, s) in enumerate(block.sums(block.nearest(centroids)[0], k)):
                count[c] += n
                total[c] = [a + b for a, b in zip(total[c], s, strict=True)]
        exact = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count, pa.int64()), pa.array([[Decimal(x) for x in t] for t in total], exact)], names=["cluster", "n", "total"])

    # one row a task and cluster
    parts = blocks.mapInArrow(run, "cluster int, n long, total array<decimal(38,0)>").filter("n > 0")
    each = parts.select("cluster", "n", F.posexplode("total").alias("d", "x"))
    sums = each.groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out = [list(c) for c in centroids]
    for r in sums:
        out[r.cluster][r.d] = int(r.x) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, ident: str = "vec_id", vector: str = "embedding", salt: str = "1:", where: Column | None = None) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of its final centroid).

    Components become floor(scale * x). Vectors that are null, hold a null or a number that isn't finite, or haven't exactly ``width`` components take no
    part, nor do rows without an id. Rows that repeat an id are vectors each. Fewer than ``k`` vectors give fewer centroids, equal vectors may be
    centroids at once (ties go to the smaller number, so the later one stays empty and where it is); an empty table gives no rows. Other
    columns are ignored. Distances are exact; one beyond the range of long counts as its end.
    """
    spark = vectors.sparkSession
    base = integers(vectors if where is None else vectors.filter(where), ident, vector, scale).filter(F.size("v") == width)
    blocks = saved(encoded(base, width), "blocks")
    centroids = first_centroids(base, k, salt)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            best, distance = block.nearest(centroids)
            held = np.minimum(distance, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(best.astype(np.int32)), pa.array(held)], names=["vec_id", "cluster", "distance"])

    found = saved(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    held = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, Decimal(sums.get(c, 0)), Decimal(sum(sums.values())), digest[c]) for c in range(len(centroids))], "cluster int, own decimal(38,0), every decimal(38,0), centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # a row per centroid
    return out.select("vec_id", "cluster", "distance", held(F.col("own")).alias("cluster_inertia"), held(F.col("every")).alias("inertia"), "centroid_sha256")


_ASSIGN = """
d{n} as (select k.vec_id, k.e, c.cluster, cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.e, c.e)]) as bigint) as distance
         from kept k cross join c{n} c),
a{n} as (select vec_id, any_value(e) as e, min(cluster) as cluster, min(distance) as distance
         from (select *, min(distance) over (partition by vec_id) as least from d{n}) where distance = least group by vec_id)"""
_MOVE = """
s{n} as (select cluster, i, sum(e[i]) as s, count(*) as n from a{n}, range(1, 65) r(i) group by cluster, i),
m{n} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from s{n} group by cluster),
c{next} as (select c.cluster, coalesce(m.e, c.e) as e from c{n} c left join m{n} m using (cluster))"""

ORACLE = (
    """
with kept as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
              where vec_id is not null and len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as (select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as integer) as cluster, e from kept
       order by sha256('1:' || vec_id) limit 16),"""
    + ",".join(_ASSIGN.format(n=n) + "," + _MOVE.format(n=n, next=n + 1) for n in range(3))
    + ","
    + _ASSIGN.format(n=3)
    + """
select a.vec_id, a.cluster, a.distance, cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256
from a3 a join c3 c using (cluster)
"""
)

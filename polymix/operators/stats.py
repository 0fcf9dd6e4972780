"""Marker statistics and the two matrix-vector products as grouped sums.

The standardised matrix x = (d - mave) * mstd is never made: sums run over the cells that are not zero, and the rest follows
from totals. Every shuffle is keyed by marker or individual, with partial sums before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of packed rows in a batch.
ROW_BYTES = 4 << 20


def _is(d: int | None) -> Column:
    return F.col("d").isNull() if d is None else F.col("d") == d


def class_counts(geno: DataFrame) -> DataFrame:
    return geno.groupBy("marker_id").agg(F.count_if(_is(1)).alias("n1"), F.count_if(_is(2)).alias("n2"), F.count_if(_is(None)).alias("nm"))


def moments(n: int) -> tuple[Column, Column]:
    """Mean, and the sum of squares about it (missing cells add nothing), from the class counts of a marker."""
    mave = (F.col("n1") + 2 * F.col("n2")) / (F.lit(n) - F.col("nm")).cast("double")
    zeros = F.lit(n) - F.col("nm") - F.col("n1") - F.col("n2")
    ss = F.col("n1") * (1 - mave) * (1 - mave) + F.col("n2") * (2 - mave) * (2 - mave) + zeros * mave * mave
    return mave, ss


def marker_stats(geno: DataFrame, n: int) -> DataFrame:
    """marker_id, n1, n2, nm, mave, mstd; markers that don't vary are left out (their scale is infinite)."""
    mave, ss = moments(n)
    return class_counts(geno).withColumns({"mave": mave, "ss": ss}).filter("ss > 0").withColumn("mstd", F.sqrt(F.lit(n - 1.0) / F.col("ss"))).drop("ss")


def marker_dot(geno: DataFrame, vec: DataFrame, n: int, value: str) -> DataFrame:
    """x'v per marker in one pass over the cells: class counts and sums of the vector come from the same aggregate."""
    v = F.col(value)
    total = vec.agg(F.sum(value)).first()[0] or 0.0
    zero = F.lit(0.0)
    sums = geno.join(vec, "ind_id").groupBy("marker_id").agg(
        F.count_if(_is(1)).alias("n1"), F.count_if(_is(2)).alias("n2"), F.count_if(_is(None)).alias("nm"),
        F.sum(F.when(_is(1), v).otherwise(zero)).alias("s1"), F.sum(F.when(_is(2), v).otherwise(zero)).alias("s2"), F.sum(F.when(_is(None), v).otherwise(zero)).alias("sm"),
    )
    mave, ss = moments(n)
    sums = sums.withColumns({"mave": mave, "ss": ss}).filter("ss > 0").withColumn("mstd", F.sqrt(F.lit(n - 1.0) / F.col("ss")))
    return sums.withColumn("num", F.col("mstd") * (F.col("s1") + 2 * F.col("s2") - F.col("mave") * (F.lit(total) - F.col("sm")))).drop("ss")


def residual_update(geno: DataFrame, stats: DataFrame, delta: DataFrame, individuals: DataFrame, raw: bool = False) -> DataFrame:
    """ind_id, delta_eps: the sum over markers of delta_beta * x. Markers whose delta is zero drop out before the join. A missing cell adds nothing,
    or (``raw``) counts as no copy."""
    moved = stats.join(delta.filter("delta_beta <> 0"), "marker_id").select("marker_id", (F.col("mstd") * F.col("delta_beta")).alias("a"), "mave")
    flat = moved.agg(F.sum(F.col("a") * F.col("mave"))).first()[0] or 0.0
    own = F.when(_is(None), F.lit(0.0) if raw else F.col("a") * F.col("mave")).otherwise(F.col("a") * F.col("d"))
    per = geno.join(moved, "marker_id").groupBy("ind_id").agg(F.sum(own).alias("s"))
    return individuals.select("ind_id").join(per, "ind_id", "left").select("ind_id", (F.coalesce("s", F.lit(0.0)) - F.lit(flat)).alias("delta_eps"))


def prefix(df: DataFrame, key: str, value: Column, out: str, width: int = 65536) -> DataFrame:
    """Running sum of ``value`` before each row in the order of distinct integers ``key`` (any of 64 bits), level by level: within ranges of
    ``width`` keys, of ``width`` such ranges, and so on. A window holds ``width`` rows at most, and ranges meet by equality of their numbers: no
    task sees the whole order and nothing is broadcast."""
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, reach = ends.low or 0, (ends.high or 0) - (ends.low or 0)
    # the distance from the least key may take more than 63 bits
    kind = "bigint" if reach < 1 << 63 else "decimal(20,0)"
    place = F.call_function("div", F.col(key).cast(kind) - F.lit(low).cast(kind), F.lit(width).cast(kind)).cast("long")
    levels = 1
    while reach >= width**levels:
        levels += 1
    return _running(df.withColumn("_p", place), key, value, out, width, levels - 1)


def _running(df: DataFrame, order: str, value: Column, out: str, width: int, levels: int) -> DataFrame:
    """``_p``: the range of each row. ``levels``: how many more there are above it."""
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return df.withColumn(out, own).drop("_p")
    totals = df.groupBy("_p").agg(F.sum(value).alias("_t")).withColumnRenamed("_p", "_range").withColumn("_p", F.expr(f"_range div {width}"))
    above = _running(totals, "_range", F.col("_t"), "_before", width, levels - 1).select(F.col("_range").alias("_p"), F.col("_before").alias("_above"))
    return df.withColumn("_own", own).join(above, "_p").withColumn(out, F.col("_own") + F.col("_above")).drop("_p", "_own", "_above")


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    return prefix(df, key, F.lit(1), out)


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a counted number of rows. They come as Arrow batches: no object per row on the driver."""
    found = df.toArrow()
    return [found.column(i).to_numpy() for i in range(found.num_columns)]


def vector(df: DataFrame, place: str, value: str, n: int) -> np.ndarray:
    """A column of ``df`` as a vector of ``n`` doubles, by dense number."""
    (at, values), out = arrays(df.select(place, F.col(value).cast("double"))), np.zeros(n)
    out[at] = values
    return out


def block_of(marker: Column, markers: int, blocks: int) -> Column:
    """Even split: the first markers % blocks blocks hold one more."""
    q, r = divmod(markers, blocks)
    edge = r * (q + 1)
    return F.when(marker < edge, F.floor(marker / (q + 1))).otherwise(r + F.floor((marker - edge) / max(q, 1))).cast("long")


def node_of(task: Column, tasks: int, per_node: int) -> Column:
    """The node of a task, where nodes take ``per_node`` tasks as far as needed and the others one less, in the order of the tasks."""
    nodes = -(-tasks // per_node)
    full = tasks + nodes * (1 - per_node)
    edge = full * per_node
    return F.when(task < edge, F.floor(task / per_node)).otherwise(full + F.floor((task - edge) / max(per_node - 1, 1))).cast("long")


def trait_dots(cells: DataFrame, traits: DataFrame) -> DataFrame:
    """Per marker and trait: n1, n2, nm, mave, mstd, num over the individuals whose trait is known. ``traits``: ind_id, trait, y (null:
    not in the trait's mask). One shuffle of the cells, keyed by individual, and partial sums per marker and trait."""
    known = traits.filter("y is not null")
    moments_of = known.groupBy("trait").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))
    z = known.join(F.broadcast(moments_of), "trait").select("ind_id", "trait", ((F.col("y") - F.col("m")) / F.col("s")).alias("z"))  # a row per trait
    over = lambda d: F.sum(F.when(_is(d), F.col("z")).otherwise(0.0))
    sums = cells.join(z, "ind_id").groupBy("marker_id", "trait").agg(
        F.count_if(_is(1)).alias("n1"), F.count_if(_is(2)).alias("n2"), F.count_if(_is(None)).alias("nm"), over(1).alias("s1"), over(2).alias("s2"), over(None).alias("sm"))
    sums = sums.join(F.broadcast(moments_of.select("trait", "n")), "trait")
    mave = (F.col("n1") + 2 * F.col("n2")) / (F.col("n") - F.col("nm")).cast("double")
    zeros = F.col("n") - F.col("nm") - F.col("n1") - F.col("n2")
    ss = F.col("n1") * (1 - mave) * (1 - mave) + F.col("n2") * (2 - mave) * (2 - mave) + zeros * mave * mave
    sums = sums.withColumns({"mave": mave, "ss": ss}).filter("ss > 0").withColumn("mstd", F.sqrt((F.col("n") - 1.0) / F.col("ss")))
    # the masked trait sums to zero over its individuals
    return sums.withColumn("num", F.col("mstd") * (F.col("s1") + 2 * F.col("s2") + F.col("mave") * F.col("sm"))).drop("ss")


def pack(geno: DataFrame, individuals: int) -> DataFrame:
    """marker_id, packed: two bits per individual, low bits first, 00=2 01=missing 10=1 11=0. One shuffle by marker; the list of a
    marker's cells is bounded by the individuals, as its packed row is."""
    lists = geno.groupBy("marker_id").agg(F.collect_list(F.struct("ind", F.coalesce("d", F.lit(-1)).alias("d"))).alias("cells"))
    flat = lists.select("marker_id", F.col("cells.ind").alias("ind"), F.col("cells.d").alias("d"))
    code = np.array([3, 2, 0, 1], np.uint8)  # dosages 0, 1, 2 and missing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROW_BYTES // max(1, -(-individuals // 4)))
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            out = []
            for ind, d in zip(batch.column("ind"), batch.column("d"), strict=True):
                codes = np.full(-(-individuals // 4) * 4, 3, np.uint8)
                codes[ind.values.to_numpy()] = code[d.values.to_numpy()]
                c = codes.reshape(-1, 4)
                out.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("marker_id"), pa.array(out, pa.binary())], names=["marker_id", "packed"])

    return flat.select(F.col("marker_id").cast("long").alias("marker_id"), F.col("ind").cast("array<int>").alias("ind"), F.col("d").cast("array<int>").alias("d")).mapInArrow(run, "marker_id long, packed binary")


def unpack(packed: DataFrame, individuals: int) -> DataFrame:
    """marker_id, ind, d: cells that aren't zero, by a table of the four dosages of every byte. No shuffle."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    dosage = np.array([2, -1, 1, 0], np.int8)[codes]  # -1: missing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marker, row in zip(batch.column("marker_id").to_pylist(), batch.column("packed"), strict=True):
                d = dosage[np.frombuffer(row.as_buffer(), np.uint8)].reshape(-1)[:individuals]
                at = np.flatnonzero(d)
                held = d[at].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), marker)), pa.array(at.astype(np.int32)), pa.array(held, mask=held < 0)], names=["marker_id", "ind", "d"])

    return packed.select(F.col("marker_id").cast("long").alias("marker_id"), "packed").mapInArrow(run, "marker_id long, ind int, d int")

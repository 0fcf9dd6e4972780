"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver. There multiplicative weights give prices to the
lengths, a knapsack dynamic program prices configurations (ways to fill one sequence), and the fractional multiplicities
are rounded; what stays over goes to the fullest sequence it fits. Every histogram takes this way. The plan is a bounded table of configurations: piece
number r of its length finds its sequence and place in it by arithmetic, so no piece is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import chunk_tokenizer
from .common import saved, slices, trim, whole_text

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dynamic program over items (a length, 1, 2, 4, ... of its at most ``most`` copies): of each item its length's index, its copies, and for
    each capacity whether the best filling takes it."""
    items = [(j, min(1 << k, m - (1 << k) + 1)) for j, m in enumerate(most.tolist()) for k in range(m.bit_length())]
    own, copies = (np.array(x) for x in zip(*items, strict=True))
    best, took = np.zeros(capacity + 1), np.zeros((len(own), capacity + 1), bool)
    for i, (size, value) in enumerate(zip((lengths[own] * copies).tolist(), (price[own] * copies).tolist(), strict=True)):
        more = best[:-size] + value
        took[i, size:] = more > best[size:]
        best[size:] = np.maximum(more, best[size:])
    return own, copies, took


def traced(program: tuple[np.ndarray, np.ndarray, np.ndarray], lengths: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The best filling of each room: how many of each length."""
    own, copies, took = program
    room, out = room.copy(), np.zeros((len(room), len(lengths)), np.int64)
    for j, n, item in zip(own[::-1].tolist(), copies[::-1].tolist(), took[::-1], strict=True):
        taken = item[room]
        out[taken, j] += n
        room[taken] -= n * int(lengths[j])
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float, steep: float) -> Counter:
    """Multiplicities of configurations that cover ``demand``: in each round, lengths whose cover lags behind the round's share are dear, and
    each takes the best configuration that holds it. A configuration holds no more of a length than there is. Long pieces are worth a
    little more than their length, so that short ones are kept for what rounding leaves."""
    cover, used = np.zeros(len(lengths)), Counter()
    most = np.minimum(demand, capacity // lengths).astype(np.int64)
    for t in range(1, rounds + 1):
        target = t / rounds
        price = lengths * (lengths / capacity) ** steep * np.exp(rate * np.clip(target - cover / demand, -2, 2))
        fillings = traced(knapsack(price, lengths, most, capacity), lengths, capacity - lengths)
        for j in range(len(lengths) - 1, -1, -1):
            need = target * demand[j] - cover[j]
            if need <= 1e-9 * demand[j]:
                continue
            held = fillings[j]
            held[j] = min(held[j] + 1, most[j])
            step = need / held[j]
            cover += held * step
            used[tuple((int(i), int(held[i])) for i in np.flatnonzero(held)[::-1])] += step
    return used


def best_fit(counts: dict[int, int], capacity: int, begun: Counter | None = None) -> Counter:
    """Longest first, each into the fullest sequence with room, of those ``begun`` and of new ones: multiplicities of the resulting
    configurations."""
    open_: dict[int, Counter] = {}  # room -> configurations with that room
    rooms = np.zeros(capacity + 1, bool)

    def put(config: Counter | dict, room: int, n: int) -> None:
        open_.setdefault(room, Counter())[tuple(sorted(config.items(), reverse=True))] += n
        rooms[room] = True

    for config, n in (begun or {}).items():
        put(dict(config), capacity - sum(k * m for k, m in config), n)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = int(rooms[length:].argmax()) + length if rooms[length:].any() else -1
            if room < 0:
                config, have, room = Counter(), left, capacity
            else:
                config, have = open_[room].popitem()
                config = Counter(dict(config))
                if not open_[room]:
                    rooms[room] = False
            fit = room // length
            n, rest = (min(have, left // fit), fit) if left >= fit else (1, left)
            if have > n and config:
                put(config, room, have - n)
            config[length] += rest
            left -= n * rest
            put(config, room - rest * length, n)
    out: Counter = Counter()
    for configs in open_.values():
        out.update(configs)
    return out


def rounded(histogram: dict[int, int], capacity: int, rounds: int = 4, rate: float = 2.0, steep: float = 0.3) -> tuple[Counter, Counter]:
    """The program's configurations with whole multiplicities, and the pieces that are left over: fullest first, each is taken as often as the
    program says, rounded down but once at least, as far as its pieces are still there."""
    left, chosen = Counter({k: v for k, v in histogram.items() if v}), Counter()
    lengths = np.array(sorted(left), np.int64)
    if not len(lengths):
        return chosen, left
    found = fractional(lengths, np.array([left[int(x)] for x in lengths], float), capacity, rounds, rate, steep)
    fill = lambda c: sum(int(lengths[j]) * n for j, n in c)
    for config, times in sorted(found.items(), key=lambda x: (-fill(x[0]), x[0])):
        own = [(int(lengths[j]), n) for j, n in config]
        if m := min(max(1, int(times)), *(left[k] // n for k, n in own)):
            chosen[tuple(own)] += m
            for k, n in own:
                left[k] -= m * n
    return chosen, +left


def plan(histogram: dict[int, int], capacity: int, passes: int = 5) -> list[tuple[Config, int]]:
    """Configurations with multiplicities that hold exactly the pieces of ``histogram``: those of the program, solved again for what rounding leaves
    (``passes`` times in all); the rest goes where it fits best."""
    chosen, left = Counter(), histogram
    for _ in range(passes):
        found, left = rounded(left, capacity)
        chosen.update(found)
    return sorted(best_fit(left, capacity, chosen).items())


class Places:
    """Piece number r of a length -> sequence and offset, from the plan."""

    def __init__(self, planned: list[tuple[Config, int]]):
        first, by = 0, {}
        for config, times in planned:
            offset = 0
            for length, n in config:
                by.setdefault(length, []).append((n * times, n, first, offset))
                offset += length * n
            first += times
        self.n_sequences = first
        self.by = {}
        for length, rows in by.items():
            a = np.array(rows, np.int64)
            self.by[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, per, first, offset = self.by[length]
        k = np.searchsorted(start, rank, side="right") - 1
        within = rank - start[k]
        return first[k] + within // per[k], offset[k] + within % per[k] * length


def pieces_of(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and which (tells rows of one doc_id apart)."""
    end = np.uint16(end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("which", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with chunk_tokenizer(tokenizer, spaced) as encoder:
            for part in (s for b in batches for s in slices(b, "text", 4_000_000)):
                rows = []
                ids, at = encoder.encode(part.column("text"))
                for doc_id, which, x, y in zip(part.column("doc_id").to_pylist(), part.column("which").to_pylist(), at, at[1:], strict=False):
                    wide = np.append(ids[x:y], end).astype("<u4")
                    cuts = [0, *range(len(wide) % capacity or capacity, len(wide) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, which, k, a, b - a, zlib.crc32(wide[a:b].tobytes())))
                columns = zip(*rows, strict=True)
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                del ids, at, rows, columns
                trim()
                yield out

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("which", F.xxhash64("text"))
    return base.mapInArrow(run, "doc_id long, which long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone. Documents longer than ``capacity`` are cut so that only the
    first piece is shorter. Rows that repeat are packed each. An empty table gives no rows; other columns are ignored.

    The pieces (no texts, no ids) are written once, shuffled once by (bucket, length) to be numbered within it; counts per
    bucket and length give the numbers before it. Buckets grow with the pieces, so a length that many share is spread.
    """
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, tokenizer, spaced, end_id, capacity), "pieces")
    histogram = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    buckets = max(16, sum(histogram.values()) // 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "which", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "which", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset, order = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    sequence[at], offset[at] = places.value.find(int(length[at[0]]), rank[at])
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

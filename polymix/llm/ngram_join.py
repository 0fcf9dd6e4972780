"""Exact self-join of documents on the Jaccard similarity of their word shingles, by grouped prefixes.

1. Shingles are 64-bit hashes. A table of fixed size counts all of them by hash bucket; its counts, then the hashes, give the global
   order (rare before frequent). A document's prefix is the start of its set in that order, long enough that linked documents
   share a part of it.
2. Rows with equal sets are one class, classes with equal prefixes and sizes one group. Classes are the nodes, numbered as they
   are written; a doc_id only names the component at the end, so it may be null or repeat.
3. Stars: classes that share the smallest hash of one of some permutations are compared with one of them. All classes that
   these links join take one label, so the members of a large cluster of near copies need not be paired.
   Groups of near copies that stay apart are compared, token by token of their prefixes, with the most central group that holds it, then
   with the most central ones of a few lots. A group is central if the tokens of its prefix are held by many: a copy with few changes
   of its own links with most of the others, a random one with few.
4. Groups that share a token of their prefixes, fit in size and don't have one label alone meet at places where their first shared
   token may lie, and are candidates if what they share there and all that is left can make a link. Tokens whose groups
   all have one label are dropped before the join. Where both groups are one class each, their parity bitmaps must not differ in more
   bits than linked sets of these sizes can differ in shingles.
5. Candidates are expanded to their classes and verified on their whole sets: the texts of a class and of its partners meet in
   one place, where their shingles are made again as 128-bit hashes.

Shingles are 64-bit hashes in steps 1 to 4. A collision there can only add a candidate or move the order of a prefix, alike in all
documents; two shingles of one document that collide (about one in 1e13 for a thousand shingles) would count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, saved, sized, slices, whole_text

COUNT_BITS, BLOCK = 21, 65536
#: Bits of a set's parity bitmap.
PARITY = 512
STARS = 3
#: Lots of groups that have a hub each, by round.
LOTS = (1, 3)
#: Partners of one class that meet in one place; more are spread, and the class's text goes to each place.
FAN = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd, so that its powers can be divided out.
_P = 0x100000001B3 * 0x9E3779B1 % (1 << 64) | 1
#: Odd as well, for the other half of a 128-bit hash.
_P2 = 0xD1B54A32D192ED03
_SALTS = np.array([k * 0xD6E8FEB86659FD93 % (1 << 64) for k in range(12)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of ``width``-word shingles as sorted distinct hashes; ASCII letters folded, words parted by ASCII white space."""

    def __init__(self, width: int, prime: int = _P):
        self.width, self.prime = width, prime
        fold = np.arange(256, dtype=np.uint64)
        fold[65:91] += np.uint64(32)
        self.fold = _mix(fold + np.uint64(1))
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        self.up, self.down = (np.cumprod(np.concatenate([one, np.full(n, p, np.uint64)])) for p in (self.prime, pow(self.prime, -1, 1 << 64)))

    def words(self, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (and the last one's end)."""
        word = ~self.blank[b]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = own[1:-1][(own[1:-1] > 0) & (own[1:-1] < len(b))]
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        if len(self.up) <= len(b):
            self._powers(len(b))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.fold[b] * self.up[: len(b)])])
        h = (sums[last + 1] - sums[first]) * self.down[first]
        return _mix(h + (last - first).astype(np.uint64)), np.searchsorted(first, own)

    def sets(self, texts: pa.StringArray) -> list[np.ndarray]:
        return list(map(np.unique, self.shingles(texts)))

    def shingles(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Of each text, in order, with repeats."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        w, cuts = self.words(b, (offsets - offsets[0]).astype(np.int64))
        n, s = self.width, w
        for k in range(1, n):
            s = _mix(s[: len(w) - k] * _A + w[k:]) if len(w) > k else s[:0]
        out = []
        for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if z - a >= n:
                out.append(s[a : z - n + 1])
            elif z > a:
                few = w[a]
                for x in w[a + 1 : z]:
                    few = _mix(np.array([few * _A + x]))[0]
                out.append(_mix(np.array([few + np.uint64(z - a)])))
            else:
                out.append(w[:0])
        return out


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_key().alias("key"), whole_text().alias("text"))


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(whole_text())


def _per_text(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple[pa.RecordBatch, list]]:
    with np.errstate(over="ignore"):
        for part in (s for b in batches for s in slices(b, "text", 300_000)):
            yield part, make(part.column("text"))
    release()


def bucket_counts(base: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a shingle of each hash bucket, over all documents; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for _, sets in _per_text(batches, Shingler(width).sets):
            if sets:
                at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNT_BITS), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) // BLOCK)), pa.array([x.tobytes() for x in total.reshape(-1, BLOCK)], pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    blocks = base.select("text").mapInArrow(count, "block long, counts binary")
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in blocks.groupBy("block").applyInArrow(add, "block long, counts binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def described(base: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: doc_id, key (of the text), n, whole (digest of the set), head (digest of the prefix), prefix, stars, bits (``parity``)."""
    counts = base.sparkSession.sparkContext.broadcast(bucket_counts(base, width))
    digest = lambda a: hashlib.blake2b(a.tobytes(), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for part, sets in _per_text(batches, Shingler(width).sets):
            rows = []
            for s in sets:
                n = len(s)
                rank = table[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | s >> np.uint64(32)
                prefix = s[np.argsort(rank, kind="stable")[: n + (-n * percent // 100) + 1 if n else 0]].view(np.int64)
                stars = [int(_mix(s ^ x).min().view(np.int64)) for x in _SALTS] if n else []
                rows.append((n, digest(s), digest(prefix), prefix, stars, parity(s)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "key", "n", "whole", "head", "prefix", "stars", "bits"])

    return base.mapInArrow(run, "doc_id long, key long, n long, whole binary, head binary, prefix array<long>, stars array<long>, bits array<long>")


def parity(s: np.ndarray) -> np.ndarray:
    """Of each bucket of hashes, whether the set holds an odd number. Bitmaps of two sets differ in no more bits than the sets do in members."""
    odd = np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near_enough(percent: int) -> Column:
    """Whether the sets of ``bits_x`` and ``bits_y`` can link; true where one isn't known."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(PARITY // 64)])
    return F.coalesce(apart <= F.col("n_x") + F.col("n_y") - 2 * least_common("n_x", "n_y", percent), F.lit(True))


def _fits(a: str, b: str, percent: int):
    """Sizes of linked sets can't differ more."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def least_common(a: str, b: str, percent: int) -> Column:
    """What two linked sets of these sizes have in common at least."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)


def least_shared(a: str, b: str, percent: int) -> Column:
    """What their prefixes share at least: of two prefixes, one ends first in the global order, and what it holds and the other doesn't is missing
    in the other's whole set."""
    over = lambda n: F.expr(f"1 - ({n} * {percent} + 99) div 100")  # noqa: E731  (length of the prefix, less the size)
    return least_common(a, b, percent) + F.least(over(a), over(b))


def central(tokens: DataFrame, percent: int) -> DataFrame:
    """With ``central``: how many groups (g) hold a token of the group's prefix, on average. Tokens that are left out count as 0."""
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    return tokens.withColumn("central", F.sum("g").over(Window.partitionBy("gid")) / prefix)


def hubs(tokens: DataFrame, lots: int, percent: int) -> DataFrame:
    """Pairs (a, b) of groups: of more than two groups that hold a token and have several labels, each with the most central one of each lot, where
    they share at least half of what a link needs. ``lots`` rows per group and token at most."""
    tokens = tokens.filter("g > 2")
    first = tokens.groupBy("token", F.pmod(F.xxhash64("gid"), F.lit(lots)).alias("lot")).agg(F.min(F.struct((-F.col("central")).alias("o"), "gid", "n", "low", "high")).alias("c"))
    first = first.select("token", F.col("c.gid").alias("a"), F.col("c.n").alias("na"), F.col("c.low").alias("la"), F.col("c.high").alias("ha"))
    met = tokens.join(first, "token").filter((F.col("gid") != F.col("a")) & _fits("n", "na", percent) & ((F.col("low") < F.col("ha")) | (F.col("la") < F.col("high"))))
    met = met.groupBy("a", "gid", "n", "na").agg(F.count("*").alias("c")).filter(2 * F.col("c") >= least_shared("n", "na", percent))
    return met.select("a", F.col("gid").alias("b"))


def verified(pairs: DataFrame, base: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link; a class's set is made from the row that stands for it.

    A place takes a class ``a`` and up to about ``FAN`` of its partners; it gets the text of ``a`` once and that of each partner, so a
    class with many partners is spread over places.
    """
    pairs = saved(pairs, "pairs")
    fans = pairs.groupBy("a").agg(F.count("*").alias("m"))
    at = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / FAN)).alias("place"))
    roles = at.select(F.col("a").alias("cid"), "a", "place", F.lit(0).alias("role")).distinct()
    roles = roles.union(at.select(F.col("b").alias("cid"), "a", "place", F.lit(1).alias("role")))
    roles = saved(roles.join(classes.select("cid", "whole", "of.doc_id", "of.key"), "cid"), "roles")
    texts = base.join(sized(roles, 100), ["doc_id", "key"]).select("a", "place", "role", "cid", "whole", "text")
    met = texts.repartition("a", "place").sortWithinPartitions("a", "place", "role")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Shingler(width), Shingler(width, _P2)
        make = lambda texts: list(zip(one.shingles(texts), two.shingles(texts), strict=True))
        now = p = p2 = None
        for part, found in _per_text(batches, make):
            keep = []
            for at, role, whole, (h, h2) in zip(zip(part.column("a").to_pylist(), part.column("place").to_pylist(), strict=True), part.column("role").to_pylist(), part.column("whole").to_pylist(), found, strict=True):
                q, first = np.unique(h, return_index=True)
                own = hashlib.blake2b(q.tobytes(), digest_size=16).digest() == whole  # another text may share the key
                if own and role == 0:
                    now, p, p2 = at, q, h2[first]
                if not own or role == 0:
                    keep.append(False)
                    continue
                if now != at:
                    raise RuntimeError("a class came without its text")
                where = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int(((q[where] == p) & (h2[first][where] == p2)).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            linked = part.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([linked.column("a"), linked.column("cid")], names=["a", "b"])

    links = saved(met.mapInArrow(test, "a long, b long"), "links")
    discard(pairs, roles)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Each round takes the smallest label around a node and that label's own
    label, so rounds grow with the logarithm of a chain; labels are written each round."""
    edges = saved(edges.union(edges.select("b", "a")).distinct(), "edges")
    held = labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        moved = saved(step.join(up, "new").select("node", F.least("new", "up").alias("component"), (F.least("new", "up") < F.col("component")).alias("moved")), "labels")
        done = moved.filter("moved").limit(1).count() == 0
        discard(held)
        held, labels = moved, moved.select("node", "component")
        if done:
            discard(edges)
            return labels


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; a document of fewer
    words has its whole sequence as one. Null or empty texts and texts without words have no shingles and link with nothing. Rows that
    repeat a doc_id are compared each by its own text, and those that link with nothing in common may get different components. A null
    doc_id stays null in the output and counts as the smallest. An empty table gives no rows; other columns are ignored.
    """
    return placed(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As ``jaccard_components``, with key (``text_key``) and stays: whether doc_id and key are those that stand for the component,
    or the row has no shingles."""
    base = _documents(docs)
    if base.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        base = base.dropDuplicates(["doc_id", "text"])
    rows = saved(described(base, width, percent), "rows")
    classes = rows.filter("n > 0").groupBy("whole", "head", "n").agg(F.min(F.struct("doc_id", "key", "stars", "prefix", "bits")).alias("c"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "whole", "head", "n", F.struct("c.doc_id", "c.key").alias("of"), "c.stars", "c.prefix", "c.bits")
    wide, classes = rows, saved(classes, "classes")
    rows = saved(rows.select("doc_id", "key", "n", "whole"), "rows")
    discard(wide)
    stars = classes.select("cid", "of", "n", "stars", F.posexplode(F.slice("stars", 1, STARS)).alias("k", "star"))
    centres = stars.groupBy("k", "star").agg(F.min(F.struct("of", "cid", "n", "stars")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    centres = centres.select("k", "star", F.col("c.cid").alias("a"), F.col("c.n").alias("na"), F.col("c.stars").alias("of_a"))
    spokes = stars.join(centres, ["k", "star"]).filter((F.col("a") != F.col("cid")) & _fits("n", "na", percent))
    # a star only saves work: pairs whose smallest hashes mostly differ are left to the exact step
    alike = F.size(F.filter(F.zip_with("stars", "of_a", lambda p, q: p == q), lambda e: e))
    spokes = spokes.filter(alike >= len(_SALTS) // 2)
    linked = verified(spokes.select("a", F.col("cid").alias("b")).distinct(), base, classes, width, percent)
    labels = components(linked).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    wide = classes
    classes = saved(classes.drop("stars", "prefix", "bits").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labelled")

    groups = classes.groupBy("head", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    groups = saved(groups, "groups")
    # the group's prefix comes from one of its classes
    heads = wide.select("cid", "prefix").join(sized(groups.select(F.col("gid").alias("cid"), "n", "low", "high"), 64), "cid")
    tokens = heads.select(F.col("cid").alias("gid"), "n", "low", "high", F.posexplode("prefix").alias("pos", "token"))
    # partial sums before the shuffle: a token that very many groups hold is a row per task
    held = tokens.groupBy("token").agg(F.count("*").alias("g"), F.min("low").alias("least_label"), F.max("high").alias("most_label"))
    held = saved(held.filter("g > 1 and least_label < most_label").select("token", "g"), "held")
    tokens = saved(central(tokens.join(sized(held, 28), "token"), percent), "tokens")
    bits = saved(wide.select(F.col("cid").alias("gid"), "bits"), "bits")
    discard(wide, held)
    # groups of near copies that the stars left apart: a token's groups are compared with a few of them
    links = labels.filter("label < cid").select(F.col("label").alias("a"), F.col("cid").alias("b"))
    for lots in LOTS:
        links = links.union(verified(hubs(tokens, lots, percent).distinct(), base, classes, width, percent))
        labels = components(links).select(F.col("node").alias("cid"), F.col("component").alias("label"))
        classes = saved(classes.drop("label").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labelled")
        groups = saved(classes.groupBy("head", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")), "groups")
        apart = tokens.drop("low", "high").join(sized(groups.select("gid", "low", "high"), 40), "gid")
        held = apart.groupBy("token").agg(F.min("low").alias("least_label"), F.max("high").alias("most_label")).filter("least_label < most_label").select("token")
        tokens = saved(apart.join(sized(saved(held, "held"), 20), "token"), "tokens")
    # a group of several classes has no bitmap of its own
    alone = bits.join(groups.filter("m = 1").select("gid"), "gid", "left_semi")
    tokens, bare = tokens.join(alone.hint("shuffle_merge"), "gid", "left"), tokens
    x, y = (tokens.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "low", "high", "pos", "bits"))) for s in "xy")
    need = least_common("n_x", "n_y", percent)
    differ = (F.col("low_x") < F.col("high_y")) | (F.col("low_y") < F.col("high_x"))
    # a pair meets where its first shared token may lie: enough tokens must be left from there on
    room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    found = x.join(y, "token").filter((F.col("gid_x") < F.col("gid_y")) & _fits("n_x", "n_y", percent) & differ & (room >= need) & near_enough(percent))
    shared = found.groupBy("gid_x", "gid_y").agg(F.count("*").alias("c"), F.min(room).alias("left"), F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"))
    # what is shared up to the last of these places, and all that is left after it, must do
    shared = saved(shared.filter(F.col("c") + F.col("left") - 1 >= need).select("gid_x", "gid_y", "n_x", "n_y"), "shared")
    discard(bits)
    own = bare.groupBy("gid").agg(F.collect_list("token").alias("held"))  # a part of a prefix
    both = shared.join(own.select(F.col("gid").alias("gid_x"), F.col("held").alias("held_x")), "gid_x").join(own.select(F.col("gid").alias("gid_y"), F.col("held").alias("held_y")), "gid_y")
    shared = both.filter(F.size(F.array_intersect("held_x", "held_y")) >= least_shared("n_x", "n_y", percent))
    found = shared.select(F.col("gid_x").alias("x"), F.col("gid_y").alias("y")).union(groups.filter("m > 1 and low < high").select(F.col("gid").alias("x"), F.col("gid").alias("y")))
    members = classes.join(groups.select("head", "n", "gid"), ["head", "n"]).select("gid", "cid", "label")
    a = members.select(F.col("gid").alias("x"), F.col("cid").alias("a"), F.col("label").alias("of_a"))
    b = members.select(F.col("gid").alias("y"), F.col("cid").alias("b"), F.col("label").alias("of_b"))
    pairs = found.join(a, "x").join(b, "y").filter((F.col("of_a") != F.col("of_b")) & ((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))))
    more = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), base, classes, width, percent)

    reach = components(links.union(more))
    if rows.count() != (all_rows := _documents(docs)).count():  # rows that were repeated
        rows = saved(described(all_rows, width, percent).select("doc_id", "key", "n", "whole"), "rows")
    named = reach.join(classes.select(F.col("cid").alias("node"), "of"), "node")
    named = reach.join(named.groupBy("component").agg(F.min("of").alias("first")), "component").select(F.col("node").alias("cid"), "first")
    own = rows.join(classes.select("whole", "cid", "of").join(named, "cid", "left").select("whole", F.coalesce("first", "of").alias("first")), "whole", "left")
    null = lambda c: F.when(c > -(1 << 63), c)
    least = F.coalesce("first.doc_id", "doc_id")
    stays = F.coalesce(F.col("first") == F.struct("doc_id", "key"), F.lit(True))
    return own.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(least).alias("component_id"), "key", stays.alias("stays"))

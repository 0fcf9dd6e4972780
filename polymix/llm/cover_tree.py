"""Near-duplicate vectors of a label by cosine, with dual traversal of cover trees.

On the unit sphere cosine >= c is distance <= t = sqrt(2 - 2 c). A tree has nested levels of nodes whose radii halve: a
node's children are members of it that lie further apart than the child's radius, each member goes to a child within that radius, and the first child
has its parent's centre. Each node keeps the radius that its members really have. Two trees are walked together: a pair of nodes whose centres lie further
apart than t and both radii holds no link and is dropped; where centres and radii stay within t all members link, and no pair is tested; other
pairs give way to their children, down to pairs of vectors, which are tested exactly.

1. Rows of equal label and vector are one class. A tree over a sample of bounded size gives each label its top: every class goes to the
   nearest node of the lowest level, its cell. A label without a sample is one cell.
2. Cells are cut into blocks of bounded bytes in the order of the distance to the cell's centre; each block is stored with its own tree.
3. Pairs of cells are walked from the top on the driver (at most ``SAMPLE`` nodes). Cells that link as a whole give one row, pairs of cells
   that may hold links give the pairs of their blocks, less those whose rings about the centres lie too far apart.
4. A task walks the trees of a pair of blocks. It gives the number of links of each class and edges that join what is joined, at most one per
   class; linked pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved, sized
from .ngram_join import components
from .topk import usable

#: Vectors of the sample that the tops of the trees are made of; bytes of a block's vectors; levels of a tree.
SAMPLE, BLOCK_BYTES, LEVELS = 512, 1 << 19, 6
#: Distances are known to about 1e-8 where they are small; bounds keep this margin. Cosines within ``NEAR`` of the least one are taken again exactly.
MARGIN, NEAR = 1e-6, 1e-12
#: Pairs of vectors whose products are taken at a time.
AT_ONCE = 1 << 14


class Tree:
    """A cover tree over unit vectors. Nodes lie level by level: ``centre`` (a place in ``order``), ``start`` and ``end`` (members are the places between),
    ``radius`` and ``first``/``last`` (children, none for a leaf). ``order`` is the places of the vectors as they were given."""

    def __init__(self, unit: np.ndarray, levels: int = LEVELS, parts: dict | None = None):
        self.unit = unit
        if parts is not None:
            self.__dict__.update(parts)
            return
        order = np.arange(len(unit))
        self.centre, self.start, self.end = [0], [0], [len(unit)]
        self.radius, self.first, self.last = [_radius(unit, order)], [0], [0]
        begin, cover = 0, 1.0
        for _ in range(levels):
            stop = len(self.centre)
            for node in range(begin, stop):
                s, e = self.start[node], self.end[node]
                if e - s == 1 or self.radius[node] == 0:
                    continue
                own = order[s:e].copy()
                self.first[node] = len(self.centre)
                at = s
                for child in _cover(unit[own], cover):
                    order[at : at + len(child)] = own[child]
                    self._add(unit, order, at, at + len(child))
                    at += len(child)
                self.last[node] = len(self.centre)
            begin, cover = stop, cover / 2
        self.order = order
        self.centre, self.start, self.end, self.first, self.last = (np.array(x) for x in (self.centre, self.start, self.end, self.first, self.last))
        self.radius = np.array(self.radius)

    def _add(self, unit: np.ndarray, order: np.ndarray, start: int, end: int) -> None:
        self.centre.append(start)
        self.start.append(start)
        self.end.append(end)
        self.radius.append(_radius(unit, order[start:end]))
        self.first.append(0)
        self.last.append(0)

    def arrays(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("order", "centre", "start", "end", "radius", "first", "last")}


def _gap(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


def _radius(unit: np.ndarray, own: np.ndarray) -> float:
    """Of members around the first of them."""
    return float(_gap(unit[own] @ unit[own[0]]).max()) if len(own) > 1 else 0.0


def _cover(unit: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Members by child: the first member that no child holds yet becomes one, and takes those within ``radius``."""
    left = np.arange(len(unit))
    while len(left):
        near = _gap(unit[left] @ unit[left[0]]) <= radius
        near[0] = True
        yield left[near]
        left = left[~near]


def walk(a: Tree, b: Tree, most: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Pairs of nodes of both trees, by level: ("all", nodes, nodes) whose members all lie within ``most``, ("test", nodes, nodes) of
    leaves that may. Others hold nothing."""
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ca, cb = a.unit[a.order[a.centre]], b.unit[b.order[b.centre]]
    while len(x):
        gap = np.concatenate([_gap((ca[x[c : c + AT_ONCE]] * cb[y[c : c + AT_ONCE]]).sum(1)) for c in range(0, len(x), AT_ONCE)])
        reach = a.radius[x] + b.radius[y]
        near = gap <= most + reach + MARGIN
        inside = gap + reach <= most - MARGIN
        yield "all", x[inside], y[inside]
        x, y = x[near & ~inside], y[near & ~inside]
        open_a, open_b = a.first[x] < a.last[x], b.first[y] < b.last[y]
        leaf = ~(open_a | open_b)
        yield "test", x[leaf], y[leaf]
        x, y, open_a, open_b = (v[~leaf] for v in (x, y, open_a, open_b))
        x, y = _children(a, b, x, y, open_a, open_b, ca, cb, most)


def _children(a: Tree, b: Tree, x, y, open_a, open_b, ca, cb, most):
    """Pairs of children, a leaf standing for itself; of large families only those whose centres are near enough."""
    out = [], []
    for i in range(len(x)):
        p = np.arange(a.first[x[i]], a.last[x[i]]) if open_a[i] else x[i : i + 1]
        q = np.arange(b.first[y[i]], b.last[y[i]]) if open_b[i] else y[i : i + 1]
        if len(p) * len(q) > 64:
            gap = _gap(ca[p] @ cb[q].T)
            j, k = np.nonzero(gap <= most + a.radius[p][:, None] + b.radius[q] + MARGIN)
            p, q = p[j], q[k]
        else:
            p, q = np.repeat(p, len(q)), np.tile(q, len(p))
        out[0].append(p)
        out[1].append(q)
    return tuple(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out)


def spread(nodes_a: np.ndarray, nodes_b: np.ndarray, a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of members of pairs of leaves."""
    na, nb = (a.end - a.start)[nodes_a], (b.end - b.start)[nodes_b]
    each = na * nb
    own = np.repeat(np.arange(len(each)), each)
    i = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return a.start[nodes_a][own] + i // nb[own], b.start[nodes_b][own] + i % nb[own]


def cosine_exact(x: np.ndarray, y: np.ndarray) -> float:
    """Rounded once for each sum, whatever the order of the components; scaled by powers of two, which changes no digit."""
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
    dot, xx, yy = math.fsum(x * y), math.fsum(x * x), math.fsum(y * y)
    return dot / (math.sqrt(xx) * math.sqrt(yy))


class Block:
    """Vectors of a cell with their tree. ``unit`` is in the order of the tree."""

    def __init__(self, row: dict):
        self.cid, self.weight = np.array(row["cid"], np.int64), np.array(row["weight"], np.int64)
        self.vector = np.frombuffer(row["vectors"], np.float64).reshape(len(self.cid), -1)
        unit = _unit(self.vector)
        self.tree = Tree(unit, parts={k: np.array(row[k]) for k in ("order", "centre", "start", "end", "radius", "first", "last")})
        order = self.tree.order
        self.cid, self.weight, self.vector, self.unit = self.cid[order], self.weight[order], self.vector[order], unit[order]


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first: squares stay in range."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def linked(a: Block, b: Block, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of the classes of both blocks with the other's, and edges that join what is joined. ``same``: both are one block, and each
    pair is met from both sides."""
    most = math.sqrt(max(0.0, 2 - 2 * cosine))
    count_a, count_b = np.zeros(len(a.cid), np.int64), np.zeros(len(b.cid), np.int64)
    before = np.concatenate([[0], np.cumsum(a.weight)]), np.concatenate([[0], np.cumsum(b.weight)])
    label = np.arange(len(a.cid) + len(b.cid))
    ta, tb = a.tree, b.tree

    def join(p: np.ndarray, q: np.ndarray) -> None:
        """Places p of a and q of b are linked: all get the least of their labels, until nothing moves."""
        if not len(p):
            return
        q = q + len(a.cid)
        while True:
            least = np.minimum(label[p], label[q])
            if (least == label[p]).all() and (least == label[q]).all():
                return
            for v in (p, q):
                np.minimum.at(label, label[v], least)
                np.minimum.at(label, v, least)
            while (deeper := label[label] != label).any():
                label[deeper] = label[label[deeper]]

    for kind, x, y in walk(ta, tb, most):
        if kind == "all":
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                sa, ea, sb, eb = ta.start[i], ta.end[i], tb.start[j], tb.end[j]
                count_a[sa:ea] += before[1][eb] - before[1][sb]
                count_b[sb:eb] += before[0][ea] - before[0][sa]
                if same and i == j:
                    count_a[sa:ea] -= a.weight[sa:ea]
                join(np.concatenate([np.full(eb - sb, sa), np.arange(sa, ea)]), np.concatenate([np.arange(sb, eb), np.full(ea - sa, sb)]))
            continue
        for c in range(0, len(x), AT_ONCE):
            p, q = spread(x[c : c + AT_ONCE], y[c : c + AT_ONCE], ta, tb)
            for d in range(0, len(p), AT_ONCE):
                i, j = p[d : d + AT_ONCE], q[d : d + AT_ONCE]
                if same:
                    i, j = i[i != j], j[i != j]
                found = (a.unit[i] * b.unit[j]).sum(1)
                ok = found >= cosine
                for k in np.flatnonzero(np.abs(found - cosine) <= NEAR):
                    ok[k] = cosine_exact(a.vector[i[k]], b.vector[j[k]]) >= cosine
                i, j = i[ok], j[ok]
                np.add.at(count_a, i, b.weight[j])
                np.add.at(count_b, j, a.weight[i])
                join(i, j)
    cid = np.concatenate([a.cid, b.cid])
    moved = np.flatnonzero(label != np.arange(len(label)))
    edges = {(min(u, v), max(u, v)) for u, v in zip(cid[moved].tolist(), cid[label[moved]].tolist(), strict=True) if u != v}
    return count_a, count_b, sorted(edges)


def classes_of(vectors: DataFrame, ident: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (_row, vec_id, label, v, null where the row takes no part), and the classes (cid, label, v, weight)."""
    v = F.transform(vector, lambda x: x.cast("double") + 0.0)
    own = F.when(usable(vector) & F.exists(vector, lambda x: x != 0) & F.col(label).isNotNull(), v)
    rows = saved(vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), own.alias("v")), "vectors")
    part = rows.filter("v is not null").groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("_row").alias("cid"))
    return rows, saved(part, "classes")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, ident: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links), kept (whether that is its own).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least ``cosine`` (above 0). Vectors that are null, zero or
    hold a null or a number that isn't finite link with nothing, nor do rows without a label; each is a component of its own. Vectors of unequal
    length count as filled with zeros. Rows that repeat an id are rows each; a null id stays null and names no component unless
    all its rows have none. An empty table gives no rows; other columns are ignored. The sample (``sample`` vectors drawn by a hash) only shapes the
    trees' tops; every row is compared, and the result does not depend on it.
    """
    spark = vectors.sparkSession
    rows, classes = classes_of(vectors, ident, vector, label)
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("label", "v").collect()
    tops, nodes = {}, []  # of each label in the sample: its tree, and the nodes of all
    for name in sorted({r.label for r in drawn}):
        tree = Tree(_unit(_filled([r.v for r in drawn if r.label == name], width)))
        leaves = np.flatnonzero(tree.first == tree.last)
        tops[name] = tree, leaves, len(nodes)
        nodes += tree.unit[tree.order[tree.centre[leaves]]].tolist()
    centres = {name: (np.array(nodes[base : base + len(leaves)]), base) for name, (_, leaves, base) in tops.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_filled(b.column("v").to_pylist(), width))
            names = b.column("label").to_numpy()
            cell, gap = np.full(len(names), -1, np.int64), np.zeros(len(names))
            for name in np.unique(names):
                if (held := centres.get(int(name))) is not None:
                    at = np.flatnonzero(names == name)
                    d = _gap(unit[at] @ held[0].T)
                    cell[at], gap[at] = held[1] + d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), b.column("v"), b.column("weight"), pa.array(cell), pa.array(gap)], names=["cid", "label", "v", "weight", "cell", "gap"])
        release()

    in_cells = classes.select("cid", "label", "v", "weight").mapInArrow(placed, "cid long, label long, v array<double>, weight long, cell long, gap double")
    in_cells = in_cells.repartitionByRange("label", "cell", "gap", "cid").sortWithinPartitions("label", "cell", "gap", "cid")
    blocks = saved(in_cells.mapInArrow(_cut(width, max(1, block_bytes // (8 * width))), _BLOCK), "blocks")

    # cells that the sample has named: at most ``sample`` rows
    facts = {r.cell: r for r in blocks.filter("cell >= 0").groupBy("cell").agg(F.max("high").alias("radius"), F.first("label").alias("label")).collect()}
    whole, test = _cell_pairs(tops, facts, cosine)
    schema = "cell_x long, cell_y long, apart double"
    tested = spark.createDataFrame(test, schema) if test else spark.createDataFrame([], schema)

    light = blocks.select("block", "label", "cell", "low", "high")
    x, y = (light.select(*(F.col(c).alias(f"{c}_{s}") for c in light.columns)) for s in "xy")
    most = F.lit(math.sqrt(max(0.0, 2 - 2 * cosine)) + MARGIN)
    named = x.join(sized(tested, 24), "cell_x").join(y, "cell_y").filter("label_x = label_y")
    alone = x.filter("cell_x = -1").join(y.filter("cell_y = -1"), F.col("label_x") == F.col("label_y")).filter("block_x <= block_y").select("block_x", "block_y")
    # rings about one centre, or about two that lie ``apart``
    gap = F.greatest(F.col("low_y") - F.col("high_x") - F.col("apart"), F.col("low_x") - F.col("high_y") - F.col("apart"), F.col("apart") - F.col("high_x") - F.col("high_y"))
    # a pair of cells comes once, and so do two blocks of one cell
    named = named.filter((gap <= most) & ((F.col("cell_x") < F.col("cell_y")) | (F.col("block_x") <= F.col("block_y"))))
    pairs = saved(named.select("block_x", "block_y").unionByName(alone), "pairs")
    many = pairs.count()
    left = blocks.select(F.col("block").alias("block_x"), F.struct(*_HELD).alias("x"))
    right = blocks.select(F.col("block").alias("block_y"), F.struct(*_HELD).alias("y"))
    wide = 2 * block_bytes
    met = pairs.repartition(1 + many // 32).join(sized(left, wide), "block_x").join(sized(right, wide), "block_y")

    def test_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                one = Block(row["x"])
                same = row["block_x"] == row["block_y"]
                other = one if same else Block(row["y"])
                count, back, edges = linked(one, other, same, cosine)
                ids, n = (one.cid, count) if same else (np.concatenate([one.cid, other.cid]), np.concatenate([count, back]))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at])], names=["a", "b", "n"])
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64())], names=["a", "b", "n"])
        release()

    found = saved(met.mapInArrow(test_pairs, "a long, b long, n long"), "found")
    counts, edges = found.filter("b is null").select("a", "n"), found.filter("b is not null").select("a", "b")
    if whole:
        more, joined = _whole_cells(spark, whole, in_cells_of(blocks))
        counts, edges = counts.unionByName(more), edges.unionByName(joined)
    counts = counts.groupBy("a").agg(F.sum("n").alias("n"))
    reach = components(edges).select("node", "component")
    per = classes.join(counts, F.col("cid") == F.col("a"), "left").join(reach, F.col("cid") == F.col("node"), "left")
    per = saved(per.select("label", "v", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "labelled")
    # rows that nothing links with need no look-up
    held = rows.filter("v is not null").join(sized(per.filter("n_links > 0"), 8 * width + 40), ["label", "v"], "left")
    held = saved(held.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"), "named")
    some = held.filter("component is not null")
    named = some.join(sized(some.groupBy("component").agg(F.min("vec_id").alias("first")), 16), "component").select("vec_id", "n_links", F.col("first").alias("component_id"))
    rest = held.filter("component is null").select("vec_id", "n_links").unionByName(rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    named = named.unionByName(rest.withColumn("component_id", F.col("vec_id")))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_HELD = ("cid", "weight", "vectors", "order", "centre", "start", "end", "radius", "first", "last")
_BLOCK = "block long, label long, cell long, low double, high double, cid array<long>, weight array<long>, vectors binary, order array<long>, centre array<long>, start array<long>, end array<long>, radius array<double>, first array<long>, last array<long>"


def in_cells_of(blocks: DataFrame) -> DataFrame:
    """cid, cell, weight of the classes of named cells."""
    both = blocks.filter("cell >= 0").select("cell", F.explode(F.arrays_zip("cid", "weight")).alias("c"))
    return both.select(F.col("c.cid").alias("cid"), "cell", F.col("c.weight").alias("weight"))


def _filled(rows: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _cut(width: int, rows: int):
    """Sorted classes to blocks of one cell and at most ``rows`` classes, each with its tree."""

    def made(number: int, held: list[dict]) -> pa.RecordBatch:
        vectors = _filled([r["v"] for r in held], width)
        gaps = [r["gap"] for r in held]
        row = {"block": TaskContext.get().partitionId() << 32 | number, "label": held[0]["label"], "cell": held[0]["cell"], "low": min(gaps), "high": max(gaps), "cid": [r["cid"] for r in held], "weight": [r["weight"] for r in held], "vectors": vectors.tobytes()}
        return pa.RecordBatch.from_pylist([row | Tree(_unit(vectors)).arrays()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []
        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == rows or (r["label"], r["cell"]) != (held[0]["label"], held[0]["cell"])):
                    yield made(number, held)
                    number, held = number + 1, []
                held.append(r)
        if held:
            yield made(number, held)
        release()

    return run


def _cell_pairs(tops: dict, facts: dict, cosine: float) -> tuple[list[tuple[int, int]], list[tuple[int, int, float]]]:
    """Of the cells of each label: pairs (smaller first) that link as a whole, and pairs that may hold links with the distance of their centres. Radii of
    the tops' nodes are widened to hold all members of the cells below them."""
    most = math.sqrt(max(0.0, 2 - 2 * cosine))
    whole, test = [], []
    for tree, leaves, base in tops.values():
        cell = dict(zip(leaves.tolist(), range(base, base + len(leaves)), strict=True))
        radius = np.full(len(tree.centre), -np.inf)
        points = tree.unit[tree.order[tree.centre]]
        for node in range(len(radius) - 1, -1, -1):  # children come after their parents
            if node in cell:
                radius[node] = facts[cell[node]].radius if cell[node] in facts else -np.inf
            else:
                kids = np.arange(tree.first[node], tree.last[node])
                radius[node] = (_gap(points[kids] @ points[node]) + radius[kids]).max()
        wide = Tree(tree.unit, parts={**{k: getattr(tree, k) for k in ("order", "centre", "start", "end", "first", "last")}, "radius": radius})
        for kind, x, y in walk(wide, wide, most):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                # nodes that link as a whole stand for their leaves
                for p in _leaves(tree, i):
                    for q in _leaves(tree, j):
                        u, v = cell[p], cell[q]
                        if u <= v and u in facts and v in facts:
                            if kind == "all":
                                whole.append((u, v))
                            else:
                                test.append((u, v, float(_gap(points[p] @ points[q])) if p != q else 0.0))
    return whole, test


def _leaves(tree: Tree, node: int) -> list[int]:
    if tree.first[node] == tree.last[node]:
        return [node]
    return [leaf for kid in range(tree.first[node], tree.last[node]) for leaf in _leaves(tree, kid)]


def _whole_cells(spark, whole: list[tuple[int, int]], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and edges of cells all of whose classes link: a row per class and other cell."""
    pairs = spark.createDataFrame([*whole, *((v, u) for u, v in whole if u != v)], "cell long, other long")
    sums = members.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("cid").alias("stands"))  # a row per cell of the sample
    met = pairs.join(F.broadcast(sums.withColumnRenamed("cell", "other")), "other")
    more = met.groupBy("cell").agg(F.sum(F.col("all")).alias("all"), F.max((F.col("cell") == F.col("other"))).alias("own"))
    counts = members.join(F.broadcast(more), "cell").select(F.col("cid").alias("a"), (F.col("all") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("n"))
    stands = met.groupBy("cell").agg(F.min("stands").alias("first"))
    # a cell's classes are joined with one class of another cell or of its own, and cells with cells
    links = members.join(F.broadcast(stands), "cell").filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    cells = met.join(F.broadcast(sums.select("cell", F.col("stands").alias("own"))), "cell").filter("own <> stands").select(F.col("own").alias("a"), F.col("stands").alias("b"))
    return counts, links.unionByName(cells)


ORACLE = """
with recursive v as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
                     where label is not null and embedding is not null
                       and len([x for x in embedding if x is null or not isfinite(x)]) = 0
                       and len([x for x in embedding if x <> 0]) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as least from r group by a),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) as kept
from embeddings e left join c on e.vec_id = c.a left join n on e.vec_id = n.a
"""

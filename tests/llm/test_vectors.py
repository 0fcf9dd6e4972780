"""Hard negatives, near-duplicate vectors and centroids against brute force: nulls, ties, repeated rows, large numbers, empty tables, clashing columns."""

import hashlib
import math

import numpy as np
import pytest
from polymix.llm import centroids, cover_tree, hard_negatives
from pyspark.sql import functions as F

#: Names that the operators use themselves.
SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, cell int, code binary, score double, rank int, cluster int, distance long"
EXTRA = (7, "v", 1, b"x", 0.5, 1, 2, 3)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def vectors(rng, n=300, width=20):
    """Labels of three, clusters of near copies around a few centres, copies, ties, unusable rows."""
    centre = rng.normal(size=(12, width))
    v = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.05, 0.3, 1.0], (n, 1))
    v[5:9] = v[4]
    v[20:24] = np.round(v[20:24])
    rows = [(i, x.tolist(), int(rng.integers(0, 3))) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * width, 1), (1003, [float("inf")] * width, 2), (1004, [0.0] * width, 1), (1005, v[4].tolist(), None), (1006, [], 1), (1050, (v[4] * 3).tolist(), 0), (1051, v[7].tolist(), 0)]
    return rows


def usable(x):
    return x is not None and all(y is not None and math.isfinite(y) for y in x)


def whole(rows, scale):
    return [(i, [math.floor(scale * y) for y in x], k) for i, x, k in rows if i is not None and usable(x)]


def dot(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))


def brute_negatives(rows, every=10):
    held = [(i, x, k) for i, x, k in whole(rows, 256) if k is not None]
    held = [(i, [max(-(1 << 63), min((1 << 63) - 1, y)) for y in x], k) for i, x, k in held]
    anchors = {}
    for i, x, k in held:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (k, x)), (k, x))
    out = []
    for a, (k, x) in anchors.items():
        scored = sorted((-dot(x, y), i, g) for i, y, g in held if i != a)
        for s, p, _ in [r for r in scored if r[2] == k][:5]:
            fits = [r for r in scored if r[2] != k and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, j + 1, i, -s, -t) for j, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rows = vectors(np.random.default_rng(seed))
    rows += [(30, rows[1][1], 2), (31, rows[1][1], 1)]  # ids that repeat
    got = hard_negatives.mine(frame(spark, rows), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_in_blocks(spark, monkeypatch):
    rows = vectors(np.random.default_rng(5), width=70)
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 40_000)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("id") % 10 == 0).collect())) == brute_negatives(rows)


def test_hard_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(0, 10)).tolist(), i % 2) for i in range(60)]
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("id") % 10 == 0).collect())) == brute_negatives(rows)


def test_intervals_hold_the_product():
    rng = np.random.default_rng(1)
    for width in (1, 3, 64, 100):
        rotation = hard_negatives.Rotation(width)
        v, q = rng.normal(size=(200, width)) * 100, rng.normal(size=(50, width)) * 100
        v[0], q[0] = 0, 0
        v[1] = q[1]
        low, high = hard_negatives.Queries(q, rotation).interval(slice(None), *rotation.codes(v))
        assert (low <= q @ v.T).all() and (q @ v.T <= high).all()
        if width == 64:
            assert (high - low).mean() < 1.5 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)).mean()


def brute_links(rows, least):
    """Per row: vec_id, n_links, component_id, kept."""
    part = [i for i, (_, x, k) in enumerate(rows) if k is not None and usable(x) and any(x)]
    width = max((len(x) for _, x, _ in rows if x is not None), default=0)
    fill = lambda x: np.array([*x, *[0.0] * (width - len(x))])
    near = {i: [j for j in part if j != i and rows[i][2] == rows[j][2] and cover_tree.cosine_exact(fill(rows[i][1]), fill(rows[j][1])) >= least] for i in part}
    out = []
    for i, (ident, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in near.get(queue.pop(), []):
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((ident, len(near.get(i, [])), first, ident == first))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "sample", "block_bytes"), [(0.98, 512, 1 << 19), (0.9, 7, 6000)])
def test_near_duplicates(spark, least, sample, block_bytes):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 150)
    tight = rng.normal(size=20)
    rows += [(2000 + i, (tight + rng.normal(size=20) * 0.02).tolist(), 5) for i in range(60)]  # a label of its own, all near each other
    rows += [(None, rows[4][1], rows[4][2]), (4, rows[9][1], 2), (-1, [1.0], 9), (-2, [2.0], 9), (-3, [-1.0], 9), (-4, [1e300], 9), (-5, [1e-300], 9)]
    got = cover_tree.near_duplicates(frame(spark, rows), least, sample=sample, block_bytes=block_bytes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows, least)


def test_cells_that_link_as_a_whole(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 16))
    rows = [(i, ((a if i % 3 else b) + rng.normal(size=16) * 1e-3).tolist(), 1) for i in range(300)]
    got = cover_tree.near_duplicates(frame(spark, rows), sample=50)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows, 0.98)


def test_cover_tree_nests():
    rng = np.random.default_rng(2)
    unit = cover_tree._unit(np.concatenate([rng.normal(size=(100, 5)), rng.normal(size=5) + rng.normal(size=(100, 5)) * 0.05]))
    tree = cover_tree.Tree(unit)
    for node in range(1, len(tree.centre)):
        held = unit[tree.order[tree.start[node] : tree.end[node]]]
        assert np.linalg.norm(held - held[0], axis=1).max() <= tree.radius[node] + 1e-7
    for node in range(len(tree.centre)):
        kids = range(tree.first[node], tree.last[node])
        if kids:
            assert [tree.start[node], *(tree.end[k] for k in kids)] == [*(tree.start[k] for k in kids), tree.end[node]]
            assert tree.order[tree.centre[kids[0]]] == tree.order[tree.centre[node]]
    x, y = np.nonzero(unit @ unit.T >= 0.98)
    found = {(tree.order[i], tree.order[j]) for kind, p, q in cover_tree.walk(tree, tree, math.sqrt(0.04)) for i, j in zip(*cover_tree.spread(p, q, tree, tree)) if kind == "all" or unit[tree.order[i]] @ unit[tree.order[j]] >= 0.98}
    assert found == set(zip(x.tolist(), y.tolist()))


def brute_clusters(rows, k=16, rounds=3, width=64, scale=64):
    held = [(i, [max(-(1 << 63), min((1 << 63) - 1, y)) for y in x]) for i, x, _ in whole(rows, scale) if len(x) == width]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in held)[:k]
    centre = [x for _, x in first]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(centre)), key=lambda c: (gap(x, centre[c]), c))
    for _ in range(rounds):
        at = [near(x) for _, x in held]
        for c in range(len(centre)):
            own = [x for (_, x), a in zip(held, at) if a == c]
            if own:
                centre[c] = [sum(col) // len(own) for col in zip(*own)]
    most = (1 << 63) - 1
    found = [(i, c, min(most, gap(x, centre[c]))) for i, x in held for c in [near(x)]]
    total = min(most, sum(d for *_, d in found))
    return sorted((i, c, d, min(most, sum(e for _, f, e in found if f == c)), total, hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize(("width", "size"), [(20, 1.0), (20, 1e3), (20, 1e12), (64, 1.0)])
def test_centroids(spark, width, size):
    rows = vectors(np.random.default_rng(8), width=width)
    rows = [(i, x and [y and y * size for y in x], k) for i, x, k in rows] + [(3, rows[8][1], 1), (3, rows[8][1], 1), (None, rows[8][1], 1)]
    got = centroids.clusters(frame(spark, rows), width=width)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows, width=width)


def test_few_and_no_vectors(spark):
    few = [(1, [1.0] * 64, 1), (2, [1.0] * 64, 1), (3, [0.5] * 64, 2), (4, [1.0] * 63, 1)]
    assert sorted(map(tuple, centroids.clusters(frame(spark, few)).collect())) == brute_clusters(few)
    for rows in ([], [(1, None, 1)], [(50, [1.0], 1)]):
        f = frame(spark, rows)
        assert centroids.clusters(f).count() == 0
        assert hard_negatives.mine(f, F.col("id") % 50 == 0).count() == 0
        assert sorted(map(tuple, cover_tree.near_duplicates(f).collect())) == brute_links(rows, 0.98)


def test_long_blocks(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 10)
    rows = [(i, [float(i % 7), float(i % 11)], 0) for i in range(95)]
    got = centroids.clusters(frame(spark, rows).coalesce(1), k=4, width=2)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows, k=4, width=2)

"""Packed rows in tiles, and files of packed rows that are larger than a task may hold."""

import numpy as np
import pytest

CELLS = [(m, i, d) for m in range(12) for i, d in ((7 * m, 1), (128 * m + 127, 2), ((1 << 29) + m, None), ((1 << 30) - 1 - m, 1))]


def cells(spark, rows=CELLS):
    return spark.createDataFrame(rows, "marker_id long, ind int, d int").repartition(3)


def test_tiles_hold_the_parts_with_a_cell():
    from polymix.operators import packed

    rng = np.random.default_rng(1)
    n = 1001
    d = rng.choice([0, 0, 0, 1, 2, -1], (9, n))
    d[:, 200:700], d[4, :], d[4, 0] = 0, 0, 2
    marker, ind = np.nonzero(d)
    code = np.array([packed.BITS[None if x < 0 else x] for x in d[marker, ind].tolist()])
    t = packed.Tiles(marker + 50, ind, code)
    assert t.key.tolist() == list(range(50, 59)) and len(t.rows) < 9 * 5 and (t.owner == 4).sum() == 1
    assert t.counts().tolist() == np.stack([(d == k).sum(1) for k in (1, 2, -1)], 1).tolist()
    v = rng.normal(size=1004)
    dose, miss = t.sums(v, "dose", "miss")
    assert np.allclose(dose, np.maximum(d, 0) @ v[:n]) and np.allclose(miss, (d < 0) @ v[:n])
    a, b, out = rng.normal(size=9), rng.normal(size=9), np.zeros(n)
    t.change(a, b, out)
    assert np.allclose(out, a @ np.maximum(d, 0) + b @ (d < 0))
    assert all(np.array_equal(x, y) for x, y in zip(t.cells(), (marker, ind, code), strict=True))


def test_packing_takes_no_more_than_the_cells(spark):
    """A row over these individuals would take 256 MB."""
    from polymix.operators import packed

    got = {(r.marker_id, i, d) for r in packed.tile_lists(cells(spark)).collect() for i, d in zip(r.ind, r.d, strict=True)}
    assert got == set(CELLS)


@pytest.mark.parametrize("at_once", ["2", "10000"])
def test_markers_over_several_batches_stay_whole(spark, at_once):
    from polymix.operators import chain, packed

    n = 300
    d = np.random.default_rng(2).choice([0, 0, 1, 2, -1], (n, 7))
    rows = [(int(j), int(i), None if d[i, j] < 0 else int(d[i, j])) for i, j in zip(*np.nonzero(d), strict=True)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, at_once)
    try:
        v = np.random.default_rng(3).normal(size=n)
        dots = {r.marker_id: r.num for r in packed.tile_products(cells(spark, rows), v).collect()}
        moved = spark.createDataFrame([(j, 0.1 * j) for j in range(1, 9)], "marker_id int, delta_beta double")
        change = {r.ind: r.delta_eps for r in chain.packed_change(cells(spark, rows), moved, n).collect()}
    finally:
        spark.conf.set(name, was)
    known = d >= 0
    mave = np.where(known, d, 0).sum(0) / known.sum(0)
    x = np.where(known, d - mave, 0)
    x *= np.sqrt((n - 1) / (x**2).sum(0))
    assert len(dots) == 7 and all(np.isclose(dots[j], x[:, j] @ v) for j in range(7))
    assert len(change) == n and np.allclose([change[i] for i in range(n)], x @ (0.1 * np.arange(7)))


@pytest.mark.parametrize("name", ["groups", "weibull", "multi_trait"])
def test_the_driver_gets_no_rows_of_individuals_or_markers(spark, monkeypatch, name):
    """Vectors come as Arrow batches, a state goes out by broadcast: an object per row would be held on the driver."""
    from polymix.plans import registry
    from pyspark.sql import DataFrame

    frames, most = [], 0
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: frames.append(self))
    collect = type(spark.range(1)).collect

    def counted(self):
        nonlocal most
        rows = collect(self)
        most = max(most, len(rows))
        return rows

    monkeypatch.setattr(type(spark.range(1)), "collect", counted)
    got = registry.QUERIES[f"{name}_run_short"](spark, "/root/testdata/sf0.001")
    assert not frames and most < 50 and isinstance(got, DataFrame)


@pytest.mark.parametrize("model", ["gaussian", "weibull"])
@pytest.mark.parametrize("masked", [False, True])
def test_moves_cost_their_cells(monkeypatch, model, masked):
    """A sweep in which every marker moves: the model's whole vector is taken every few moves, and draws see the same sums as if it were always."""
    import pyarrow as pa
    from polymix.operators import chain, weibull

    rng = np.random.default_rng(5)
    n, m = 200, 30
    d = rng.choice([0, 0, 0, 1, 2, -1], (n, m))
    known = d >= 0
    mave = np.where(known, d, 0).sum(0) / known.sum(0)
    x = np.where(known, d - mave, 0)
    mstd = np.sqrt((n - 1) / (x**2).sum(0))
    x *= mstd
    mask = rng.random(n) < 0.7 if masked else np.ones(n, bool)
    lists = [pa.array([np.flatnonzero(d[:, j] == k).astype(np.int32) for j in range(m)], pa.list_(pa.int32())) for k in (1, 2, -1)]
    lists = [pa.array([None if j % 5 == 0 else v for j, v in enumerate(a.to_pylist())], pa.list_(pa.int32())) for a in lists]
    codes = np.array([[chain.packed.BITS[None if v < 0 else v] for v in col] for col in d.T.tolist()], np.uint8)
    rows = pa.array([chain.packed.packed_codes(codes[j : j + 1])[0].tobytes() if j % 5 == 0 else None for j in range(m)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(mave), pa.array(mstd), *lists, rows], names=["marker_id", "mave", "mstd", "one", "two", "miss", "packed"])
    c = chain.Columns(batch, n)
    c.mask = mask if masked else None
    start = rng.normal(size=n) * mask
    delta = rng.normal(0, 0.1, m)
    kind = weibull.Weibull if model == "weibull" else chain.Gaussian
    whole, seen = [], []

    class Fixed:
        def vector(self, eps, h):
            whole.append(np.size(eps) == n)
            return np.exp(h.alpha * eps) * mask if model == "weibull" and np.size(eps) == n else np.exp(h.alpha * eps) if model == "weibull" else eps

        shifted = kind.shifted

        def draw(self, c, e, total, old, h, it):
            seen.append((int(c.key[0]), total, c.sums("one", e)[0], c.sums("miss", e)[0]))
            return delta[c.key], np.ones(len(c.key), int), np.zeros(len(c.key))

    monkeypatch.setattr(chain, "MOVES", 7)
    eps, h = start.copy(), chain.Hyper(0, 0.0, (1.0,), 1.0, ((0.5, 0.5),), alpha=0.8)
    chain.swept(c, eps, Fixed(), h, 1, np.zeros(m))
    assert np.allclose(eps, start - (x @ delta) * mask)
    assert len(seen) >= m
    for j, total, one, miss in seen:
        now = (start - x[:, :j] @ delta[:j]) * mask
        v = np.exp(0.8 * now) * mask if model == "weibull" else now
        assert np.isclose(total, v.sum()) and np.isclose(one, v[(d[:, j] == 1) & mask].sum()) and np.isclose(miss, v[(d[:, j] < 0) & mask].sum())
    if model == "gaussian":
        assert sum(whole) <= 2 + m // 7 + m


def test_files_of_packed_rows_are_written_from_tiles(spark, tmp_path):
    """Rows of 4 MB: no row goes through a shuffle, and unpacking takes a few of them at a time."""
    from polymix.sources import bed, sparse

    n = (16 << 20) - 3
    rows = [(m, i, d) for m in (1, 2, 5, 8) for i, d in ((m, 1), (n // 2 + m, 2), (n - 1, None))]
    bed.write_bed(cells(spark, rows), f"file://{tmp_path}/g.bed", n, 9)
    assert (tmp_path / "g.bed").stat().st_size == 3 + 9 * (4 << 20) and bed.markers_in(f"{tmp_path}/g.bed", n) == 9
    sparse.bed_to_sparse(spark, f"{tmp_path}/g.bed", f"{tmp_path}/s", n, block=3)
    spark.dataSource.register(sparse.SparseSource)
    back = sparse.cells(spark.read.format("sparsegeno").load(f"{tmp_path}/s"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)

"""Chains over blocks of markers, their files, the sparse set, options and readers."""

import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def simulated(spark, n=300, m=120, causal=8, seed=3, missing=0.01):
    """Dosages (ind x marker, -1 missing), cells, standardised columns, effects."""
    rng = np.random.default_rng(seed)
    d = rng.binomial(2, rng.uniform(0.1, 0.5, m), (n, m))
    d[rng.random((n, m)) < missing] = -1
    known = np.where(d < 0, 0, d)
    mave = known.sum(0) / (d >= 0).sum(0)
    mstd = np.sqrt((n - 1) / (np.where(d < 0, 0, d - mave) ** 2).sum(0))
    x = np.where(d < 0, 0, (d - mave) * mstd)
    beta = np.zeros(m)
    beta[rng.choice(m, causal, replace=False)] = rng.normal(0, 0.3, causal)
    i, j = np.nonzero(d)
    cells = spark.createDataFrame([(int(a) * 3, int(b), None if d[a, b] < 0 else int(d[a, b])) for a, b in zip(i, j)], "ind_id long, marker_id long, d int")
    return d, cells, x, beta, rng


def phenotype(spark, y):
    return spark.createDataFrame([(3 * i, float(v)) for i, v in enumerate(y)], "ind_id long, y double")


def dense(st, m):
    out = np.zeros(m)
    out[st.key] = st.beta
    return out


def test_gaussian_chain_recovers_and_keeps_the_residual(spark, tmp_path):
    from polymix.operators import chain

    d, cells, x, beta, rng = simulated(spark)
    z = rng.normal(size=(300, 1))
    y = x @ beta + 0.8 * z[:, 0] + rng.normal(0, 0.6, 300)
    y = (y - y.mean()) / y.std(ddof=1)
    groups = spark.createDataFrame([(j, j % 2) for j in range(120)], "marker_id long, grp int")
    cov = spark.createDataFrame([(3 * i, [float(v[0])]) for i, v in enumerate(z)], "ind_id long, x array<double>")
    s = chain.Settings(windows=3, thin=2)
    home = f"file://{tmp_path}/c"
    st, trace, store = chain.run(spark, cells, phenotype(spark, y), 12, s, home, groups, cov)
    left = st.eps + st.hyper.mu + x @ dense(st, 120) + st.hyper.gamma[0] * z[:, 0] - y
    assert np.abs(left).max() < 1e-8
    assert np.corrcoef(dense(st, 120), beta)[0, 1] > 0.7 and st.hyper.gamma[0] > 0.2
    assert len(trace) == 12 and all(len(h.sigma_g) == 2 for h in trace)
    got = chain.samples(store, s.thin)
    assert sorted(r.iter for r in got.select("iter").distinct().collect()) == [2, 4, 6, 8, 10, 12]
    last = {r.marker_id: r for r in got.filter("iter = 12").collect()}
    assert len(last) == 120 and all(np.isclose(last[j].beta, b) for j, b in enumerate(dense(st, 120)))


def test_chain_goes_on_in_another_process(spark, tmp_path):
    """A chain of five sweeps equals one that is ended after three and taken up by a new process."""
    from polymix.operators import chain
    from polymix.sources.adapter import Domain

    d, s = Domain(spark, SF), chain.Settings(windows=2, seed=5)
    whole, _, _ = chain.run(spark, d.genotype(), d.phenotype(), 5, s, f"file://{tmp_path}/a")
    code = f"""
import sys; sys.path.insert(0, {sys.path[0]!r}); sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
from polymix.operators import chain
from polymix.sources.adapter import Domain
d = Domain(spark, {SF!r})
chain.run(spark, d.genotype(), d.phenotype(), 3, chain.Settings(windows=2, seed=5), "file://{tmp_path}/b")
"""
    import os

    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, env=env, capture_output=True)
    again, trace, _ = chain.run(spark, d.genotype(), d.phenotype(), 5, s, f"file://{tmp_path}/b")
    assert [h.iteration for h in trace] == [4, 5]
    assert np.array_equal(again.key, whole.key) and np.allclose(again.beta, whole.beta) and np.allclose(again.eps, whole.eps)
    assert np.isclose(again.hyper.sigma_e, whole.hyper.sigma_e) and np.allclose(again.hyper.pi, whole.hyper.pi)


def test_group_without_effects_is_switched_off_and_the_chain_goes_on(spark, tmp_path):
    from polymix.operators import chain

    d, cells, x, beta, rng = simulated(spark, n=120, m=20)
    y = rng.normal(size=120)
    # the second group's only marker has hardly any chance to be taken
    groups = spark.createDataFrame([(j, int(j == 19)) for j in range(20)], "marker_id long, grp int")
    s = chain.Settings(windows=1, mixture=((0.01, 0.1), (1e-9, 1e-8)), dirichlet=((1.0, 1.0, 1.0), (1e6, 1.0, 1.0)))
    st, trace, _ = chain.run(spark, cells, phenotype(spark, y), 6, s, f"file://{tmp_path}/c", groups)
    assert len(trace) == 6
    off = [h.disabled[1] for h in trace]
    assert off == sorted(off)
    assert all(h.sigma_g[1] == 0 for h, o in zip(trace, off) if o)


def test_survival_chain(spark, tmp_path):
    from polymix.operators import chain, weibull

    d, cells, x, beta, rng = simulated(spark, n=400, m=60, causal=4, seed=9, missing=0.0)
    y = 4.1 + x @ (0.5 * beta) + (np.log(rng.exponential(size=400)) + weibull.EULER) / 8
    fail = (rng.random(400) < 0.9).astype(int)
    f = spark.createDataFrame([(3 * i, int(v)) for i, v in enumerate(fail)], "ind_id long, fail int")
    st, trace, _ = chain.run(spark, cells, phenotype(spark, y), 15, chain.Settings(windows=3, mixture=((0.01, 0.1),)), f"file://{tmp_path}/w", fail=f, model=weibull.Weibull)
    assert np.abs(st.eps + st.hyper.mu + x @ dense(st, 60) - y).max() < 1e-8
    assert abs(st.hyper.mu - 4.1) < 0.1 and 6 < st.hyper.alpha < 10.5
    assert np.corrcoef(dense(st, 60), beta)[0, 1] > 0.8


def test_quadrature_against_a_fine_sum():
    from polymix.operators import weibull

    rng = np.random.default_rng(2)
    d = rng.binomial(2, 0.3, 500)
    e, fail, a, var = rng.normal(0, 0.1, 500), rng.random(500) < 0.9, 8.0, 0.01
    m, s = d.mean(), d.std(ddof=1)
    v, x = np.exp(a * e - weibull.EULER), (d - d.mean()) / d.std(ddof=1)
    sums = tuple(np.array([v[d == k].sum()]) for k in range(3))
    t = np.linspace(-9, 9, 40001)
    b = a * t * np.sqrt(2 * var)
    logs = -b * (x @ fail) + v.sum() - np.array([(v * np.exp(-c * x)).sum() for c in b]) - t * t
    want = np.log(np.trapezoid(np.exp(logs), t))
    for nodes, close in ((5, 0.05), (9, 1e-3), (25, 1e-6)):
        assert abs(weibull.log_marginals(sums, np.array([m]), np.array([s]), np.array([x @ fail]), a, np.array([var]), nodes)[0] - want) < close


@pytest.mark.parametrize("shift", [-3.0, 0.0, 40.0])
def test_rejection_sampler_has_the_right_moments(shift):
    from polymix.functions import sampling

    rng = np.random.default_rng(1)
    gumbel = lambda x: (3 * (x - shift) - np.exp(3 * (x - shift)), 3 - 3 * np.exp(3 * (x - shift)))
    draws = [sampling.adaptive_rejection(rng, gumbel, shift - 9, shift + 9, (shift - 1, shift, shift + 1)) for _ in range(3000)]
    assert abs(np.mean(draws) - shift + 0.57721566 / 3) < 0.03 and abs(np.std(draws) - np.pi / np.sqrt(6) / 3) < 0.03


def test_binary_samples_and_text_round_trip(spark, tmp_path):
    from polymix.sources import chain_files

    rows = [(it, m, it * 10 + m + 0.5, m % 3) for it in (2, 4, 9) for m in (0, 3, 6)]
    df = spark.createDataFrame(rows, "iter long, marker_id long, beta double, component int")
    chain_files.write_records(df, f"file://{tmp_path}/x.bet", 7, "beta", "double")
    chain_files.write_records(df, f"file://{tmp_path}/x.cpn", 7, "component", "int")
    raw = (tmp_path / "x.bet").read_bytes()
    assert struct.unpack("<I", raw[:4]) == (7,) and len(raw) == 4 + 3 * (4 + 56) and struct.unpack("<I", raw[64:68]) == (4,)
    spark.dataSource.register(chain_files.ChainSource)
    for name, kind, value in (("x.bet", "double", 2), ("x.cpn", "int", 3)):
        back = spark.read.format("chain").option("kind", kind).load(f"{tmp_path}/{name}")
        want = {(r[0], r[1]): r[value] for r in rows}
        assert {(r.iter, r.marker_id): r["value"] for r in back.collect()} == {(it, m): want.get((it, m), 0) for it in (2, 4, 9) for m in range(7)}
    (tmp_path / "cut").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="cut"):
        spark.read.format("chain").load(f"{tmp_path}/cut").count()
    h = spark.createDataFrame([(3, [0.25, 0.5], 0.75, 0.5, 12, [[0.5, 0.25, 0.25], [0.125, 0.5, 0.375]])], "iter int, sigma_g array<double>, sigma_e double, h2 double, m0 int, pi array<array<double>>")
    lines = chain_files.hyper_lines(h)
    assert lines.first()["value"].replace(" ", "").startswith("3,2,0.25000")
    assert tuple(chain_files.parse_hyper(lines).first()) == (3, 2, [0.25, 0.5], 0.75, 0.5, 12, 3, [[0.5, 0.25, 0.25], [0.125, 0.5, 0.375]])


def test_sparse_set_and_mixed_representation(spark, tmp_path):
    from polymix.operators import chain, stats
    from polymix.sources import sparse

    n, m = 11, 6
    rng = np.random.default_rng(4)
    d = rng.choice([0, 0, 0, 1, 2, -1], (n, m))
    d[:, 5], d[:3, 5] = 0, 1
    cells = [(int(j), int(i), None if d[i, j] < 0 else int(d[i, j])) for i, j in zip(*np.nonzero(d))]
    lists = chain.marker_lists(spark.createDataFrame(cells, "marker_id long, ind int, d int"), n)
    assert lists.count() == m
    sparse.write_sparse(lists, f"file://{tmp_path}/g", n, m)
    assert (tmp_path / "g.dim").read_text() == f"{n} {m}\n"
    starts = np.frombuffer((tmp_path / "g.ss1").read_bytes(), "<u8")
    sizes = np.frombuffer((tmp_path / "g.sl1").read_bytes(), "<u8")
    assert (starts == np.cumsum(sizes) - sizes).all() and sizes.tolist() == (d == 1).sum(0).tolist()
    spark.dataSource.register(sparse.SparseSource)
    back = spark.read.format("sparsegeno").option("block", 4).load(f"{tmp_path}/g")
    assert sorted(map(tuple, sparse.cells(back).collect()), key=str) == sorted(cells, key=str)
    mixed = chain.represented(back, n, 0.4)
    dense_ones = {r.marker_id for r in mixed.filter("packed is not null").collect()}
    assert dense_ones == {j for j in range(m) if (d[:, j] != 0).mean() > 0.4}
    unpacked = stats.unpack(mixed.filter("packed is not null").select("marker_id", "packed"), n)
    assert sorted(map(tuple, unpacked.collect()), key=str) == sorted((c for c in cells if c[0] in dense_ones), key=str)
    with pytest.raises(Exception, match="each marker once"):
        sparse.write_sparse(lists, f"file://{tmp_path}/h", n, m - 1)


def test_bed_header_and_size_are_checked(spark, tmp_path):
    from polymix.sources.bed import BedSource

    spark.dataSource.register(BedSource)
    (tmp_path / "a.bed").write_bytes(b"\x6c\x1b\x00" + b"\xff" * 6)
    (tmp_path / "b.bed").write_bytes(b"\x6c\x1b\x01" + b"\xff" * 7)
    for name in ("a", "b"):
        with pytest.raises(Exception, match="not a marker-major|size"):
            spark.read.format("bed").option("individuals", 11).load(f"{tmp_path}/{name}.bed").count()


def test_options(spark, tmp_path):
    from polymix import config

    (tmp_path / "o").write_text("# a run\n--chain-length 50\nthin 3 // every third\nsave\t10\nout file:///x y\n\n")
    c = config.read_config(spark, f"file://{tmp_path}/o")
    assert (c.chain_length, c.thin, c.save, c.out, c.seed) == (50, 3, 9, "file:///x y", 1)
    assert config.RunConfig(thin=7, save=2).normalised().save == 7
    (tmp_path / "o").write_text("colour red\n")
    with pytest.raises(ValueError):
        config.read_config(spark, f"file://{tmp_path}/o")


def test_readers(spark, tmp_path):
    from polymix.sources import text

    put = lambda name, s: ((tmp_path / name).write_text(s), f"file://{tmp_path}/{name}")[1]
    assert [tuple(r) for r in text.read_bim(spark, put("bim", "1\trs1\t0\t100\tA\tG\n2 rs2 0.5 200 AT G\n")).orderBy("marker_id").collect()] == [(0, 1, "rs1", 0.0, 100, "A", "G"), (1, 2, "rs2", 0.5, 200, "AT", "G")]
    phen = text.read_phen(spark, put("phen", "f a 1.5 \nf b NA\nf c -2\nf d 3\n"))
    cov = text.read_cov(spark, put("cov", "f a 1 2\nf b 1 2\nf c NA 2\nf d 4 5\n"))
    fail = text.read_fail(spark, put("fail", "1\n0\n1\n-9\n"))
    assert [r.y for r in phen.orderBy("ind_id").collect()] == [1.5, None, -2.0, 3.0]
    assert [tuple(r) for r in text.complete(phen, cov).select("ind_id", "y", "x", "new_id").orderBy("ind_id").collect()] == [(0, 1.5, [1.0, 2.0], 0), (3, 3.0, [4.0, 5.0], 1)]
    assert [r.ind_id for r in text.complete(phen, cov, fail).collect()] == [0]
    fam = text.read_fam(spark, put("fam", "f d 0 0 1 -9\nf a 0 0 2 -9\n"))
    assert sorted((r.ind_id, r.y) for r in text.by_id(phen, fam).collect()) == [(0, 3.0), (1, 1.5)]
    assert [r.grp for r in text.read_groups(spark, put("grp", "0 1\n1\n0\n")).orderBy("marker_id").collect()] == [0, 1, 1, 0]
    traits = text.read_phenotypes(spark, [f"file://{tmp_path}/phen", put("phen2", "f a NA\nf b 7\nf c 8\nf d NA\n")])
    assert [r.y for r in traits.orderBy("trait", "ind_id").collect()] == [1.5, None, -2.0, 3.0, None, 7.0, 8.0, None]
    assert text.read_priors(spark, put("pri", "1,2;3,4\n")) == ((1.0, 2.0), (3.0, 4.0))
    assert text.read_dirichlet(spark, put("dir", "1,2,3;4,5,6\n")) == ((1.0, 2.0, 3.0), (4.0, 5.0, 6.0))
    for bad in ("1 5\n5 9\n", "1 5\n7 9\n", "5 1\n", "2 9\n", "1 8\n", "1  9\n"):
        with pytest.raises(ValueError):
            text.read_blocks(spark, put("blk", bad), 9)
    assert text.read_blocks(spark, put("blk", "1 4\n5 9\n"), 9).count() == 2


def test_running_summary_of_a_growing_chain(spark, tmp_path):
    from polymix.streaming.monitor import running_summary

    put = lambda rows: spark.createDataFrame(rows, "iter long, marker_id long, component int, beta double").write.mode("append").parquet(f"{tmp_path}/s")
    put([(1, 7, 1, 5.0), (2, 7, 1, 1.0), (2, 8, 0, 0.0)])
    q = lambda: running_summary(spark, f"{tmp_path}/s", 2).writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", f"{tmp_path}/q").trigger(availableNow=True).start().awaitTermination()
    q()
    assert {tuple(r) for r in spark.table("summary").collect()} == {(7, 1, 1.0, 1.0), (8, 1, 0.0, 0.0)}
    put([(3, 7, 0, 0.0)])
    q()
    assert {tuple(r) for r in spark.table("summary").collect()} == {(7, 2, 0.5, 0.5), (8, 1, 0.0, 0.0)}


def test_node_of():
    from pyspark.sql import SparkSession

    from polymix.operators import stats

    spark = SparkSession.getActiveSession()
    for tasks, per in ((7, 3), (12, 4), (5, 2), (1, 4)):
        got = [r.n for r in spark.range(tasks).select(stats.node_of(F.col("id"), tasks, per).alias("n")).collect()]
        sizes = [got.count(k) for k in range(max(got) + 1)]
        assert sum(sizes) == tasks and set(sizes) <= {per, per - 1, tasks} and sizes == sorted(sizes, reverse=True)

"""Packed kernels, ordered sweeps, conversion, history of a chain, running sums and a run from files to files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chain import dense, phenotype, simulated


def bed_bytes(d, junk=0):
    """Packed rows of dosages (individual x marker, -1 missing); ``junk`` fills the places after the last individual."""
    code = {0: 3, 1: 2, 2: 0, -1: 1}
    out = []
    for col in d.T:
        codes = [code[int(x)] for x in col] + [junk] * (-len(col) % 4)
        out.append(bytes(a | b << 2 | c << 4 | e << 6 for a, b, c, e in zip(*[iter(codes)] * 4)))
    return out


@pytest.mark.parametrize("n", [1, 4, 7, 300])
def test_packed_kernels(n):
    from polymix.operators import packed
    import pyarrow as pa

    rng = np.random.default_rng(n)
    d = rng.choice([0, 0, 1, 2, -1], (n, 33))
    d[:, 3], d[:, 4] = 0, -1
    rows = packed.rows_of(pa.array(bed_bytes(d), pa.binary()), n)
    assert packed.counts(rows).tolist() == np.stack([(d == k).sum(0) for k in (1, 2, -1)], 1).tolist()
    v = rng.normal(size=n)
    for name, x in (("one", d == 1), ("two", d == 2), ("miss", d < 0), ("dose", np.maximum(d, 0))):
        assert np.allclose(packed.sums(rows, v, name), v @ x)
    a, b, out = rng.normal(size=33), rng.normal(size=33), v.copy()
    packed.change(rows, a, b, out)
    assert np.allclose(out, v + np.maximum(d, 0) @ a + (d < 0) @ b)
    keep = np.flatnonzero(rng.random(n) < 0.6)
    assert packed.counts(packed.chosen(rows, keep)).tolist() == np.stack([(d[keep] == k).sum(0) for k in (1, 2, -1)], 1).tolist()
    found = packed.lists_of(rows, n)
    assert all(np.array_equal(found["one"][j], np.flatnonzero(d[:, j] == 1)) and np.array_equal(found["miss"][j], np.flatnonzero(d[:, j] < 0)) for j in range(33))


def test_prefix_by_levels(spark):
    from polymix.operators import stats

    rng = np.random.default_rng(1)
    for keys, widths in ((range(-7, 20), (5,)), (rng.choice(1 << 40, 100, replace=False).tolist(), (65536,)), ([-(1 << 63), -(1 << 63) + 1, -5, 0, 7, (1 << 63) - 1], (65536,)), ([3], (3,)), ([], (3,))):
        rows = [(int(k), int(v)) for k, v in zip(keys, rng.integers(0, 9, len(list(keys))))]
        df = spark.createDataFrame(rows, "k long, v long")
        for width in widths:
            got = stats.prefix(df, "k", F.col("v"), "before", width)
            want, total = [], 0
            for k, v in sorted(rows):
                want.append((k, v, total))
                total += v
            assert sorted((r.k, r.v, r.before) for r in got.collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(k" not in plan  # no window without a partition


@pytest.mark.parametrize(("blocks", "sync", "threshold"), [(1, None, 1.0), (3, 5, 0.0), (3, 10, 0.35)])
def test_correlated_markers_do_not_diverge(spark, tmp_path, blocks, sync, threshold):
    """Copies of a few columns, those of one in a block: a sweep that let all of them see one residual would move it by the sum of their effects."""
    from polymix.operators import chain

    rng = np.random.default_rng(2)
    n, m = 200, 60
    d = rng.binomial(2, 0.3, (n, 3))[:, np.arange(m) // 20]
    x = (d - d.mean(0)) / d.std(0, ddof=1)
    y = x[:, 0] + rng.normal(0, 0.5, n)
    y = (y - y.mean()) / y.std(ddof=1)
    i, j = np.nonzero(d)
    cells = spark.createDataFrame([(int(a) * 3, int(b), int(d[a, b])) for a, b in zip(i, j)], "ind_id long, marker_id long, d int")
    s = chain.Settings(windows=1, blocks=blocks, sync=sync, threshold=threshold, mixture=((0.1, 1.0),))
    st, trace, store = chain.run(spark, cells, phenotype(spark, y), 4, s, f"file://{tmp_path}/c")
    assert np.abs(st.eps + st.hyper.mu + x @ dense(st, m) - y).max() < 1e-8
    assert st.eps.std() < 0.7 and all(h.sigma_e < 1 for h in trace)
    table = store.read("lists")
    assert table.select("block").distinct().count() == blocks
    assert table.filter("packed is not null").count() == (0 if threshold == 1 else m)


def test_a_sweep_reads_the_genotype_once(spark, tmp_path):
    from polymix.operators import chain

    d, cells, x, beta, rng = simulated(spark, n=60, m=50)
    y = rng.normal(size=60)
    s = chain.Settings(blocks=3, sync=4)
    _, _, store = chain.run(spark, cells, phenotype(spark, y), 1, s, f"file://{tmp_path}/c")
    table = store.read("lists")
    windows = table.first()["windows"]
    read = [sorted(table.filter(F.col("window") == w).inputFiles()) for w in range(windows)]
    plan = table.filter(F.col("window") == 1)._jdf.queryExecution().executedPlan().toString()
    assert windows == 5 and "PartitionFilters" in plan and "window" in plan.split("PartitionFilters")[1][:80]
    assert sum(table.filter(F.col("window") == w).count() for w in range(windows)) == 50
    per = table.select("window", "block", F.input_file_name().alias("file")).groupBy("window", "block").agg(F.countDistinct("file").alias("files")).collect()
    assert {r.files for r in per} == {1} and len(per) <= 15 and len(read) == windows


def test_lists_and_packed_rows_draw_the_same(spark, tmp_path):
    from polymix.operators import chain

    d, cells, x, beta, rng = simulated(spark, n=120, m=40)
    y = rng.normal(size=120) + x[:, 3]
    states = []
    for threshold in (0.0, 0.3, 1.0):
        st, _, _ = chain.run(spark, cells, phenotype(spark, y), 3, chain.Settings(blocks=2, windows=2, threshold=threshold), f"file://{tmp_path}/{threshold}")
        states.append(st)
    for st in states[1:]:
        assert np.array_equal(st.key, states[0].key) and np.allclose(st.beta, states[0].beta) and np.allclose(st.eps, states[0].eps)


def test_recovery_in_two_groups(spark, tmp_path):
    """500 individuals, 1,000 markers, 20 causal ones in two groups, half of the variance."""
    from polymix.operators import chain

    d, cells, x, _, rng = simulated(spark, n=500, m=1000, causal=0, seed=11, missing=0.0)
    beta = np.zeros(1000)
    at = rng.choice(1000, 20, replace=False)
    beta[at] = rng.normal(0, np.sqrt(0.5 / 20), 20)
    g = x @ beta
    y = g + rng.normal(0, g.std(), 500)
    scale = y.std(ddof=1)
    y, beta = (y - y.mean()) / scale, beta / scale
    groups = spark.createDataFrame([(j, j % 2) for j in range(1000)], "marker_id long, grp int")
    s = chain.Settings(blocks=4, sync=125, mixture=((0.01, 0.1), (0.01, 0.1)))
    st, trace, store = chain.run(spark, cells, phenotype(spark, y), 14, s, f"file://{tmp_path}/c", groups)
    mean = np.zeros(1000)
    for r in chain.samples(store).filter("iter > 5").groupBy("marker_id").agg(F.avg("beta").alias("b")).collect():
        mean[r.marker_id] = r.b
    assert np.corrcoef(x @ mean, x @ beta)[0, 1] > 0.8
    assert 0.25 < np.mean([h.h2 for h in trace[5:]]) < 0.75


def edge_bed(n=8):
    rng = np.random.default_rng(5)
    d = rng.choice([0, 0, 1, 2, -1], (n, 9))
    d[:, 0], d[:, 4], d[:, 8], d[:, 6] = 0, -1, 2, 1  # empty, all missing, and two that don't vary
    return d


@pytest.mark.parametrize(("n", "block"), [(8, 4), (1, 2), (7, 4096)])
def test_bed_to_sparse_keeps_every_marker(spark, tmp_path, n, block):
    from polymix.sources import bed, sparse

    d = edge_bed(n)
    (tmp_path / "g.bed").write_bytes(bed.HEADER + b"".join(bed_bytes(d)))
    sparse.bed_to_sparse(spark, f"{tmp_path}/g.bed", f"file://{tmp_path}/s", n, block=block)
    check_set(tmp_path, "s", d)
    # from lists that lack markers without cells, and from the set itself
    spark.dataSource.register(sparse.SparseSource)
    lists = spark.read.format("sparsegeno").option("block", 2).load(f"{tmp_path}/s")
    sparse.write_sparse(lists.filter("size(one) + size(two) + size(miss) > 0"), f"file://{tmp_path}/t", n, d.shape[1])
    check_set(tmp_path, "t", d)
    keep = np.flatnonzero(np.arange(n) % 3 != 1)
    sparse.bed_to_sparse(spark, f"{tmp_path}/g.bed", f"file://{tmp_path}/u", n, keep, block)
    check_set(tmp_path, "u", d[keep])


def check_set(at, name, d):
    from polymix.sources import sparse

    assert (at / f"{name}.dim").read_text() == f"{d.shape[0]} {d.shape[1]}\n"
    for c, k in (("1", 1), ("2", 2), ("m", -1)):
        size = (d == k).sum(0)
        assert np.frombuffer((at / f"{name}.sl{c}").read_bytes(), "<u8").tolist() == size.tolist()
        assert np.frombuffer((at / f"{name}.ss{c}").read_bytes(), "<u8").tolist() == (np.cumsum(size) - size).tolist()
        assert np.frombuffer((at / f"{name}.si{c}").read_bytes(), "<u4").tolist() == [int(i) for j in range(d.shape[1]) for i in np.flatnonzero(d[:, j] == k)]


def test_sparse_scan_is_cut_by_bytes(spark, tmp_path, monkeypatch):
    from polymix.sources import bed, sparse

    d = edge_bed(40)
    (tmp_path / "g.bed").write_bytes(bed.HEADER + b"".join(bed_bytes(d)))
    sparse.bed_to_sparse(spark, f"{tmp_path}/g.bed", f"file://{tmp_path}/s", 40)
    reader = sparse.SparseReader({"path": f"{tmp_path}/s"})
    monkeypatch.setattr(sparse, "BYTES", 100)
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) > 3 and [m for b in batches for m in b.column("marker_id").to_pylist()] == list(range(9))
    assert [x for b in batches for x in b.column("one").to_pylist()] == [np.flatnonzero(d[:, j] == 1).tolist() for j in range(9)]


def test_history_of_both_models(spark, tmp_path):
    from polymix.sources import history

    spark.dataSource.register(history.HistorySource)
    row = lambda it, x: (it, 1.5 * it, [0.25, x], 0.5, 3.0, 0.4, 7 * it, [[0.5, 0.5], [0.25, 0.75]], [0.1, -0.2])
    put = lambda rows, kind, model: spark.createDataFrame(rows, history.COLUMNS).repartition(2).write.format("chainhistory").option("kind", kind).option("model", model).mode("append").save(f"file://{tmp_path}/{model}.{kind}")
    read = lambda kind, model: [tuple(r) for r in spark.read.format("chainhistory").option("kind", kind).option("model", model).load(f"file://{tmp_path}/{model}.{kind}").orderBy("iter").collect()]
    for model in ("gaussian", "weibull"):
        for kind in ("csv", "mus", "gam"):
            put([row(2, 1.0), row(4, 2.0)], kind, model)
            put([row(4, 3.0), row(6, 4.0)], kind, model)  # 4 ran again after a stop
    pi = [[0.5, 0.5], [0.25, 0.75]]
    assert read("csv", "gaussian") == [(i, None, [0.25, x], 0.5, None, 0.4, 7 * i, pi, None) for i, x in ((2, 1.0), (4, 3.0), (6, 4.0))]
    assert read("csv", "weibull") == [(i, 1.5 * i, [0.25, x], None, 3.0, 0.4, 7 * i, pi, None) for i, x in ((2, 1.0), (4, 3.0), (6, 4.0))]
    assert [r[:2] for r in read("mus", "gaussian")] == [(2, 3.0), (4, 6.0), (6, 9.0)]
    assert [(r[0], r[8]) for r in read("gam", "weibull")] == [(i, [0.1, -0.2]) for i in (2, 4, 6)]
    with open(tmp_path / "gaussian.csv", "ab") as f:
        f.write(b"   8,   2, 0.1")  # a line that a stop has cut
    assert [r[0] for r in read("csv", "gaussian")] == [2, 4, 6]
    with pytest.raises(Exception, match="iteration 0"):
        put([row(0, 1.0)], "csv", "gaussian")
    assert [r[0] for r in read("csv", "gaussian")] == [2, 4, 6]


def test_a_chain_keeps_all_hypers_and_refuses_other_settings(spark, tmp_path):
    from polymix.operators import chain

    d, cells, x, beta, rng = simulated(spark, n=80, m=20)
    y, home, s = phenotype(spark, rng.normal(size=80)), f"file://{tmp_path}/c", chain.Settings(windows=2)
    with pytest.raises(ValueError, match="no complete sweep"):
        chain.run(spark, cells, y, 2, s, home, resume=True)
    chain.run(spark, cells, y, 3, s, home)
    with pytest.raises(ValueError, match="already holds"):
        chain.run(spark, cells, y, 5, s, home, resume=False)
    with pytest.raises(ValueError, match="other settings"):
        chain.run(spark, cells, y, 5, chain.Settings(windows=3), home)
    _, trace, store = chain.run(spark, cells, y, 5, s, home, resume=True)
    got = chain.hypers(store).orderBy("iter").collect()
    assert [r.iter for r in got] == [1, 2, 3, 4, 5] and np.isclose(got[3].sigma_e, trace[0].sigma_e) and np.isclose(got[4].mu, trace[1].mu)
    # a stop between the index and the lists
    store.drop("lists")
    again, _, _ = chain.run(spark, cells, y, 6, s, home)
    assert again.hyper.iteration == 6


def files(tmp_path, rng, n=90, m=40, missing=(4, 17)):
    """A genotype, phenotypes (two missing), covariates, failures, groups and mixtures as files."""
    from polymix.sources import bed

    d = rng.binomial(2, rng.uniform(0.05, 0.5, m), (n, m))
    d[rng.random((n, m)) < 0.02] = -1
    d[:, 7] = 0
    x = np.where(d < 0, 0, d - d.mean(0))
    y = 4 + x[:, 0] + rng.normal(0, 0.4, n)
    (tmp_path / "g.bed").write_bytes(bed.HEADER + b"".join(bed_bytes(d)))
    (tmp_path / "g.fam").write_text("".join(f"f i{i} 0 0 1 -9\n" for i in range(n)))
    (tmp_path / "g.phen").write_text("".join(f"f i{i} {'NA' if i in missing else repr(float(v))}\n" for i, v in enumerate(y)))
    (tmp_path / "g.cov").write_text("".join(f"f i{i} {v!r}\n" for i, v in enumerate(rng.normal(size=n).tolist())))
    (tmp_path / "g.fail").write_text("".join(f"{int(v)}\n" for v in rng.random(n) < 0.9))
    (tmp_path / "g.grp").write_text("".join(f"{j % 2}\n" for j in range(m)))
    (tmp_path / "g.mix").write_text("0.001,0.1;0.01,0.2\n")
    (tmp_path / "g.blocks").write_text("1 15\n16 30\n31 40\n")
    return d, y


def options(tmp_path, name, **more):
    rows = {"bed-file": f"file://{tmp_path}/g.bed", "fam-file": f"file://{tmp_path}/g.fam", "phenotype-file": f"file://{tmp_path}/g.phen", "out": f"file://{tmp_path}/{name}", "seed": 3, "thin": 2, "save": 4, "sync-rate": 6} | {k.replace("_", "-"): v for k, v in more.items()}
    (tmp_path / f"{name}.options").write_text("// a run\n" + "".join(f"{k} {v}\n" for k, v in rows.items()))
    return f"file://{tmp_path}/{name}.options"


def test_a_run_from_files_to_files(spark, tmp_path):
    from polymix import run
    from polymix.config import read_config
    from polymix.sources import chain_files, history

    d, y = files(tmp_path, np.random.default_rng(3))
    grouped = {"group_file": f"file://{tmp_path}/g.grp", "mixture_file": f"file://{tmp_path}/g.mix", "covariates_file": f"file://{tmp_path}/g.cov", "blocks_file": f"file://{tmp_path}/g.blocks"}
    whole = read_config(spark, options(tmp_path, "a", chain_length=8, **grouped))
    st = run.run(spark, whole)
    spark.dataSource.register(chain_files.ChainSource)
    read = lambda name, end, kind="double": {(r.iter, r.marker_id): r["value"] for r in spark.read.format("chain").option("kind", kind).load(f"{tmp_path}/{name}.{end}").collect()}
    bet, cpn = read("a", "bet"), read("a", "cpn", "int")
    assert {i for i, _ in bet} == {2, 4, 6, 8} and len(bet) == 4 * 40 and all((bet[k] != 0) == (cpn[k] > 0) for k in bet)
    own = dense(st, 40)
    assert np.allclose([bet[8, j] for j in range(40)], own) and all(bet[i, 7] == 0 for i in (2, 4, 6, 8))
    lines = spark.read.format("chainhistory").load(f"file://{tmp_path}/a.csv").orderBy("iter").collect()
    assert [r.iter for r in lines] == [2, 4, 6, 8] and np.isclose(lines[-1].h2, st.hyper.h2) and len(lines[0].sigma_g) == 2 and len(lines[0].pi[1]) == 3
    # the residual: two individuals are gone from every table
    on = np.array([i for i in range(90) if i not in (4, 17)])
    e = d[on]
    known = e >= 0
    mave = np.where(known, e, 0).sum(0) / known.sum(0)
    ss = (np.where(known, e - mave, 0) ** 2).sum(0)
    x = np.where(known, e - mave, 0) * np.sqrt(87 / np.where(ss > 0, ss, np.inf))
    z = (y[on] - y[on].mean()) / y[on].std(ddof=1)
    cov = np.array([float(v.split()[2]) for v in (tmp_path / "g.cov").read_text().splitlines()])[on]
    assert np.abs(st.eps + st.hyper.mu + x @ own + st.hyper.gamma[0] * cov - z).max() < 1e-8

    # stopped after three sweeps and taken up again: the same files
    run.run(spark, read_config(spark, options(tmp_path, "b", chain_length=3, **grouped)))
    again = run.run(spark, read_config(spark, options(tmp_path, "b", chain_length=8, restart=1, **grouped)))
    assert np.allclose(again.eps, st.eps)
    for end in ("csv", "mus", "bet", "acu", "cpn"):
        assert np.allclose(np.frombuffer((tmp_path / f"a.{end}").read_bytes(), np.uint8).size, np.frombuffer((tmp_path / f"b.{end}").read_bytes(), np.uint8).size)
    assert read("b", "cpn", "int") == cpn and (tmp_path / "a.mus").stat().st_size == 4 * history.MUS.size
    with pytest.raises(ValueError, match="already holds"):
        run.run(spark, read_config(spark, options(tmp_path, "b", chain_length=9, **grouped)))
    with pytest.raises(ValueError, match="no complete sweep"):
        run.run(spark, read_config(spark, options(tmp_path, "c", chain_length=9, restart=1)))


def test_runs_of_all_representations_draw_the_same(spark, tmp_path):
    from polymix import run
    from polymix.config import read_config

    files(tmp_path, np.random.default_rng(4))
    run.run(spark, read_config(spark, options(tmp_path, "s", analysis="convert")))
    ways = {"bed": {}, "sparse": {"bed_file": None, "sparse_base": f"file://{tmp_path}/s"}, "mixed": {"sparse_base": f"file://{tmp_path}/s", "threshold": 0.5}}
    found = []
    for name, more in ways.items():
        path = options(tmp_path, name, chain_length=2, **{k: v for k, v in more.items() if v is not None})
        if more.get("bed_file", "") is None:
            text = (tmp_path / f"{name}.options").read_text().splitlines()
            (tmp_path / f"{name}.options").write_text("\n".join(x for x in text if not x.startswith("bed-file")) + "\n")
        found.append(run.run(spark, read_config(spark, path)))
    for st in found[1:]:
        assert np.array_equal(st.key, found[0].key) and np.allclose(st.eps, found[0].eps)


def test_a_survival_run(spark, tmp_path):
    from polymix import run
    from polymix.config import read_config

    files(tmp_path, np.random.default_rng(6), n=70, m=12)
    (tmp_path / "g.blocks").unlink()
    c = read_config(spark, options(tmp_path, "w", analysis="weibull", chain_length=4, failure_file=f"file://{tmp_path}/g.fail", covariates_file=f"file://{tmp_path}/g.cov", quad_points=9))
    st = run.run(spark, c)
    line = spark.read.format("chainhistory").option("model", "weibull").load(f"file://{tmp_path}/w.csv").orderBy(F.col("iter").desc()).first()
    assert np.isclose(line.mu, st.hyper.mu) and np.isclose(line.alpha, st.hyper.alpha)
    gam = spark.read.format("chainhistory").option("kind", "gam").load(f"file://{tmp_path}/w.gam").orderBy("iter").collect()
    assert [r.iter for r in gam] == [2, 4] and np.isclose(gam[-1].gamma[0], st.hyper.gamma[0])


def test_traits_under_their_own_masks(spark, tmp_path):
    from polymix.operators import chain, multi_trait

    d, cells, x, beta, rng = simulated(spark, n=150, m=30)
    d = np.where(np.arange(30) == 5, np.where(np.arange(150)[:, None] < 40, d, 0), d)  # varies only where the second trait isn't known
    i, j = np.nonzero(d)
    cells = spark.createDataFrame([(int(a) * 3, int(b), None if d[a, b] < 0 else int(d[a, b])) for a, b in zip(i, j)], "ind_id long, marker_id long, d int")
    masks = np.stack([np.arange(150) % 7 != 2, np.arange(150) >= 40])
    ys, xs = [], []
    for t, mask in enumerate(masks):
        e = d[mask]
        known = e >= 0
        mave = np.where(known, e, 0).sum(0) / np.maximum(known.sum(0), 1)
        ss = (np.where(known, e - mave, 0) ** 2).sum(0)
        xs.append(np.where(known, e - mave, 0) * np.where(ss > 0, np.sqrt((mask.sum() - 1) / np.where(ss > 0, ss, 1)), 0))
        y = xs[-1][:, 3 + t] + rng.normal(0, 0.5, mask.sum())
        ys.append((y - y.mean()) / y.std(ddof=1))
    rows = [(3 * int(a), t, float(v)) for t in range(2) for a, v in zip(np.flatnonzero(masks[t]), ys[t])] + [(6, 0, None), (0, 1, None)]
    traits = spark.createDataFrame(rows, "ind_id long, trait int, y double")
    states, trace, store = multi_trait.run(spark, cells, traits, 4, chain.Settings(windows=2, blocks=2, threshold=0.4), f"file://{tmp_path}/m")
    for t, st in enumerate(states):
        own = dense(st, 30)
        assert np.abs(st.eps + st.hyper.mu + xs[t] @ own - ys[t]).max() < 1e-8
        assert np.abs(own).argmax() == 3 + t and [h[t].iteration for h in trace] == [1, 2, 3, 4]
    assert dense(states[1], 30)[5] == 0
    # the change of the residuals by joins
    delta = spark.createDataFrame([(k, (k % 7 - 3) / 100) for k in range(30)], "marker_id long, delta_beta double")
    got = {(r.trait, r.ind_id): r.delta_eps for r in multi_trait.trait_changes(cells, traits, delta).collect()}
    want = {(t, 3 * int(a)): v for t in range(2) for a, v in zip(np.flatnonzero(masks[t]), xs[t] @ ((np.arange(30) % 7 - 3) / 100))}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_covariates_of_the_survival_model(spark, tmp_path):
    from polymix.operators import chain, weibull

    d, cells, x, beta, rng = simulated(spark, n=300, m=20, causal=0, seed=4, missing=0.0)
    z = rng.normal(size=300)
    y = 4.1 + 0.3 * z + (np.log(rng.exponential(size=300)) + weibull.EULER) / 8
    cov = spark.createDataFrame([(3 * i, [float(v)]) for i, v in enumerate(z)], "ind_id long, x array<double>")
    fail = spark.createDataFrame([(3 * i, 1) for i in range(300)], "ind_id long, fail int")
    st, _, _ = chain.run(spark, cells, phenotype(spark, y), 12, chain.Settings(windows=1), f"file://{tmp_path}/w", covariates=cov, fail=fail, model=weibull.Weibull)
    assert abs(st.hyper.gamma[0] - 0.3) < 0.05 and abs(st.hyper.mu - 4.1) < 0.1
    assert np.abs(st.eps + st.hyper.mu + x @ dense(st, 20) + st.hyper.gamma[0] * z - y).max() < 1e-8


def test_horseshoe_over_blocks(spark, tmp_path):
    from polymix.operators import chain, horseshoe

    d, cells, x, beta, rng = simulated(spark, n=250, m=40, causal=4, seed=6)
    z = rng.normal(size=250)
    y = x @ beta + 0.8 * z + rng.normal(0, 0.5, 250)
    y = (y - y.mean()) / y.std(ddof=1)
    groups = spark.createDataFrame([(j, j % 2) for j in range(40)], "marker_id long, grp int")
    cov = spark.createDataFrame([(3 * i, [float(v)]) for i, v in enumerate(z)], "ind_id long, x array<double>")
    s = chain.Settings(windows=2, blocks=2, mixture=((1.0,),), thin=2)
    go = lambda until, home: chain.run(spark, cells, phenotype(spark, y), until, s, f"file://{tmp_path}/{home}", groups, cov, model=horseshoe.Horseshoe)
    st, trace, store = go(6, "a")
    assert np.abs(st.eps + st.hyper.mu + x @ dense(st, 40) + st.hyper.gamma[0] * z - y).max() < 1e-8
    assert np.corrcoef(dense(st, 40), beta)[0, 1] > 0.7 and len(trace[0].slab) == 2 and all(h.tau > 0 for h in trace)
    last = store.read("sweeps").filter("iter = 6 and part is null").collect()
    assert len(last) == 40 and all(r.local > 0 for r in last)
    go(3, "b")
    again, _, _ = go(6, "b")
    assert np.array_equal(again.key, st.key) and np.allclose(again.beta, st.beta) and np.isclose(again.hyper.tau, st.hyper.tau)


def test_stream_over_a_chains_own_folder(spark, tmp_path):
    from polymix.operators import chain
    from polymix.streaming import monitor

    d, cells, x, beta, rng = simulated(spark, n=80, m=12)
    y, home, s = phenotype(spark, x[:, 2] + rng.normal(0, 0.5, 80)), f"file://{tmp_path}/c", chain.Settings(windows=2)
    found = {}

    def put(batch, number):
        found.update({r.marker_id: r for r in batch.collect()})

    go = lambda: monitor.chain_summary(spark, home, burn_in=1, files=3).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/q").trigger(availableNow=True).start().awaitTermination()
    for until in (2, 5):  # the query is started again on the chain as it has grown
        _, _, store = chain.run(spark, cells, y, until, s, home)
        go()
    rows = {}
    for r in chain.samples(store).filter("iter > 1").collect():
        rows.setdefault(r.marker_id, []).append(r.beta)
    assert found.keys() == rows.keys()
    for m, v in rows.items():
        assert (found[m].n, found[m].last) == (4, 5) and np.isclose(found[m]["mean"], np.mean(v)) and np.isclose(found[m].sd, np.std(v, ddof=1)) and np.isclose(found[m].pip, np.mean(np.array(v) != 0))


def test_running_sketch_and_convergence():
    from polymix.streaming.monitor import Running

    rng = np.random.default_rng(1)
    v = rng.normal(2, 3, 5000)
    now = Running(None)
    for i, x in enumerate(v):
        now.add(i, float(x), int(x > 0))
        now.add(i, 1e9, 1)  # a sweep that ran again
    assert np.isclose(now.mean, v.mean()) and np.isclose(now.m2 / 4999, v.var(ddof=1)) and now.effects == (v > 0).sum()
    assert abs(now.quantile(0.025) - np.quantile(v, 0.025)) < 0.4 and abs(now.quantile(0.5) - np.median(v)) < 0.3
    assert len(now.points) <= 64 and len(now.ns) <= 16 and sum(now.ns) == 5000 and abs(now.rhat() - 1) < 0.02
    away = Running(now.held())
    for i in range(5000, 10_000):
        away.add(i, float(rng.normal(12, 3)), 1)
    assert away.rhat() > 1.5

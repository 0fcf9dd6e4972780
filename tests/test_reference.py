import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


def names():
    from polymix.plans.registry import ORACLES

    return list(ORACLES)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, name):
    from polymix.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in "nation customer part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, o = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(o.columns, o.fetchall())


def test_readers_and_bed(spark, tmp_path):
    from polymix.operators import stats
    from polymix.sources import text
    from polymix.sources.bed import BedSource

    (tmp_path / "a.fam").write_text("f1 i1 0 0 1 -9\nf2 i2 0 0 2 -9\n")
    assert [r.id for r in text.read_fam(spark, f"file://{tmp_path}/a.fam").orderBy("ind_id").collect()] == ["f1:i1", "f2:i2"]
    (tmp_path / "b.fam").write_text("f1 i1 0 0 1 -9\nf1 i1 0 0 2 -9\n")
    with pytest.raises(ValueError):
        text.read_fam(spark, f"file://{tmp_path}/b.fam")
    (tmp_path / "m").write_text("0.001,0.01;0.1,0.2\n")
    assert text.read_mixtures(spark, f"file://{tmp_path}/m").count() == 6
    (tmp_path / "blk").write_text("1 5\n7 9\n")
    with pytest.raises(ValueError):
        text.read_blocks(spark, f"file://{tmp_path}/blk", 9)
    # eleven individuals exercise the padding
    cells = [(m, i, d) for m, i, d in [(0, 0, 1), (0, 10, 2), (1, 3, None), (2, 5, 1), (2, 6, 2)]]
    packed = stats.pack(spark.createDataFrame(cells, "marker_id long, ind int, d int"), 11)
    rows = packed.orderBy("marker_id").collect()
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01" + b"".join(bytes(r.packed) for r in rows))
    spark.dataSource.register(BedSource)
    back = spark.read.format("bed").option("individuals", 11).option("block", 2).load(str(tmp_path / "x.bed"))
    assert sorted(map(tuple, stats.unpack(back, 11).collect()), key=str) == sorted(cells, key=str)


@pytest.mark.parametrize("model", ["gibbs", "horseshoe"])
def test_chain_keeps_the_residual_and_resumes(spark, model):
    import importlib

    from polymix.operators import stats
    from polymix.sources.adapter import Domain
    from polymix.sources.scratch import saver
    from pyspark.sql import functions as F

    gibbs = importlib.import_module(f"polymix.operators.{model}")
    d, s = Domain(spark, SF), gibbs.Settings(windows=2)
    geno, y = d.genotype(), d.phenotype()
    whole, trace = gibbs.run(geno, y, 2, s, saver(spark))
    half, _ = gibbs.run(geno, y, 1, s, saver(spark))
    again, _ = gibbs.run(geno, y, 1, s, saver(spark), half)
    assert np.isclose(again[2].sigma_e, whole[2].sigma_e)
    # e + mu + X beta = y
    n = y.count()
    xb = stats.residual_update(geno, stats.marker_stats(geno, n), whole[1].select("marker_id", F.col("beta").alias("delta_beta")), y)
    left = whole[0].join(xb, "ind_id").join(y, "ind_id").select((F.col("e") + F.col("delta_eps") + F.lit(whole[2].mu) - F.col("y")).alias("r"))
    assert max(abs(r.r) for r in left.collect()) < 1e-9


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

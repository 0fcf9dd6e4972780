"""A run from files to files: options name the genotype, the individuals' tables and the model; samples, hyper-parameters and states come out."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig
from .operators import chain, horseshoe, weibull
from .sources import bed, chain_files, history, sparse, text


def markers_of(spark: SparkSession, c: RunConfig, individuals: int) -> tuple[DataFrame, int]:
    """marker_id with lists or packed rows, and how many markers the files hold."""
    if c.sparse_base:
        spark.dataSource.register(sparse.SparseSource)
        n, m = map(int, spark.read.text(f"{c.sparse_base}.dim").first()["value"].split())
        if n != individuals:
            raise ValueError(f"the sparse set has {n} individuals, the individuals' file {individuals}")
        lists = spark.read.format("sparsegeno").load(c.sparse_base)
        if not c.bed_file:
            return lists, m
        # both: dense markers are read packed, the others as lists; each file is read for its own markers
        share = (F.size("one") + F.size("two") + F.size("miss")) / F.lit(float(individuals))
        lists = lists.withColumn("dense", share > c.threshold)
    if c.bed_file:
        spark.dataSource.register(bed.BedSource)
        rows = spark.read.format("bed").option("individuals", individuals).load(c.bed_file)
        if not c.sparse_base:
            return rows, bed.markers_in(c.bed_file, individuals)
        rows = rows.join(lists.filter("dense").select("marker_id"), "marker_id")
        return lists.filter("not dense").drop("dense").unionByName(rows, allowMissingColumns=True), m
    raise ValueError("a run needs a packed genotype file or a sparse set")


def individuals_of(spark: SparkSession, c: RunConfig) -> tuple[DataFrame, int]:
    """ind_id (the place in the individuals' file), y, and x and fail where given, of those who lack nothing; and how many the file holds."""
    n = text.lines(spark, c.fam_file or c.phenotype_file).count()
    parts = [text.read_phen(spark, c.phenotype_file).select("ind_id", "y")]
    if c.fam_file:
        parts = [text.by_id(text.read_phen(spark, c.phenotype_file), text.read_fam(spark, c.fam_file)).select("ind_id", "y")]
    if c.covariates_file:
        parts.append(text.read_cov(spark, c.covariates_file))
    if c.failure_file:
        parts.append(text.read_fail(spark, c.failure_file))
    return text.complete(*parts).drop("new_id"), n


def settings_of(spark: SparkSession, c: RunConfig) -> tuple[chain.Settings, DataFrame | None]:
    s = chain.Settings(seed=c.seed, windows=c.windows, thin=c.thin, blocks=c.blocks, sync=c.sync_rate or None, threshold=c.threshold, shuffle=bool(c.shuffle))
    groups = None
    if c.group_file:
        groups = text.read_groups(spark, c.group_file)
        rows = text.read_mixtures(spark, c.mixture_file).filter("k > 0").orderBy("grp", "k").collect()  # a row per group and component
        found: dict[int, list[float]] = {}
        for r in rows:
            found.setdefault(r.grp, []).append(r.cva)
        s = replace(s, mixture=tuple(map(tuple, found.values())))
    else:
        s = replace(s, mixture=(tuple(float(x) for x in c.mixture.split(",")),))
    if c.priors_file:
        s = replace(s, priors=text.read_priors(spark, c.priors_file))
    if c.dirichlet_file:
        s = replace(s, dirichlet=text.read_dirichlet(spark, c.dirichlet_file))
    return s, groups


def export(spark: SparkSession, store, c: RunConfig, markers: int, first: int, last: int) -> None:
    """Samples of the kept sweeps ``first`` to ``last`` at their places in the files; states stay in the chain's folder."""
    kept = chain.samples(store, c.thin).filter(F.col("iter").between(first, last))
    for end, value, kind in (("bet", "beta", "double"), ("acu", "acum", "double"), ("cpn", "component", "int")):
        chain_files.write_records(kept, f"{c.out}.{end}", markers, value, kind, thin=c.thin)


def run(spark: SparkSession, c: RunConfig) -> chain.State | None:
    """Converts (``analysis convert``: packed genotype to sparse set at ``out``), or runs a chain and writes, from ``out`` on: ``.csv`` (hyper-parameters,
    with ``.mus``, and ``.gam`` in the survival model), ``.bet``, ``.acu`` and ``.cpn`` (samples of kept sweeps), and the folder ``.chain``, from which ``restart``
    goes on. Phenotypes of the Gaussian model are standardised, those of the survival model are logarithms of times. Individuals with anything
    missing are left out of all tables and of the genotype while it is read. Files are written every ``save`` sweeps.
    """
    c = c.normalised()
    if not c.out:
        raise ValueError("a run needs a start for the names of its files")
    if c.analysis == "convert":
        sparse.bed_to_sparse(spark, c.bed_file, c.out, text.lines(spark, c.fam_file).count())
        return None
    spark.dataSource.register(history.HistorySource)
    people, individuals = individuals_of(spark, c)
    if c.analysis != "weibull":
        m = people.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).first()
        people = people.withColumn("y", (F.col("y") - F.lit(m.m)) / F.lit(m.s))
    markers, many = markers_of(spark, c, individuals)
    s, groups = settings_of(spark, c)
    blocks = text.read_blocks(spark, c.blocks_file, many) if c.blocks_file else None
    model, line = chain.Gaussian, "gaussian"
    if c.analysis == "weibull":
        model, line = partial(weibull.Weibull, nodes=c.quad_points), "weibull"
    elif c.analysis == "horseshoe":
        prior = horseshoe.Settings(tau0=c.tau0, v0_local=c.v0_local, v0_tau=c.v0_tau, v0_slab=c.v0_slab, s0_slab=c.s0_slab)
        model = partial(horseshoe.Horseshoe, prior=prior)
        s = replace(s, mixture=tuple(row[:1] for row in s.mixture))
    covariates = people.select("ind_id", "x") if c.covariates_file else None
    fail = people.select("ind_id", "fail") if c.analysis == "weibull" else None

    def kept(h: chain.Hyper) -> None:
        row = [(h.iteration, h.mu, list(h.sigma_g), h.sigma_e, h.alpha, h.h2, h.m0, [list(p) for p in h.pi], list(h.gamma))]
        df = spark.createDataFrame(row, history.COLUMNS).coalesce(1)
        for kind in ("csv", "mus", *(["gam"] if c.analysis == "weibull" and h.gamma else [])):
            df.write.format("chainhistory").option("kind", kind).option("model", line).mode("append").save(f"{c.out}.{kind}")

    state, done, resume = None, 0, bool(c.restart)
    home = f"{c.out}.chain"
    if resume:
        done = chain.Store(spark, home).last("states", "iter") or 0
    while state is None or done < c.chain_length:
        until = min(c.chain_length, done - done % c.save + c.save)
        state, _, store = chain.run(spark, None, people.select("ind_id", "y"), until, s, home, groups, covariates, fail, model, markers=markers, individuals=individuals, blocks=blocks, resume=resume, kept=kept)
        export(spark, store, c, many, max(1, done - done % c.save), until)
        if until <= done:
            break
        done, resume = until, True
    return state


def effects(spark: SparkSession, c: RunConfig, markers: int) -> DataFrame:
    """Posterior means of a run's samples after ``burn_in``: marker_id, mean, pip."""
    spark.dataSource.register(chain_files.ChainSource)
    beta = spark.read.format("chain").load(f"{c.out}.bet").filter(F.col("iter") > c.burn_in)
    return beta.groupBy("marker_id").agg(F.avg("value").alias("mean"), F.avg((F.col("value") != 0).cast("double")).alias("pip"))


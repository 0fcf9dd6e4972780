"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mixture
from ..operators import stats
from ..sources.adapter import Domain

QUERIES: dict = {}
ORACLES: dict = {}

#: Hyper-parameters of the single-step queries.
SIGMA_G, SIGMA_E, PI, SCALE = 0.5, 0.5, [0.5, 0.25, 0.15, 0.1], [0.001, 0.01, 0.1]
EULER = 0.57721566490153286

CELLS = """
cells as (select o_custkey as ind_id, l_partkey as marker_id, count(*) as c,
                 min(case when l_returnflag = 'R' and l_quantity > 45 then 1 else 0 end) as mis
          from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey),
keep as (select c_custkey as ind_id, c_acctbal as y from customer where c_acctbal >= 0),
geno as (select c.ind_id, c.marker_id, case when mis = 1 then null when c.c >= 2 then 2 else 1 end as d
         from cells c join keep k on c.ind_id = k.ind_id),
ph as (select ind_id, (y - avg(y) over ()) / stddev_samp(y) over () as y from keep),
nn as (select count(*) as n from keep),
cnt as (select marker_id, count(*) filter (where d = 1) as n1, count(*) filter (where d = 2) as n2,
               count(*) filter (where d is null) as nm from geno group by marker_id),
st0 as (select marker_id, n1, n2, nm, n, (n1 + 2 * n2) / cast(n - nm as double) as mave from cnt, nn),
st as (select *, sqrt((n - 1) / (n1 * (1 - mave) * (1 - mave) + n2 * (2 - mave) * (2 - mave) + (n - nm - n1 - n2) * mave * mave)) as mstd
       from st0 where n1 * (1 - mave) * (1 - mave) + n2 * (2 - mave) * (2 - mave) + (n - nm - n1 - n2) * mave * mave > 0),
tot as (select sum(y) as sy from ph),
dot as (select s.marker_id, any_value(mave) as mave, any_value(mstd) as mstd, any_value(n) as n,
               any_value(mstd) * (sum(case when d = 1 then y when d = 2 then 2 * y else 0 end)
                 - any_value(mave) * (any_value(sy) - sum(case when d is null then y else 0 end))) as num
        from geno g join ph on g.ind_id = ph.ind_id join st s on s.marker_id = g.marker_id, tot group by s.marker_id),
fail as (select k.ind_id, coalesce(max(case when o_orderstatus = 'F' then 1 else 0 end), 0) as fail
         from keep k left join orders on o_custkey = k.ind_id group by k.ind_id),
samples as (select iter, marker_id, component, case when component = 0 then 0.0e0 else (v - 100) / 1000 end as beta from (
  select event_id // 100 as iter, user_id as marker_id, arg_max(value, event_id) as v,
         case arg_max(event_type, event_id) when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end as component
  from events group by 1, 2))"""


def query(sql: str):
    """Register the function below under its name, with its SQL after the shared subqueries."""

    def put(f):
        def run(spark, sf_dir):
            return f(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, f"with {CELLS.strip()}\n{sql.strip()}"
        return run

    return put


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


def scan(d: Domain) -> tuple[DataFrame, int]:
    """num, mave and mstd per marker for the standardised phenotype, and the number of individuals."""
    n = d.individuals().count()
    return stats.marker_dot(d.genotype(), d.phenotype(), n, "y"), n


@query("select marker_id, round(mave, 6) as mave, round(mstd, 6) as mstd, round(num, 4) as num from dot")
def marker_scan_flagship(d):
    return rounded(scan(d)[0].select("marker_id", "mave", "mstd", "num"), mave=6, mstd=6, num=4)


@query("select marker_id, n1, n2, nm from cnt")
def geno_class_counts(d):
    return stats.class_counts(d.genotype())


@query("select marker_id, n1, n2, nm, round(mave, 6) as mave, round(mstd, 6) as mstd from st")
def marker_stats(d):
    return rounded(stats.marker_stats(d.genotype(), d.individuals().count()), mave=6, mstd=6)


@query("select marker_id, round(mave, 6) as mave, round(1 / mstd, 6) as sd from st")
def marker_stats_sd(d):
    s = stats.marker_stats(d.genotype(), d.individuals().count())
    return rounded(s.select("marker_id", "mave", (1 / F.col("mstd")).alias("sd")), mave=6, sd=6)


@query("select ind_id, round(y, 6) as y from ph")
def phen_standardize(d):
    return rounded(d.phenotype(), y=6)


@query("""select c_custkey as ind_id, cast(c_acctbal >= 0 as int) as mask, case when c_acctbal >= 0 then round((c_acctbal - m) / s, 6) else 0 end as y
from customer, (select avg(y) as m, stddev_samp(y) as s from keep)""")
def phen_masked_standardize(d):
    m = d.individuals().agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).first()
    on = F.col("c_acctbal") >= 0
    return d.table("customer").select(F.col("c_custkey").alias("ind_id"), on.cast("int").alias("mask"), F.when(on, F.round((F.col("c_acctbal") - F.lit(m.m)) / F.lit(m.s), 6)).otherwise(0.0).alias("y"))


@query("select ind_id, cast(row_number() over (order by ind_id) - 1 as bigint) as new_id from keep")
def na_drop_reindex(d):
    return stats.dense_index(d.individuals().select("ind_id"), "ind_id", "new_id").select("ind_id", F.col("new_id").cast("long").alias("new_id"))


@query("""select marker_id, n1, cast(coalesce(sum(n1) over (order by marker_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start1,
cast(coalesce(sum(n2) over (order by marker_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start2 from cnt""")
def sparse_csr_starts(d):
    c = stats.class_counts(d.genotype())
    c = stats.prefix(stats.prefix(c, "marker_id", F.col("n1"), "start1"), "marker_id", F.col("n2"), "start2")
    return c.select("marker_id", "n1", F.col("start1").cast("long").alias("start1"), F.col("start2").cast("long").alias("start2"))


@query("""select c.marker_id, c.nnz, round(c.nnz / cast(n as double), 6) as fnz, c.nnz / cast(n as double) > 0.06 as use_bed from (
select l_suppkey as marker_id, count(distinct o_custkey) as nnz from lineitem join orders on l_orderkey = o_orderkey join keep on o_custkey = ind_id group by 1) c, nn""")
def mixed_representation(d):
    n = d.individuals().count()
    c = d.genotype("l_suppkey").groupBy("marker_id").agg(F.count("*").alias("nnz"))
    fnz = F.col("nnz") / F.lit(float(n))
    return c.select("marker_id", "nnz", F.round(fnz, 6).alias("fnz"), (fnz > 0.06).alias("use_bed"))


BLOCKS = """(select p_partkey as m, case when p_partkey < r * (q + 1) then p_partkey // (q + 1) else r + (p_partkey - r * (q + 1)) // q end as block
 from part, (select count(*) // 7 as q, count(*) % 7 as r from part))"""


@query(f"select cast(block as bigint) as block, min(m) as first_marker, max(m) as last_marker, count(*) as markers from {BLOCKS} group by block")
def marker_blocks(d):
    p = d.table("part").select(F.col("p_partkey").alias("m"))
    b = p.withColumn("block", stats.block_of(F.col("m"), p.count(), 7))
    return b.groupBy("block").agg(F.min("m").alias("first_marker"), F.max("m").alias("last_marker"), F.count("*").alias("markers"))


@query(f"""select cast(block // 3 as bigint) as node, count(distinct block) as tasks, cast(coalesce(sum(4 * (n1 + n2 + nm)), 0) as bigint) as bytes
from {BLOCKS} b left join cnt on cnt.marker_id = b.m group by 1""")
def ram_per_node(d):
    p = d.table("part").select(F.col("p_partkey").alias("marker_id"))
    b = p.withColumn("block", stats.block_of(F.col("marker_id"), p.count(), 7)).join(stats.class_counts(d.genotype()), "marker_id", "left")
    size = F.coalesce(4 * (F.col("n1") + F.col("n2") + F.col("nm")), F.lit(0))
    tasks = b.groupBy("block").agg(F.sum(size).alias("bytes"))
    return tasks.groupBy(F.floor(F.col("block") / 3).alias("node")).agg(F.count("*").alias("tasks"), F.sum("bytes").alias("bytes"))


@query("""select g.marker_id, round(any_value(mstd) * (sum(case when d = 1 then f when d = 2 then 2 * f else 0 end) - any_value(mave) * (any_value(sf) - sum(case when d is null then f else 0 end))), 4) as num
from geno g join (select ind_id, cast(fail as double) as f from fail) f on g.ind_id = f.ind_id join st on st.marker_id = g.marker_id, (select sum(fail) as sf from fail) group by g.marker_id""")
def sparse_dot(d):
    v = d.failure().select("ind_id", F.col("fail").cast("double").alias("f"))
    return rounded(stats.marker_dot(d.genotype(), v, d.individuals().count(), "f").select("marker_id", "num"), num=4)


def delta(d: Domain) -> DataFrame:
    """A change of the effects, fixed by the marker's number, for the kernels that apply one."""
    return d.table("part").select(F.col("p_partkey").alias("marker_id"), ((F.col("p_partkey") % 7 - 3) / F.lit(100.0)).alias("delta_beta"))


@query("""select k.ind_id, round(coalesce(s, 0) - flat, 6) as delta_eps from keep k
left join (select ind_id, sum(case when d is null then a * mave else a * d end) as s from geno g join (select marker_id, mave, mstd * (marker_id % 7 - 3) / 100e0 as a from st) m on g.marker_id = m.marker_id group by ind_id) x on k.ind_id = x.ind_id,
(select sum(mstd * (marker_id % 7 - 3) / 100e0 * mave) as flat from st)""")
def sparse_axpy_residual(d):
    geno = d.genotype()
    s = stats.marker_stats(geno, d.individuals().count())
    return rounded(stats.residual_update(geno, s, delta(d), d.individuals()), delta_eps=6)


@query("""select k.ind_id, round(coalesce(s, 0) - flat, 6) as delta_eps from keep k
left join (select ind_id, sum(a * coalesce(d, 0)) as s from geno g join (select marker_id, mstd * (marker_id % 7 - 3) / 100e0 as a from st) m on g.marker_id = m.marker_id group by ind_id) x on k.ind_id = x.ind_id,
(select sum(mstd * (marker_id % 7 - 3) / 100e0 * mave) as flat from st)""")
def raw_update(d):
    # as the survival model may: a missing cell counts as no copy
    geno = d.genotype()
    s = stats.marker_stats(geno, d.individuals().count())
    return rounded(stats.residual_update(geno, s, delta(d), d.individuals(), raw=True), delta_eps=6)


@query("select round(sum(abs((p_partkey % 7 - 3) / 100e0)), 6) as total, count(*) filter (where p_partkey % 7 <> 3) as moved from part")
def abs_delta_beta(d):
    return delta(d).agg(F.round(F.sum(F.abs("delta_beta")), 6).alias("total"), F.count_if(F.col("delta_beta") != 0).alias("moved"))


def _logs(num: str = "num", n: str = "n") -> list[str]:
    out = [f"ln({PI[0]}e0)"]
    for p, c in zip(PI[1:], SCALE, strict=True):
        out.append(f"(ln({p}e0) - 0.5e0 * ln(({n} - 1) * {c}e0 + 1e0) + {num} / (({n} - 1) + 1e0 / {c}e0) * {num} / 1e0)")
    return out


def _share(k: int, logs: list[str], rest: bool = False) -> str:
    far = " or ".join(f"abs({x} - {logs[k]}) > 700" for x in (logs[k + 1 :] if rest else logs)) or "false"
    return f"(case when {far} then 0e0 else 1 / ({' + '.join(f'exp({x} - {logs[k]})' for x in logs)}) end)"


LOGS = ["l0", "l1", "l2", "l3"]
STEP = f"(select marker_id, num, n, {', '.join(f'{x} as {y}' for x, y in zip(_logs(), LOGS, strict=True))}, (48271 * ((48271 * marker_id + 11) % 2147483647) + 3) % 2147483647 / 2147483647e0 as u from dot)"
PICK = f"case when u <= {_share(0, LOGS)} then 0 when u <= {_share(0, LOGS)} + {_share(1, LOGS, True)} then 1 when u <= {_share(0, LOGS)} + {_share(1, LOGS, True)} + {_share(2, LOGS, True)} then 2 else 3 end"


@query(f"select marker_id, round({_share(0, LOGS)}, 6) as acum, round(1 - {_share(0, LOGS)}, 6) as pip from {STEP}")
def mixture_posterior(d):
    s, n = scan(d)
    logs, _ = mixture.log_weights(F.col("num"), n, SIGMA_G, SIGMA_E, PI, SCALE)
    p0 = mixture.share(logs, 0)
    return s.select("marker_id", F.round(p0, 6).alias("acum"), F.round(1 - p0, 6).alias("pip"))


def step(d: Domain) -> DataFrame:
    """One update of all markers of a window: component by a counter uniform, effect at its posterior mean."""
    s, n = scan(d)
    logs, means = mixture.log_weights(F.col("num"), n, SIGMA_G, SIGMA_E, PI, SCALE)
    k = mixture.chosen(logs, mixture.lcg(11, 3, F.col("marker_id")))
    s = s.withColumn("component", k)
    beta = reduce(lambda a, i: a.when(F.col("component") == i + 1, means[i]), range(len(means)), F.when(F.col("component") == 0, 0.0))
    return s.select("marker_id", "component", beta.alias("beta"))


STEPPED = f"(select marker_id, component, case component when 0 then 0e0 when 1 then num / ((n - 1) + 1e0 / 0.001e0) when 2 then num / ((n - 1) + 1e0 / 0.01e0) else num / ((n - 1) + 1e0 / 0.1e0) end as beta from (select *, {PICK} as component from {STEP}))"


@query(f"select marker_id, cast(component as int) as component, round(beta, 6) as beta from {STEPPED}")
def gibbs_window_step(d):
    return rounded(step(d), beta=6)


def grouped(d: Domain) -> DataFrame:
    g = d.table("part").select(F.col("p_partkey").alias("marker_id"), (F.col("p_size") % 2).cast("int").alias("grp"))
    return step(d).join(g, "marker_id")


GROUPED = f"(select s.*, cast(p_size % 2 as int) as grp from {STEPPED} s join part on marker_id = p_partkey)"


@query(f"select grp, cast(component as int) as component, count(*) as n from {GROUPED} group by 1, 2")
def component_counts(d):
    return grouped(d).groupBy("grp", "component").agg(F.count("*").alias("n"))


@query(f"select grp, round(sum(beta * beta), 6) as sqnorm, count(*) as markers, count(*) filter (where component > 0) as m0 from {GROUPED} group by grp")
def group_beta_sqnorm(d):
    return grouped(d).groupBy("grp").agg(F.round(F.sum(F.col("beta") * F.col("beta")), 6).alias("sqnorm"), F.count("*").alias("markers"), F.count_if(F.col("component") > 0).alias("m0"))


@query(f"""select grp, m0, case when m0 = 0 then 0 else round(1e-4 + m0, 6) end as dof, case when m0 = 0 then 0 else round((s * m0 + 1e-4 * 1e-4) / (1e-4 + m0), 6) end as scale
from (select grp, count(*) filter (where component > 0) as m0, sum(beta * beta) as s from {GROUPED} group by grp)""")
def sigma_g_scale(d):
    g = grouped(d).groupBy("grp").agg(F.count_if(F.col("component") > 0).alias("m0"), F.sum(F.col("beta") * F.col("beta")).alias("s"))
    on = F.col("m0") > 0
    return g.select("grp", "m0", F.when(on, F.round(F.col("m0") + 1e-4, 6)).otherwise(0.0).alias("dof"), F.when(on, F.round((F.col("s") * F.col("m0") + 1e-8) / (F.col("m0") + 1e-4), 6)).otherwise(0.0).alias("scale"))


@query("select round(1e-4 + count(*), 6) as dof, round((sum(y * y) + 1e-8) / (1e-4 + count(*)), 6) as scale from ph")
def sigma_e_scale(d):
    n = F.count("*") + F.lit(1e-4)
    return d.phenotype().agg(F.round(n, 6).alias("dof"), F.round((F.sum(F.col("y") * F.col("y")) + F.lit(1e-8)) / n, 6).alias("scale"))


@query("select count(*) as n, round(sum(y) / count(*), 4) as mean, round(0.5e0 / count(*), 9) as variance from keep")
def intercept_moments(d):
    return d.individuals().agg(F.count("*").alias("n"), F.round(F.sum("y") / F.count("*"), 4).alias("mean"), F.round(F.lit(0.5) / F.count("*"), 9).alias("variance"))


COVARIATES = "(select k.ind_id, k.y, cast(c_nationkey as double) as x1, cast(coalesce(o, 0) as double) as x2 from ph k join customer on c_custkey = k.ind_id left join (select o_custkey, count(*) as o from orders group by 1) on o_custkey = k.ind_id)"


def covariates(d: Domain) -> DataFrame:
    o = d.table("orders").groupBy(F.col("o_custkey").alias("ind_id")).agg(F.count("*").cast("double").alias("x2"))
    c = d.table("customer").select(F.col("c_custkey").alias("ind_id"), F.col("c_nationkey").cast("double").alias("x1"))
    return d.phenotype().join(c, "ind_id").join(o, "ind_id", "left").withColumn("x2", F.coalesce("x2", F.lit(0.0)))


@query(f"select round(sum(x1 * (y + 0.1e0 * x1)), 4) as num1, round(sum(x2 * (y + 0.1e0 * x2)), 4) as num2 from {COVARIATES}")
def covariate_numerators(d):
    num = lambda x: F.round(F.sum(F.col(x) * (F.col("y") + 0.1 * F.col(x))), 4)
    return covariates(d).agg(num("x1").alias("num1"), num("x2").alias("num2"))


@query(f"select round(sum(x1 * fail), 4) as s1, round(sum(x2 * fail), 4) as s2 from {COVARIATES} c join fail using (ind_id)")
def covariate_failure_sums(d):
    c = covariates(d).join(d.failure(), "ind_id")
    return c.agg(F.round(F.sum(F.col("x1") * F.col("fail")), 4).alias("s1"), F.round(F.sum(F.col("x2") * F.col("fail")), 4).alias("s2"))


@query(f"select c_custkey as ind_id, round(y, 6) as y, x1, x2, fail from customer join {COVARIATES} c on c.ind_id = c_custkey join fail f on f.ind_id = c_custkey where c_nationkey <> 7")
def phen_cov_fail_join(d):
    return rounded(covariates(d).join(d.failure(), "ind_id").filter("x1 <> 7").select("ind_id", "y", "x1", "x2", "fail"), y=6)


@query("select k.ind_id, k.y, n_name from keep k join customer on c_custkey = k.ind_id join nation on c_nationkey = n_nationkey")
def phen_id_lookup(d):
    c = d.table("customer").select(F.col("c_custkey").alias("ind_id"), "c_nationkey")
    n = d.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return d.individuals().join(c, "ind_id").join(n, "c_nationkey").select("ind_id", "y", "n_name")


@query(f"select marker_id, round(0.9e0 * 2 / (0.9e0 + 2 * (0.01e0 + beta * beta)), 6) as lambda_tilde from {STEPPED}")
def horseshoe_lambda_tilde(d):
    lam = F.lit(0.01) + F.col("beta") * F.col("beta")
    return step(d).select("marker_id", F.round(0.9 * 2 / (0.9 + 2 * lam), 6).alias("lambda_tilde"))


@query(f"select grp, round(sum(beta * beta / (0.01e0 + beta * beta)), 6) as scaled from {GROUPED} group by grp")
def scaled_beta_sqnorm(d):
    b2 = F.col("beta") * F.col("beta")
    return grouped(d).groupBy("grp").agg(F.round(F.sum(b2 / (0.01 + b2)), 6).alias("scaled"))


@query("select round(avg(t), 6) as mu, round(pi() / sqrt(6 * var_samp(t)), 6) as alpha, round(var_samp(t), 6) as sigma_g from (select ln(1 + y) as t from keep)")
def weibull_init(d):
    t = d.individuals().select(F.log1p("y").alias("t"))
    a = F.lit(np.pi) / F.sqrt(6 * F.var_samp("t"))
    return t.agg(F.round(F.avg("t"), 6).alias("mu"), F.round(a, 6).alias("alpha"), F.round(F.lit(np.pi**2) / (6 * a * a), 6).alias("sigma_g"))


@query("""select g.marker_id, round(any_value(mstd) * (sum(case when d = 1 then fail when d = 2 then 2 * fail else 0 end) - any_value(mave) * any_value(sf)), 4) as sum_failure
from geno g join fail f on g.ind_id = f.ind_id join st on st.marker_id = g.marker_id, (select sum(fail) as sf from fail) group by g.marker_id""")
def failure_sums(d):
    return rounded(failures(d), sum_failure=4)


def failures(d: Domain) -> DataFrame:
    v, n = d.failure().select("ind_id", F.col("fail").cast("double").alias("f")), d.individuals().count()
    total = v.agg(F.sum("f")).first()[0] or 0.0
    s = stats.marker_dot(d.genotype(), v, n, "f")
    return s.select("marker_id", (F.col("mstd") * (F.col("s1") + 2 * F.col("s2") - F.col("mave") * F.lit(total))).alias("sum_failure"))


VI = f"(select ind_id, exp(0.8e0 * y - {EULER}e0) as v from ph)"
VSUM = f"(select g.marker_id, any_value(mave) as m, 1 / any_value(mstd) as s, any_value(sv) as sv, sum(case when d = 1 then v else 0e0 end) as v1, sum(case when d = 2 then v else 0e0 end) as v2 from geno g join {VI} v on g.ind_id = v.ind_id join st on st.marker_id = g.marker_id, (select sum(v) as sv from {VI}) group by g.marker_id)"


FSUM = """(select g.marker_id, any_value(mstd) * (sum(case when d = 1 then fail when d = 2 then 2 * fail else 0 end) - any_value(mave) * any_value(sf)) as sf
from geno g join fail f on g.ind_id = f.ind_id join st on st.marker_id = g.marker_id, (select sum(fail) as sf from fail) group by g.marker_id)"""


def vi_sums(d: Domain) -> DataFrame:
    v = d.phenotype().select("ind_id", F.exp(0.8 * F.col("y") - F.lit(EULER)).alias("v"))
    total = v.agg(F.sum("v")).first()[0] or 0.0
    s = stats.marker_dot(d.genotype(), v, d.individuals().count(), "v")
    return s.select("marker_id", F.col("mave").alias("m"), (1 / F.col("mstd")).alias("s"), F.lit(total).alias("sv"), F.col("s1").alias("v1"), F.col("s2").alias("v2"))


@query(f"select marker_id, round(sv, 4) as v_all, round(v1, 4) as v1, round(v2, 4) as v2 from {VSUM}")
def weibull_vi_sums(d):
    return rounded(vi_sums(d).select("marker_id", F.col("sv").alias("v_all"), "v1", "v2"), v_all=4, v1=4, v2=4)


GH_X, GH_W = (a.tolist() for a in np.polynomial.hermite.hermgauss(5))


def _integrand_sql(c: float) -> str:
    """sigma * sum of w * exp(x^2) * f(sigma * x), f as in the marginal likelihood, alpha 0.8, sigma_g 0.5."""
    root = float(np.sqrt(2 * c * 0.5))
    e = "((v1 * (1 - 2 * m) + 4 * (1 - m) * v2 + m * m * sv) / (s * s))"
    sg = f"(1 / sqrt(1 + 0.64e0 * 0.5e0 * {c}e0 * {e}))"
    v0 = "(sv - v1 - v2)"
    terms = [f"{float(w * np.exp(x * x))!r}e0 * exp(-0.8e0 * ({sg} * ({x!r}e0)) * {root!r}e0 * sf + sv - exp(0.8e0 * (m / s) * {sg} * ({x!r}e0) * {root!r}e0) * ({v0} + v1 * exp(-0.8e0 * {sg} * ({x!r}e0) * {root!r}e0 / s) + v2 * exp(-1.6e0 * {sg} * ({x!r}e0) * {root!r}e0 / s)) - ({sg} * ({x!r}e0)) * ({sg} * ({x!r}e0)))" for x, w in zip(GH_X, GH_W, strict=True)]
    return f"{sg} * ({' + '.join(terms)})"


@query(f"select marker_id, round(ln({_integrand_sql(0.001)}), 6) as log_like_1, round(ln({_integrand_sql(0.01)}), 6) as log_like_2 from {VSUM} join {FSUM} using (marker_id)")
def gh_marginal_likelihood(d):
    m, s, sv, v1, v2, sf = map(F.col, ("m", "s", "sv", "v1", "v2", "sum_failure"))

    def integral(c: float) -> Column:
        root = float(np.sqrt(2 * c * 0.5))
        e = (v1 * (1 - 2 * m) + 4 * (1 - m) * v2 + m * m * sv) / (s * s)
        sg = 1 / F.sqrt(1 + 0.64 * 0.5 * c * e)
        out = F.lit(0.0)
        for x, w in zip(GH_X, GH_W, strict=True):
            t = sg * x
            inner = (sv - v1 - v2) + v1 * F.exp(-0.8 * t * root / s) + v2 * F.exp(-1.6 * t * root / s)
            out = out + float(w * np.exp(x * x)) * F.exp(-0.8 * t * root * sf + sv - F.exp(0.8 * (m / s) * t * root) * inner - t * t)
        return F.log(sg * out)

    # one pass over the genotype for all sums
    people = d.phenotype().select("ind_id", F.exp(0.8 * F.col("y") - F.lit(EULER)).alias("v")).join(d.failure().select("ind_id", F.col("fail").cast("double").alias("f")), "ind_id")
    totals = people.agg(F.sum("v").alias("v"), F.sum("f").alias("f"), F.count("*").alias("n")).first()
    over = lambda c, k: F.sum(F.when(F.col("d") == k, F.col(c)).otherwise(0.0))
    count = lambda k: F.count_if(F.col("d").isNull() if k is None else F.col("d") == k)
    sums = d.genotype().join(people, "ind_id").groupBy("marker_id").agg(count(1).alias("n1"), count(2).alias("n2"), count(None).alias("nm"), over("v", 1).alias("v1"), over("v", 2).alias("v2"), (over("f", 1) + 2 * over("f", 2)).alias("fd"))
    mave, ss = stats.moments(totals.n)
    sums = sums.withColumns({"m": mave, "ss": ss}).filter("ss > 0").withColumn("s", F.sqrt(F.col("ss") / F.lit(totals.n - 1.0)))
    sums = sums.withColumns({"sv": F.lit(totals.v), "sum_failure": (F.col("fd") - F.col("m") * F.lit(totals.f)) / F.col("s")})
    return sums.select("marker_id", F.round(integral(0.001), 6).alias("log_like_1"), F.round(integral(0.01), 6).alias("log_like_2"))


@query("select iter, marker_id, component, round(beta, 6) as beta from samples where iter % 5 = 0")
def chain_thin_save(d):
    return rounded(d.samples().filter("iter % 5 = 0"), beta=6)


@query("select iter, iter // 5 as record, marker_id, round(beta, 6) as beta from samples where iter % 5 = 0 and abs(beta) > 1e-17")
def chain_nonzero_beta(d):
    return rounded(d.samples().filter("iter % 5 = 0 and abs(beta) > 1e-17").select("iter", F.expr("iter div 5").alias("record"), "marker_id", "beta"), beta=6)


@query("""select segment, iter, marker_id, round(beta, 6) as beta from (
 select s.*, seg.segment, nxt from samples s join (select 0 as segment, 0 as lo, 60 as hi, 50 as nxt union all select 1, 50, 1000000000, null) seg on s.iter >= lo and s.iter < hi)
where nxt is null or iter < nxt""")
def chain_segments_stitch(d):
    # a run stopped at 60 and taken up again from 50: of overlapping segments the later one counts
    s = d.samples()
    runs = s.filter("iter < 60").withColumn("segment", F.lit(0)).union(s.filter("iter >= 50").withColumn("segment", F.lit(1)))
    first = runs.groupBy("segment").agg(F.min("iter").alias("start"))
    nxt = first.withColumn("next", F.lead("start").over(Window.orderBy("segment")))
    kept = runs.join(F.broadcast(nxt), "segment").filter("next is null or iter < next")
    return rounded(kept.select("segment", "iter", "marker_id", "beta"), beta=6)


@query("select marker_id, count(*) as n, round(avg(case when component > 0 then 1e0 else 0e0 end), 6) as pip from samples where iter >= 20 group by marker_id")
def posterior_pip(d):
    return d.samples().filter("iter >= 20").groupBy("marker_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("component") > 0, 1.0).otherwise(0.0)), 6).alias("pip"))


@query("select marker_id, round(avg(beta) + 1e-9, 6) as mean, round(quantile_cont(beta, 0.025) + 1e-9, 6) as low, round(quantile_cont(beta, 0.975) + 1e-9, 6) as high from samples where iter >= 20 group by marker_id")
def posterior_beta_mean(d):
    p = lambda q: F.round(F.percentile("beta", q) + 1e-9, 6)  # noqa: E731  (ties of the rounding go one way)
    return d.samples().filter("iter >= 20").groupBy("marker_id").agg(F.round(F.avg("beta") + 1e-9, 6).alias("mean"), p(0.025).alias("low"), p(0.975).alias("high"))


def annotated(d: Domain) -> DataFrame:
    return d.samples().withColumn("annot", (F.col("marker_id") % 4).cast("int"))


ANNOTATED = "(select *, cast(marker_id % 4 as int) as annot from samples)"


@query(f"select iter, annot, component, round(v, 6) as v, round(sum(v) over (partition by iter, annot), 6) as v_annot from (select iter, annot, component, sum(beta * beta) as v from {ANNOTATED} group by 1, 2, 3)")
def group_variance_by_iter(d):
    v = annotated(d).groupBy("iter", "annot", "component").agg(F.sum(F.col("beta") * F.col("beta")).alias("v"))
    v = v.withColumn("v_annot", F.sum("v").over(Window.partitionBy("iter", "annot")))
    return rounded(v, v=6, v_annot=6)


@query(f"select annot, component, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from (select iter, annot, component, sum(beta * beta) as v from {ANNOTATED} group by 1, 2, 3) group by 1, 2")
def mixture_variance_ci(d):
    v = annotated(d).groupBy("iter", "annot", "component").agg(F.sum(F.col("beta") * F.col("beta")).alias("v"))
    p = lambda q: F.round(F.percentile("v", q), 6)
    return v.groupBy("annot", "component").agg(F.round(F.avg("v"), 6).alias("mean"), p(0.025).alias("low"), p(0.975).alias("high"))


@query(f"select iter, annot, component, round(sum(beta * beta), 6) as v from {ANNOTATED} group by grouping sets ((iter, annot), (iter, annot, component))")
def variance_grouping_sets(d):
    a = annotated(d).withColumn("b2", F.col("beta") * F.col("beta"))
    return rounded(a.groupingSets([["iter", "annot"], ["iter", "annot", "component"]], "iter", "annot", "component").agg(F.sum("b2").alias("v")), v=6)


@query(f"select iter, round(sum(beta * beta) / (sum(beta * beta) + 0.5e0), 6) as h2, round(sum(beta * beta) / (sum(beta * beta) + pi() * pi() / (6 * 0.64e0)), 6) as h2_weibull from samples group by iter")
def h2_trace(d):
    v = F.sum(F.col("beta") * F.col("beta"))
    return d.samples().groupBy("iter").agg(F.round(v / (v + 0.5), 6).alias("h2"), F.round(v / (v + float(np.pi**2) / (6 * 0.64)), 6).alias("h2_weibull"))


@query("select iter, marker_id, round(beta, 6) as beta from samples where marker_id = 7")
def beta_point_lookup(d):
    return rounded(d.samples().filter("marker_id = 7").select("iter", "marker_id", "beta"), beta=6)


@query("select iter, row_number() over (order by h desc, iter) as place, round(h, 6) as h from (select iter, sum(beta * beta) as h from samples group by iter) qualify place <= 10")
def largest_iterations(d):
    h = d.samples().groupBy("iter").agg(F.sum(F.col("beta") * F.col("beta")).alias("h"))
    top = h.orderBy(F.col("h").desc(), "iter").limit(10)
    return rounded(top.select("iter", F.row_number().over(Window.orderBy(F.col("h").desc(), "iter")).cast("long").alias("place"), "h"), h=6)


@query("""select g.marker_id, round(sum(coalesce(d, 0) * y), 4) as t1, round(sum(coalesce(d, 0) * case when t2 % 2 = 0 then t2 else 0 end), 4) as t2, count(*) filter (where t2 % 2 = 0) as on2
from geno g join ph on ph.ind_id = g.ind_id join (select o_custkey, count(*) as t2 from orders group by 1) o on o.o_custkey = g.ind_id group by g.marker_id""")
def multi_trait_dot(d):
    # traits side by side: one join and one aggregate for all, a mask for each
    o = d.table("orders").groupBy(F.col("o_custkey").alias("ind_id")).agg(F.count("*").alias("t2"))
    g = d.genotype().join(d.phenotype().join(o, "ind_id"), "ind_id")
    x, on = F.coalesce("d", F.lit(0)), F.col("t2") % 2 == 0
    return g.groupBy("marker_id").agg(F.round(F.sum(x * F.col("y")), 4).alias("t1"), F.round(F.sum(x * F.when(on, F.col("t2")).otherwise(0)).cast("double"), 4).alias("t2"), F.count_if(on).alias("on2"))


PLACED = "(select g.marker_id, g.d, i.ind from geno g join (select ind_id, row_number() over (order by ind_id) - 1 as ind from keep) i on g.ind_id = i.ind_id)"


def placed(d: Domain) -> tuple[DataFrame, DataFrame, int]:
    """Cells by dense number (marker_id, ind, d), the numbers, and how many there are."""
    index = stats.dense_index(d.individuals().select("ind_id"), "ind_id", "ind").select("ind_id", F.col("ind").cast("int").alias("ind"))
    return d.genotype().join(index, "ind_id").select("marker_id", "ind", "d"), index, index.count()


def digest(cells: Column) -> Column:
    """Of cells (ind, d), in the order of individuals."""
    return F.md5(F.array_join(F.transform(F.sort_array(cells), lambda c: F.concat_ws(":", c["ind"].cast("string"), c["d"].cast("string"))), ","))


@query(f"select marker_id, count(*) as cells, md5(string_agg(ind || ':' || coalesce(d, 9), ',' order by ind)) as digest from {PLACED} group by marker_id")
def bed_pack_roundtrip(d):
    # the rows are packed in tiles: whole ones take individuals times markers
    from ..operators import packed

    back = packed.tile_lists(placed(d)[0])
    cells = F.zip_with("ind", "d", lambda i, x: F.concat_ws(":", i.cast("string"), F.coalesce(x, F.lit(9)).cast("string")))
    return back.select("marker_id", F.size("ind").cast("long").alias("cells"), F.md5(F.array_join(cells, ",")).alias("digest"))


@query("""select g.marker_id, round(any_value(mstd) * (sum(case when d = 1 then f when d = 2 then 2 * f else 0 end) - any_value(mave) * (any_value(sf) - sum(case when d is null then f else 0 end))), 4) as num
from geno g join (select ind_id, cast(fail as double) as f from fail) f on g.ind_id = f.ind_id join st on st.marker_id = g.marker_id, (select sum(fail) as sf from fail) group by g.marker_id""")
def bed_dot(d):
    # the product of each column with the failures, straight from packed bytes
    from ..operators import packed

    geno, index, n = placed(d)
    v = stats.vector(d.failure().join(index, "ind_id").select("ind", F.col("fail").alias("f")), "ind", "f", n)  # a double per individual
    return rounded(packed.tile_products(geno, v).select("marker_id", "num"), num=4)


@query("""select k.ind_id, round(coalesce(s, 0) - flat, 6) as delta_eps from keep k
left join (select ind_id, sum(case when d is null then a * mave else a * d end) as s from geno g join (select marker_id, mave, mstd * (marker_id % 7 - 3) / 100e0 as a from st) m on g.marker_id = m.marker_id group by ind_id) x on k.ind_id = x.ind_id,
(select sum(mstd * (marker_id % 7 - 3) / 100e0 * mave) as flat from st)""")
def bed_delta(d):
    # the residual's change, straight from packed bytes: all markers are packed
    from ..operators import chain

    geno, index, n = placed(d)
    change = chain.packed_change(geno, delta(d).filter("delta_beta <> 0"), n)
    return index.join(change, "ind").select("ind_id", F.round("delta_eps", 6).alias("delta_eps"))


@query("""select marker_id, n1, n2, nm, (n1 + n2 + nm) / cast(n as double) > 0.022 as use_bed, round(avg(case when (n1 + n2 + nm) / cast(n as double) > 0.022 then 1e0 else 0e0 end) over (), 6) as share from cnt, nn""")
def mixed_scan(d):
    # lists or packed rows by share, as the chains keep them, and the share of packed ones
    from ..operators import chain

    geno, _, n = placed(d)
    table = chain.represented(chain.every_list(geno), n, 0.022).select("marker_id", "n1", "n2", "nm", F.col("packed").isNotNull().alias("use_bed"))
    share = table.agg(F.round(F.avg(F.col("use_bed").cast("double")), 6).alias("share"))
    return table.join(F.broadcast(share))  # a row


@query(f"""select p_partkey as marker_id, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, coalesce(nm, 0) as nm, md5(coalesce(cells, '')) as digest from part
left join (select marker_id, string_agg(ind || ':' || coalesce(d, 9), ',' order by ind) as cells from {PLACED} group by marker_id) c on c.marker_id = p_partkey left join cnt on cnt.marker_id = p_partkey""")
def bed_to_sparse(d):
    # packed genotype file, sparse set made of it in two passes, and the set read again: all markers, also those without a cell
    from ..sources import bed, sparse
    from ..sources.scratch import shared_home

    geno, _, n = placed(d)
    markers, base = (d.table("part").agg(F.max("p_partkey")).first()[0] or -1) + 1, shared_home(d.spark)
    bed.write_bed(geno, f"{base}/g.bed", n, markers)
    sparse.bed_to_sparse(d.spark, f"{base}/g.bed", f"{base}/g", n)
    d.spark.dataSource.register(sparse.SparseSource)
    lists = d.spark.read.format("sparsegeno").load(f"{base}/g")
    of = lambda name, k: F.transform(name, lambda i: F.struct(i.alias("ind"), F.lit(k).alias("d")))
    lists = lists.select("marker_id", *(F.size(a).cast("long").alias(b) for a, b in (("one", "n1"), ("two", "n2"), ("miss", "nm"))), digest(F.concat(of("one", 1), of("two", 2), of("miss", 9))).alias("digest"))
    return d.table("part").select(F.col("p_partkey").alias("marker_id")).join(lists, "marker_id")


@query("""select iter, round(sum(beta), 6) as mu, round(sum(beta * beta), 6) as sigma_g, round(pi() / sqrt(6 * (1 + count(*))), 6) as alpha, cast(count(*) filter (where component > 0) as int) as m0 from samples group by iter""")
def history_roundtrip(d):
    # a line per sweep of the survival model's file, added by the writer in two commits of which the second takes up inside the first
    from ..sources import history
    from ..sources.scratch import shared_home

    b2 = F.col("beta") * F.col("beta")
    h = d.samples().groupBy(F.col("iter").cast("int").alias("iter")).agg(F.sum("beta").alias("mu"), F.array(F.sum(b2)).alias("sigma_g"), F.lit(0.5).alias("sigma_e"), (F.lit(float(np.pi)) / F.sqrt(6.0 * (1 + F.count("*")))).alias("alpha"), F.lit(0.5).alias("h2"), F.count_if(F.col("component") > 0).cast("int").alias("m0"))
    h = h.withColumns({"pi": F.array(F.array(F.lit(0.5), F.lit(0.5))), "gamma": F.array().cast("array<double>"), "iter": F.col("iter") + 1}).select("iter", "mu", "sigma_g", "sigma_e", "alpha", "h2", "m0", "pi", "gamma")
    d.spark.dataSource.register(history.HistorySource)
    path, half = f"{shared_home(d.spark)}/h.csv", h.agg((F.max("iter") / 2).cast("int")).first()[0] or 0
    for part in (h.filter(F.col("iter") <= half + 3).withColumn("mu", F.when(F.col("iter") > half, -1.0).otherwise(F.col("mu"))), h.filter(F.col("iter") > half)):
        part.write.format("chainhistory").option("model", "weibull").mode("append").save(path)
    back = d.spark.read.format("chainhistory").option("model", "weibull").load(path)
    return rounded(back.select((F.col("iter") - 1).cast("long").alias("iter"), "mu", F.col("sigma_g")[0].alias("sigma_g"), "alpha", "m0"), mu=6, sigma_g=6, alpha=6)


@query("select (select count(*) from keep) as individuals, (select count(*) from part) as markers, (select cast(sum(n1) as bigint) from cnt) as n1, (select cast(sum(n2) as bigint) from cnt) as n2, (select cast(sum(nm) as bigint) from cnt) as nm")
def dimensions(d):
    c = stats.class_counts(d.genotype()).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("nm").alias("nm"))
    return c.select(F.lit(d.individuals().count()).alias("individuals"), F.lit(d.table("part").count()).alias("markers"), "n1", "n2", "nm")


@query("""select k.ind_id, round(coalesce(s, 0) - flat, 6) as delta_eps from keep k
left join (select ind_id, sum(case when d is null then a * mave else a * d end) as s from geno g join (select marker_id, mave, mstd * (marker_id % 7 - 3) / 100e0 as a from st) m on g.marker_id = m.marker_id group by ind_id) x on k.ind_id = x.ind_id,
(select sum(mstd * (marker_id % 7 - 3) / 100e0 * mave) as flat from st)""")
def delta_eps_allreduce(d):
    # the change of the residual from the block kernel of the chains: a partial vector per task, added up by parts of the vector
    from ..operators import chain

    geno, index, n = chain.indexed(d.genotype(), d.individuals().select("ind_id"))
    moved = delta(d).filter("delta_beta <> 0")
    change = chain.residual_change(chain.marker_lists(geno, n), moved, n)
    return index.join(change, "ind").select("ind_id", F.round("delta_eps", 6).alias("delta_eps"))


MIXTURES = "(select cast(p_size % 2 as int) as grp, cast(k as int) as k, case when k = 0 then 0e0 else (p_size % 2 + 1) * pow(10e0, k - 4) end as cva, count(*) as markers from part, (select unnest([0, 1, 2, 3]) as k) group by 1, 2, 3)"


def mixtures(d: Domain) -> DataFrame:
    """grp, k, cva, markers: the mixture of each group of markers, the zero component first."""
    g = d.table("part").groupBy((F.col("p_size") % 2).cast("int").alias("grp")).agg(F.count("*").alias("markers"))
    k = g.select("grp", "markers", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    cva = F.when(F.col("k") == 0, 0.0).otherwise((F.col("grp") + 1) * F.pow(F.lit(10.0), F.col("k") - 4))
    return k.select("grp", "k", F.when((F.col("k") == 0) | (cva > 0), cva).otherwise(F.raise_error(F.lit("a mixture variance is not positive")).cast("double")).alias("cva"), "markers")


@query(f"select grp, k, round(cva, 6) as cva, markers from {MIXTURES}")
def mixture_table(d):
    return rounded(mixtures(d), cva=6)


@query(f"select grp, k, round(case when k = 0 then 0.5e0 else 0.5e0 * cva / sum(cva) over (partition by grp) end, 6) as pi from {MIXTURES}")
def prior_pi_init(d):
    share = 0.5 * F.col("cva") / F.sum("cva").over(Window.partitionBy("grp"))
    return mixtures(d).select("grp", "k", F.round(F.when(F.col("k") == 0, 0.5).otherwise(share), 6).alias("pi"))


GRID = "(select unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) as x)"


@query(f"""select x, round(-0.8e0 * x * any_value(fails) - sum(exp(0.8e0 * (y - x) - {EULER}e0)) - x * x / 200, 4) as log_mu,
round((0.01e0 + any_value(fails) - 1) * ln(x) + x * (any_value(ef) - 0.01e0) - sum(exp(x * y - {EULER}e0)), 4) as log_alpha,
round(-0.8e0 * x * any_value(cf) - sum(exp(0.8e0 * (y - x1 / 25 * x) - {EULER}e0)) - x * x / 200, 4) as log_gamma
from (select ph.*, cast(c_nationkey as double) as x1 from ph join customer on c_custkey = ind_id), {GRID},
(select sum(fail) as fails, sum(fail * y) as ef, sum(fail * c_nationkey / 25e0) as cf from fail join ph using (ind_id) join customer on c_custkey = ind_id) group by x""")
def weibull_density_grid(d):
    # log densities of the intercept, the shape and a covariate's effect, as the survival chain evaluates them, over a grid
    t = d.phenotype().join(d.failure(), "ind_id").join(d.table("customer").select(F.col("c_custkey").alias("ind_id"), (F.col("c_nationkey") / F.lit(25.0)).alias("x1")), "ind_id")
    fails = t.agg(F.sum("fail").alias("n"), F.sum(F.col("fail") * F.col("y")).alias("ef"), F.sum(F.col("fail") * F.col("x1")).alias("cf"))
    x, y = F.col("x"), F.col("y")
    sums = t.select("y", "x1", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))).alias("x")).groupBy("x").agg(
        F.sum(F.exp(0.8 * (y - x) - EULER)).alias("mu"), F.sum(F.exp(x * y - EULER)).alias("alpha"), F.sum(F.exp(0.8 * (y - F.col("x1") * x) - EULER)).alias("gamma"))
    sums = sums.join(F.broadcast(fails))  # a row of totals
    return sums.select(
        "x", F.round(-0.8 * x * F.col("n") - F.col("mu") - x * x / 200, 4).alias("log_mu"),
        F.round((0.01 + F.col("n") - 1) * F.ln(x) + x * (F.col("ef") - 0.01) - F.col("alpha"), 4).alias("log_alpha"),
        F.round(-0.8 * x * F.col("cf") - F.col("gamma") - x * x / 200, 4).alias("log_gamma"))


@query("""select iter, cast(2 as int) as num_groups, round(sum(case when marker_id % 2 = 0 then beta * beta else 0 end), 9) as sigma_g_1, round(sum(case when marker_id % 2 = 1 then beta * beta else 0 end), 9) as sigma_g_2,
cast(0.5 as double) as sigma_e, round(sum(beta * beta) / (sum(beta * beta) + 0.5e0), 9) as h2, cast(count(*) filter (where component > 0) as int) as num_markers from samples group by iter""")
def hyper_header(d):
    # lines of the chain's text file, written in its format and read back with names and types
    from ..sources import chain_files

    b2, odd = F.col("beta") * F.col("beta"), F.col("marker_id") % 2
    h = d.samples().groupBy("iter").agg(F.array(F.sum(F.when(odd == 0, b2).otherwise(0.0)), F.sum(F.when(odd == 1, b2).otherwise(0.0))).alias("sigma_g"), F.sum(b2).alias("v"), F.count_if(F.col("component") > 0).alias("m0"))
    h = h.select("iter", "sigma_g", F.lit(0.5).alias("sigma_e"), (F.col("v") / (F.col("v") + 0.5)).alias("h2"), "m0", F.array(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.25), F.lit(0.75))).alias("pi"))
    back = chain_files.parse_hyper(chain_files.hyper_lines(h))
    return back.select("iter", "num_groups", F.round(F.col("sigma_g")[0], 9).alias("sigma_g_1"), F.round(F.col("sigma_g")[1], 9).alias("sigma_g_2"), "sigma_e", F.round("h2", 9).alias("h2"), F.col("m0").alias("num_markers"))


@query("select iter, marker_id, round(beta, 6) as beta, component, p_name as snp, cast(p_size % 2 as int) as grp from samples left join part on p_partkey = marker_id where iter >= 5")
def beta_bim_group_join(d):
    p = d.table("part").select(F.col("p_partkey").alias("marker_id"), F.col("p_name").alias("snp"), (F.col("p_size") % 2).cast("int").alias("grp"))
    return rounded(d.samples().filter("iter >= 5").join(p, "marker_id", "left").select("iter", "marker_id", "beta", "component", "snp", "grp"), beta=6)


@query("""select marker_id, p_name || ':' || p_partkey as snp, round((p_partkey % 7 - 3) / 100e0, 6) as truth, round(avg(beta) + 1e-9, 6) as mean from samples join part on p_partkey = marker_id
where p_partkey % 5 = 0 group by marker_id, p_name, p_partkey""")
def causal_effects_join(d):
    # effects that are known by the marker's name, beside those of the chain
    p = d.table("part").select(F.col("p_partkey").alias("marker_id"), F.concat_ws(":", "p_name", "p_partkey").alias("snp"))
    known = delta(d).filter("marker_id % 5 = 0").join(p, "marker_id").select("snp", F.col("delta_beta").alias("truth"))
    means = d.samples().groupBy("marker_id").agg((F.avg("beta") + 1e-9).alias("mean"))
    return rounded(means.join(p, "marker_id").join(known, "snp").select("marker_id", "snp", "truth", "mean"), truth=6, mean=6)


@query(f"""select node, count(distinct block) as tasks, cast(sum(bytes) as bigint) as bytes, sum(bytes) = max(sum(bytes)) over () as most, sum(bytes) = min(sum(bytes)) over () as least
from (select block, case when block < 3 then 0 else 1 + (block - 3) // 2 end as node, coalesce(4 * (n1 + n2 + nm), 0) as bytes from {BLOCKS} b left join cnt on cnt.marker_id = b.m) group by node""")
def ram_check(d):
    # seven tasks, at most three a node: the first nodes are full, the others take one less
    p = d.table("part").select(F.col("p_partkey").alias("marker_id"))
    b = p.withColumn("block", stats.block_of(F.col("marker_id"), p.count(), 7)).join(stats.class_counts(d.genotype()), "marker_id", "left")
    size = F.coalesce(4 * (F.col("n1") + F.col("n2") + F.col("nm")), F.lit(0))
    nodes = b.groupBy("block").agg(F.sum(size).alias("bytes")).groupBy(stats.node_of(F.col("block"), 7, 3).alias("node")).agg(F.count("*").alias("tasks"), F.sum("bytes").alias("bytes"))
    every = nodes.agg(F.max("bytes").alias("high"), F.min("bytes").alias("low"))
    return nodes.join(F.broadcast(every)).select("node", "tasks", "bytes", (F.col("bytes") == F.col("high")).alias("most"), (F.col("bytes") == F.col("low")).alias("least"))


TRAITS = """(select c_custkey as ind_id, 0 as trait, case when c_acctbal >= 0 then c_acctbal end as y from customer
 union all select c_custkey, 1, case when o % 3 <> 0 then cast(o as double) end from (select c_custkey, count(o_orderkey) as o from customer left join orders on o_custkey = c_custkey group by 1))"""
TRAIT_CELLS = """(select c.ind_id, c.marker_id, case when mis = 1 then null when c.c >= 2 then 2 else 1 end as d from cells c)"""


@query(f"""select marker_id, cast(trait as int) as trait, n1, n2, nm, round(mave, 6) as mave, round(sqrt((n - 1) / ss) * (s1 + 2 * s2 - mave * (total - sm)), 4) as num from (
select *, n1 * (1 - mave) * (1 - mave) + n2 * (2 - mave) * (2 - mave) + (n - nm - n1 - n2) * mave * mave as ss from (select *, (n1 + 2 * n2) / cast(n - nm as double) as mave from (
select marker_id, trait, any_value(n) as n, any_value(total) as total, count(*) filter (where d = 1) as n1, count(*) filter (where d = 2) as n2, count(*) filter (where d is null) as nm,
 coalesce(sum(z) filter (where d = 1), 0) as s1, coalesce(sum(z) filter (where d = 2), 0) as s2, coalesce(sum(z) filter (where d is null), 0) as sm
from {TRAIT_CELLS} g join (select ind_id, trait, (y - avg(y) over (partition by trait)) / stddev_samp(y) over (partition by trait) as z, count(*) over (partition by trait) as n from {TRAITS} where y is not null) t on t.ind_id = g.ind_id
 join (select 0e0 as total) on true group by marker_id, trait))) where ss > 0""")
def multi_trait_scan(d):
    # each trait under its own mask: counts, mean, scale and product of a marker's column
    cells = d.cells().select("ind_id", "marker_id", "d")
    return rounded(stats.trait_dots(cells, d.traits()).select("marker_id", "trait", "n1", "n2", "nm", "mave", "num"), mave=6, num=4)


@query(f""", known as (select ind_id, trait, count(*) over (partition by trait) as n from {TRAITS} where y is not null),
held as (select g.*, t.trait, t.n from {TRAIT_CELLS} g join known t on t.ind_id = g.ind_id),
scaled as (select marker_id, trait, mave, sqrt((n - 1) / ss) * (marker_id % 7 - 3) / 100e0 as a from (
 select *, n1 * (1 - mave) * (1 - mave) + n2 * (2 - mave) * (2 - mave) + (n - nm - n1 - n2) * mave * mave as ss from (select *, (n1 + 2 * n2) / cast(n - nm as double) as mave from (
 select marker_id, trait, any_value(n) as n, count(*) filter (where d = 1) as n1, count(*) filter (where d = 2) as n2, count(*) filter (where d is null) as nm from held group by marker_id, trait)))
 where ss > 0 and marker_id % 7 <> 3)
select k.ind_id, cast(k.trait as int) as trait, round(coalesce(s, 0) - coalesce(flat, 0), 6) as delta_eps from known k
left join (select ind_id, g.trait, sum(case when d is null then a * mave else a * d end) as s from held g join scaled c on c.marker_id = g.marker_id and c.trait = g.trait group by ind_id, g.trait) x on x.ind_id = k.ind_id and x.trait = k.trait
left join (select trait, sum(a * mave) as flat from scaled group by trait) f on f.trait = k.trait""")
def multi_trait_delta(d):
    # the change of each trait's residual under its own mask and scale
    from ..operators import multi_trait

    return rounded(multi_trait.trait_changes(d.cells().select("ind_id", "marker_id", "d"), d.traits(), delta(d)), delta_eps=6)


def multi_trait_run_short(spark, sf_dir):
    """Two sweeps of the chains of two traits; the hyper-parameters of each. Random draws: rows are checked by invariants in the tests."""
    from ..operators import chain, multi_trait

    d = Domain(spark, sf_dir)
    known = d.traits().filter("y is not null").groupBy("trait").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))
    y = d.traits().join(F.broadcast(known), "trait").select("ind_id", "trait", ((F.col("y") - F.col("m")) / F.col("s")).alias("y"))  # a row per trait
    _, trace, _ = multi_trait.run(spark, d.cells().select("ind_id", "marker_id", "d"), y, 2, chain.Settings(windows=2))
    rows = [(h.iteration, t, h.mu, h.sigma_g[0], h.sigma_e, h.m0, h.h2) for each in trace for t, h in enumerate(each)]
    return spark.createDataFrame(rows, "iter int, trait int, mu double, sigma_g double, sigma_e double, m0 int, h2 double")


QUERIES["multi_trait_run_short"] = multi_trait_run_short


def run_from_files(spark, sf_dir):
    """A run by options over files that Spark writes from the tables: packed genotype, individuals, phenotypes, groups. The lines of its
    history. Random draws: the files are checked in the tests."""
    from .. import run
    from ..config import RunConfig
    from ..sources import bed, history
    from ..sources.scratch import shared_home

    d, base = Domain(spark, sf_dir), shared_home(spark)
    geno, index, n = placed(d)
    markers = (d.table("part").agg(F.max("p_partkey")).first()[0] or -1) + 1
    bed.write_bed(geno, f"{base}/g.bed", n, markers)
    y = d.individuals().join(index, "ind_id").repartitionByRange("ind").sortWithinPartitions("ind")
    y.select(F.concat(F.lit("f i"), "ind", F.lit(" 0 0 1 -9"))).write.text(f"{base}/fam")
    y.select(F.concat(F.lit("f i"), "ind", F.lit(" "), F.col("y").cast("string"))).write.text(f"{base}/phen")
    c = RunConfig(bed_file=f"{base}/g.bed", fam_file=f"{base}/fam", phenotype_file=f"{base}/phen", out=f"{base}/out", chain_length=2, save=2, windows=2)
    run.run(spark, c)
    return spark.read.format("chainhistory").load(f"{base}/out.csv").select("iter", "sigma_g", "sigma_e", "h2", "m0")


QUERIES["run_from_files"] = run_from_files


def gibbs_run_short(spark, sf_dir):
    """Three sweeps of the Gaussian chain; the hyper-parameters of each. Random draws: rows are checked by invariants in the tests."""
    from ..operators import gibbs
    from ..sources.scratch import saver

    d = Domain(spark, sf_dir)
    _, trace = gibbs.run(d.genotype(), d.phenotype(), 3, gibbs.Settings(windows=2), saver(spark))
    rows = [(h.iteration, h.mu, h.sigma_g, h.sigma_e, h.m0, h.h2) for h in trace]
    return spark.createDataFrame(rows, "iter int, mu double, sigma_g double, sigma_e double, m0 int, h2 double")


QUERIES["gibbs_run_short"] = gibbs_run_short


def horseshoe_run_short(spark, sf_dir):
    """Two sweeps of the horseshoe chain; the hyper-parameters of each. Random draws: rows are checked by invariants in the tests."""
    from ..operators import horseshoe
    from ..sources.scratch import saver

    d = Domain(spark, sf_dir)
    _, trace = horseshoe.run(d.genotype(), d.phenotype(), 2, horseshoe.Settings(windows=2), saver(spark))
    rows = [(h.iteration, h.mu, h.sigma_g, h.sigma_e, h.tau, h.slab, h.m0, h.h2) for h in trace]
    return spark.createDataFrame(rows, "iter int, mu double, sigma_g double, sigma_e double, tau double, slab double, m0 int, h2 double")


QUERIES["horseshoe_run_short"] = horseshoe_run_short


def groups_run_short(spark, sf_dir):
    """Three sweeps of the Gaussian chain with two groups, priors of their own and two covariates, over blocks of markers; a row of hyper-parameters
    per sweep. Random draws: rows are checked by invariants in the tests."""
    from ..operators import chain

    d = Domain(spark, sf_dir)
    groups = d.table("part").select(F.col("p_partkey").alias("marker_id"), (F.col("p_size") % 2).cast("int").alias("grp"))
    x = covariates(d).select("ind_id", F.array(F.col("x1") / 25.0, F.col("x2") / 20.0).alias("x"))
    s = chain.Settings(windows=2, mixture=((0.001, 0.01, 0.1), (0.002, 0.02, 0.2)), priors=((1e-4, 1e-4), (2.0, 0.01)), dirichlet=((1.0,) * 4, (2.0, 1.0, 1.0, 1.0)))
    _, trace, _ = chain.run(spark, d.genotype(), d.phenotype(), 3, s, groups=groups, covariates=x)
    rows = [(h.iteration, h.mu, list(h.sigma_g), h.sigma_e, list(h.gamma), h.m0, h.h2) for h in trace]
    return spark.createDataFrame(rows, "iter int, mu double, sigma_g array<double>, sigma_e double, gamma array<double>, m0 int, h2 double")


QUERIES["groups_run_short"] = groups_run_short


def weibull_run_short(spark, sf_dir):
    """Three sweeps of the survival chain; the hyper-parameters of each. Random draws: rows are checked by invariants in the tests."""
    from ..operators import chain, weibull

    d = Domain(spark, sf_dir)
    y = d.individuals().select("ind_id", F.log1p("y").alias("y"))
    _, trace, _ = chain.run(spark, d.genotype(), y, 3, chain.Settings(windows=2), fail=d.failure(), model=weibull.Weibull)
    rows = [(h.iteration, h.mu, h.alpha, list(h.sigma_g), h.m0, h.h2) for h in trace]
    return spark.createDataFrame(rows, "iter int, mu double, alpha double, sigma_g array<double>, m0 int, h2 double")


QUERIES["weibull_run_short"] = weibull_run_short

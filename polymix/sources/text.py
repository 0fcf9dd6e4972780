"""Readers of the positional text files: no headers, columns parted by blanks, ``NA`` or ``-9`` where a value is missing.

Line numbers stand for individuals or markers where files are aligned by position; counts per piece of a file give them, without a sort. Rows with a missing value stay as nulls; ``complete`` drops them and numbers the rest anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import dense_index, prefix

FAM = ("fid", "iid", "dad", "mom", "sex")
BIM = ("chrom", "snp", "gen_pos", "phys_pos", "a1", "a2")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, f (fields): blank lines don't count. A piece is what one task reads of a file; lines of a piece come in their order."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), "value")
    sizes = rows.groupBy("file", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # a row per piece, of 128 MB as a rule
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r.file, r.piece, total - r.first))
        total += r.n
    shift = spark.createDataFrame(before, "file string, piece long, shift long")
    # blank lines take no number: ids are given after they are gone, and rise by one within a piece
    found = rows.join(F.broadcast(shift), ["file", "piece"])
    return found.select((F.col("at") + F.col("shift")).alias("line"), F.split(F.trim("value"), r"\s+").alias("f"))


def _checked(df: DataFrame, key: str, width: int) -> DataFrame:
    """Fails where a line is short or an id comes twice (known only when the rows are used)."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} comes twice")
    return df.withColumn("f", F.when(F.size("f") >= width, F.col("f")).otherwise(F.raise_error(F.lit("a line has too few columns"))))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    df = lines(spark, path).withColumn("id", F.concat_ws(":", F.col("f")[0], F.col("f")[1]))
    df = _checked(df, "id", 6)
    return df.select(F.col("line").cast("int").alias("ind_id"), "id", *(F.col("f")[i].alias(c) if c != "sex" else F.col("f")[i].cast("int").alias(c) for i, c in enumerate(FAM)))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    df = _checked(lines(spark, path).withColumn("snp", F.col("f")[1]), "snp", 6)
    f = lambda i, t: F.col("f")[i].cast(t).alias(BIM[i])
    return df.select(F.col("line").cast("int").alias("marker_id"), f(0, "int"), f(1, "string"), f(2, "float"), f(3, "int"), f(4, "string"), f(5, "string"))


def _number(c):
    return F.when(~c.isin("NA", "-9"), c.cast("double"))


def read_phen(spark: SparkSession, path: str) -> DataFrame:
    y = F.when(F.col("f")[2] != "NA", F.col("f")[2].cast("double"))
    return lines(spark, path).select(F.col("line").cast("int").alias("ind_id"), F.concat_ws(":", F.col("f")[0], F.col("f")[1]).alias("id"), y.alias("y"))


def read_cov(spark: SparkSession, path: str) -> DataFrame:
    x = F.transform(F.slice("f", 3, F.size("f")), lambda v: F.when(v != "NA", v.cast("double")))
    return lines(spark, path).select(F.col("line").cast("int").alias("ind_id"), x.alias("x"))


def read_fail(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line").cast("int").alias("ind_id"), _number(F.col("f")[0]).alias("fail"))


def by_id(phen: DataFrame, fam: DataFrame) -> DataFrame:
    """Phenotypes of known individuals, numbered as in the fam file."""
    return phen.select("id", "y").join(fam.select("id", "ind_id"), "id")


def complete(phen: DataFrame, *others: DataFrame) -> DataFrame:
    """Join by line, drop rows with anything missing, and number the rest densely as ``new_id``."""
    df = phen
    for o in others:
        df = df.join(o, "ind_id")
    for c, t in df.dtypes:
        df = df.filter(F.col(c).isNotNull() if not t.startswith("array") else F.forall(c, lambda v: v.isNotNull()))
    return dense_index(df, "ind_id", "new_id")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """One number per marker, whatever blanks or line ends part them."""
    rows = prefix(lines(spark, path), "line", F.size("f"), "start").select("start", F.posexplode("f").alias("i", "grp"))
    return rows.select((F.col("start") + F.col("i")).cast("long").alias("marker_id"), F.col("grp").cast("int").alias("grp"))


def _table(text: str) -> list[list[float]]:
    rows = [[float(x) for x in r.split(",") if x.strip()] for r in text.strip().split(";") if r.strip()]
    if not rows or len({len(r) for r in rows}) != 1:
        raise ValueError("groups differ in length")
    return rows


def read_small(spark: SparkSession, path: str) -> list[list[float]]:
    """``a,b;c,d``: a row per group (priors, Dirichlet priors)."""
    rows = spark.read.text(path).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 lines")
    return _table("".join(r.value for r in rows))


def read_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """grp, k, cva: component 0 has variance 0; others must be positive."""
    rows = read_small(spark, path)
    if min(map(min, rows)) <= 0:
        raise ValueError("a mixture variance is not positive")
    return spark.createDataFrame([(g, k, v) for g, r in enumerate(rows) for k, v in enumerate([0.0, *r])], "grp int, k int, cva double")


def read_phenotypes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ind_id, trait, y of a file per trait, null where a trait is missing: each trait has a mask of its own."""
    one = lambda i, p: read_phen(spark, p).select("ind_id", F.lit(i).alias("trait"), "y")
    out = one(0, paths[0])
    for i, p in enumerate(paths[1:], 1):
        out = out.unionByName(one(i, p))
    return out


def read_priors(spark: SparkSession, path: str) -> tuple[tuple[float, float], ...]:
    """v0 and s0 of each group."""
    rows = read_small(spark, path)
    if any(len(r) != 2 for r in rows):
        raise ValueError("a group's priors are two numbers")
    return tuple((a, b) for a, b in rows)


def read_dirichlet(spark: SparkSession, path: str) -> tuple[tuple[float, ...], ...]:
    """A weight per component, the zero component first, for each group."""
    return tuple(tuple(r) for r in read_small(spark, path))


def read_blocks(spark: SparkSession, path: str, markers: int) -> DataFrame:
    """block, start, end: 1-based, inclusive, contiguous, from 1 to ``markers``. A block meets the next one by its number."""
    if spark.read.text(path).filter(F.trim("value") != "").filter(~F.col("value").rlike("^[0-9]+ [0-9]+$")).limit(1).count():
        raise ValueError("a block is two numbers and one space")
    rows = lines(spark, path).select(F.col("line").cast("int").alias("block"), F.col("f")[0].cast("int").alias("start"), F.col("f")[1].cast("int").alias("end"))
    after = rows.select((F.col("block") - 1).alias("block"), F.col("start").alias("next"))
    last = rows.join(after, "block", "left").agg(
        F.min(F.when(F.col("block") == 0, F.col("start"))).alias("first"), F.max(F.when(F.col("next").isNull(), F.col("end"))).alias("last"),
        F.count_if((F.col("start") > F.col("end")) | (F.col("next") != F.col("end") + 1)).alias("bad")).first()
    if last.bad:
        raise ValueError("blocks overlap, leave gaps or end before they start")
    if last.first != 1 or last.last != markers:
        raise ValueError("blocks don't cover the markers")
    return rows

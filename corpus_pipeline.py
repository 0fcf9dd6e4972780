"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from polymix.llm import exact_dedup, langid, ngram_join, packing, pii
from polymix.llm.common import discard, saved, settled, sized
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected below this score, or without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes the prediction. Where nothing could be learnt, all pass as they are."""
    settled(spark)
    model = langid.fit(docs, F.lit(True))
    if model is None:
        return docs.select(*COLUMNS)
    found = langid.predict(docs, model, keep=tuple(docs.columns))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, also where rows repeat an id and a text or have no id. The stream reads files, so the
    stage's input goes to the shared folder first."""
    held = saved(docs, "docs")
    found = exact_dedup.exact_dedup(spark, held.saved_at, text=True)
    kept = saved(found.filter("kept").select(*COLUMNS, "text_sha256", F.monotonically_increasing_id().alias("_row")), "kept")
    discard(held)
    first = kept.groupBy("text_sha256").agg(F.min("_row").alias("_row"), F.count("*").alias("n"))
    if first.filter("n > 1").limit(1).count():
        kept = kept.join(sized(first.select("_row"), 16), "_row", "left_semi")
    return kept.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that gives the group its id, told by its id and text."""
    stay = saved(ngram_join.placed(docs, width=5, percent=80).filter("stays").select("doc_id", "key"), "stay").distinct()
    stay = sized(stay, 40)
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.doc_id) & (ngram_join.text_key() == stay.key), "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    settled(spark)
    found = pii.scan_pii(docs, keep=tuple(docs.columns))
    text = F.when(F.col("text").isNotNull(), F.col("masked"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("pii", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the field and the plan have no SQL.
ORACLE_SQL = None

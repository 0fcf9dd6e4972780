"""Exact dedup as a stateful stream.

The stream keys every document by the SHA-256 of its text. RocksDB holds one state per digest, without expiry: the
digest, the stable identifier of the row that stays (largest doc_id), the locator of the content first seen (file and row) and a
count. State, updates and the list of what was compared lie in a store that the caller may name: a later call on it reads only the files
that came since, and adds to the states. Updates and files count as compared once the comparison's result is written, so a call that was
stopped before leaves them to the next one.

A digest alone decides nothing. Where a call hits a state, the bytes of its new rows and those at the state's locator are
compared: only new files and the files that locators name are read for it, and of these only rows of digests that were hit. Should
two texts share a digest, they are grouped by the text itself from then on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, sized, whole_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADDED = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "digest", "n", "_keep", "_bytes")

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files below ``path``; none if nothing was written yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _name(file: Column) -> Column:
    """A file's name in one form: scans and listings differ in the slashes after the scheme."""
    return F.regexp_replace(file, "^([A-Za-z0-9+.-]+):/+", "$1:/")


STATE = "digest binary, id long, file string, row long, n long"
#: A file whose rows were compared, or the number of a micro-batch up to which states were.
COMPARED = "file string, batch long"


def digest_states(spark: SparkSession, path: str, store: str, digest: Digest = sha256, files: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Run the stream over the Parquet files at ``path`` that ``store`` has not seen, until all are read; returns a row per digest
    (digest, keep_id, file, row, n) of all states, and the states that changed and have not been compared yet, with ``batch``. ``files``
    bounds a micro-batch."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    still = spark.read.parquet(path)
    files_read = still.inputFiles()
    # a stream takes a folder or a pattern: a single file is named by a pattern that only it matches
    source = f"{path[:-1]}[{path[-1]}]" if len(files_read) == 1 and files_read[0].endswith(path.rpartition("/")[2]) else path
    stream = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files).parquet(source)
    keyed = stream.select(
        digest(whole_text()).alias("digest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.struct(F.current_timestamp().alias("batch"), _name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    # the time is that of the micro-batch, also when it is run again: the locator stays that of the content first seen
    states = keyed.groupBy("digest").agg(F.max("id").alias("id"), F.min("at").alias("at"), F.count("*").alias("n"))
    states = states.select("digest", "id", "at.file", "at.row", "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/updates/batch={number}")

    # many small states: no space is set aside for their logs, and all of an executor's stores share a bounded memory
    rocksdb = "spark.sql.streaming.stateStore.rocksdb"
    settings = {provider: ROCKSDB, f"{rocksdb}.allowFAllocate": "false", f"{rocksdb}.boundedMemoryUsage": "true", f"{rocksdb}.maxMemoryUsageMB": "48"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def last(found: DataFrame) -> DataFrame:
        # a state only grows: its last version has the largest count
        found = found.groupBy("digest").agg(F.max("id").alias("id"), F.max_by(F.struct("file", "row"), "n").alias("at"), F.max("n").alias("n"), F.max("batch").alias("batch"))
        return found.select("digest", F.when(F.col("id") > -(1 << 63), F.col("id")).alias("keep_id"), "at.file", "at.row", "n", "batch")

    every = _rows(spark, f"{store}/updates", STATE)
    number = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long") if every.columns and every.inputFiles() else F.lit(0).cast("long")
    every = every.withColumn("batch", number)
    compared = _rows(spark, f"{store}/compared", COMPARED).agg(F.max("batch")).first()[0]
    return last(every).drop("batch"), last(every.filter(F.col("batch") > (-1 if compared is None else compared)))


def shared_digests(spark: SparkSession, path: str, store: str, fresh: DataFrame, digest: Digest) -> DataFrame:
    """Digests that stand for more than one text: those known to ``store``, and those found among the states that were hit now."""
    upto = fresh.agg(F.max("batch")).first()[0]
    hit = saved(fresh.filter("n > 1").select("digest", "file", "row"), "hit")
    seen = {r.file for r in _rows(spark, f"{store}/compared", COMPARED).filter("file is not null").collect()}
    there = {re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", f): f for f in spark.read.parquet(path).inputFiles()}
    new = set(there) - seen
    # the content first seen lies in the files that locators name, as well as in files that are gone through now
    named = {r.file for r in hit.select("file").distinct().collect()} if seen else set()
    look = [at for f, at in there.items() if f in named or f in new]
    if look:
        docs = spark.read.parquet(*look).select(whole_text().alias("text"), _name(F.col("_metadata.file_path")).alias("of"), F.col("_metadata.row_index").alias("at"))
        met = docs.withColumn("digest", digest(F.col("text"))).join(sized(hit, 160), "digest")
        if seen:  # of a file read before, the row at the locator alone
            new_files = spark.createDataFrame([(f,) for f in sorted(new)], "of string").withColumn("is_new", F.lit(True))
            met = met.join(sized(new_files, 200), "of", "left").filter("is_new or (of = file and at = row)")
        texts = met.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        texts.filter("low <> high").select("digest").write.mode("append").parquet(f"{store}/shared")
    # one write after the comparison's: what isn't listed here is compared by the next call
    done = [(f, None) for f in sorted(new)] + ([(None, upto)] if upto is not None else [])
    spark.createDataFrame(done, COMPARED).coalesce(1).write.mode("append").parquet(f"{store}/compared")
    return _rows(spark, f"{store}/shared", "digest binary").distinct()


def exact_dedup(spark: SparkSession, path: str, digest: Digest = sha256, files: int = 1000, text: bool = False, store: str | None = None) -> DataFrame:
    """Per document at ``path``: doc_id, keep_id, group_size, kept, text_sha256; with ``text`` all its own columns too.

    Null text counts as empty. Of equal texts the largest doc_id stays (null below all; rows that repeat doc_id and
    text alike are one document, so all of them say kept). An empty table gives no rows. Column names of the input
    that clash with the added ones are replaced. ``store`` names the folder of the states; files are only added at ``path`` between
    calls on one store.
    """
    store = store or shared_dir(spark, "dedup")
    every, fresh = digest_states(spark, path, store, digest, files)
    states = saved(every.select("digest", "keep_id", "n"), "states")
    clash = saved(shared_digests(spark, path, store, fresh, digest), "clash")
    clashes = clash.count()

    docs = spark.read.parquet(path)
    own = [F.col(c) for c in docs.columns if c not in ADDED] if text else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, F.sha2(whole_text(), 256).alias("text_sha256"), digest(whole_text()).alias("digest"), *([whole_text().alias("_bytes")] if clashes else []))
    plain = rows.join(sized(clash, 64), "digest", "left_anti") if clashes else rows
    # a digest found once needs no state; one that a third of the rows share is split by the join
    hits = states.filter("n > 1").select("digest", F.col("keep_id").alias("_keep"), "n")
    found = plain.join(sized(hits, 96), "digest", "left")
    found = found.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")))
    found = found.withColumn("group_size", F.coalesce("n", F.lit(1).cast("long"))).drop("n", "_keep")
    if clashes:
        odd = rows.join(sized(clash, 64), "digest", "left_semi")
        groups = odd.groupBy("_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(odd.join(groups, "_bytes"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", *(c for c in found.columns if own and c not in ADDED), "keep_id", "group_size", kept, "text_sha256")

"""Tables written between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_home(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a temporary one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="polymix-")
    return f"{base.rstrip('/')}/polymix/chain-{uuid.uuid4().hex}"


class Store:
    """Named Parquet tables below a folder; a table is there once it is complete."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, (home or shared_home(spark)).rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        fs, path = self._at(f"{name}/_SUCCESS")
        return fs.exists(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}")

    def drop(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def numbers(self, name: str, key: str) -> list[int]:
        """The numbers of complete tables ``name/key=number``."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(f.partition("=")[2]) for f in found if f.startswith(f"{key}=") and self.has(f"{name}/{f}"))

    def last(self, name: str, key: str) -> int | None:
        return max(self.numbers(name, key), default=None)


def saver(spark: SparkSession, keep: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Writes a table and reads it back. Of the tables of a chain's windows only the last ``keep`` stay; the first two (the genotype and its
    statistics) stay as well."""
    store, number = Store(spark), iter(range(1 << 40))

    def save(df: DataFrame) -> DataFrame:
        i = next(number)
        if i - keep >= 2:
            store.drop(str(i - keep))
        return store.write(df, str(i))

    return save

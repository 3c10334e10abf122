"""Written tables for iterative jobs, in the folder that all executors share; only a local master may do without one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def lasting_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the session's JVM ends."""
    path = Rounds(spark, name).root
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def lasting(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, computed once however often it is read; it goes when the session's JVM ends."""
    df.write.parquet(path := f"{lasting_folder(df.sparkSession, name)}/table")
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of an iterative job: each save cuts the lineage; the table before is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            base = tempfile.mkdtemp(prefix="morphmill-")
            spark.conf.set("spark.checkpoint.dir", base)
        #: The last table of each name.
        self.spark, self.root, self.last = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", {}
        self.kept = False

    def save(self, df: DataFrame, name: str = "state") -> DataFrame:
        """df as a written table; the one of this name before it goes."""
        df.write.parquet(path := f"{self.root}/{uuid.uuid4().hex}")
        self._replace(name, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_parts(self, df: DataFrame, by: str, name: str = "parts") -> DataFrame:
        """As ``save``, in a folder for each value of a column, so that a filter on it reads its folders only."""
        df.write.partitionBy(by).parquet(path := f"{self.root}/{uuid.uuid4().hex}")
        self._replace(name, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A saved table that outlives the block: it goes when the session's JVM ends."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.last.pop(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        self.kept = True
        return df

    def _replace(self, name: str, path: str) -> None:
        old, self.last[name] = self.last.get(name), path
        if old:
            self._delete(old)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        for path in self.last.values() if self.kept else [self.root]:
            self._delete(path)

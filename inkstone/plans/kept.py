"""Tables written between the steps of a plan, in the folder that driver and executors share.

A table keeps plans small, is computed once however often it is read, and survives lost executors.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master a temporary folder is made and set where it is unset, on a cluster that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        said = tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", said)
    return said.rstrip("/")


#: For rows of megabytes: the writer looks at its size after each row, not after a hundred, and ends a row group at 16 MB, which is what a reader takes in at once.
_LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 16 << 20}


def _written(df: DataFrame, tag: str, large_rows: bool = False) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{folder(spark)}/inkstone/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(_LARGE_ROWS if large_rows else {})).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, tag: str, large_rows: bool = False) -> DataFrame:
    """df, written once and read back. large_rows: a row may take megabytes, so row groups hold few of them."""
    return _written(df, tag, large_rows)[1]


def freed(spark: SparkSession) -> None:
    """Shuffle files that no plan in use needs go now; Spark deletes them once their plans are collected, which may else be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def append_rounds(rounds: Iterable[DataFrame], path: str, **options: str) -> None:
    """One table of several plans' rows, each run when the shuffle files of the one before are gone."""
    for df in rounds:
        df.write.mode("append").options(**options).parquet(path)
        spark = df.sparkSession
        del df
        freed(spark)


def kept_rounds(spark: SparkSession, rounds: Iterable[DataFrame], tag: str) -> DataFrame:
    """What several plans of the same columns give, written one after another and read back."""
    path, schema = f"{folder(spark)}/inkstone/{tag}-{uuid.uuid4().hex}", []

    def told():
        for df in rounds:
            schema[:] = [df.schema]
            yield df
            del df

    append_rounds(told(), path, compression="zstd")
    return spark.read.schema(schema[0]).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def alive(df: DataFrame) -> bool:
    """Whether the files behind a kept table are still there."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return True


def file_marks(df: DataFrame) -> tuple:
    """Names, sizes and times of the files behind a table, which tell whether it is still the same."""
    spark, found = df.sparkSession, []
    for file in sorted(df.inputFiles()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(found)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a kept table."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/inkstone/" in name:
            delete(df.sparkSession, name)


class Scratch:
    """The tables of one computation: all but its result go when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path, out = _written(df, tag)
        self.paths.append(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """A table that is needed no more goes early, and so do the shuffle files that only it needed."""
        dropped(df)
        freed(self.spark)

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a table of its own, after which nothing reads the others."""
        out = kept(df, tag)
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        return out

"""Append-only ingestion: new records of a folder join the corpus once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.sources.articles import SCHEMA, normalised


#: Stored ids are kept in so many buckets by hash.
BUCKETS = 64


def ids_of(corpus: str) -> str:
    """Where the corpus' ids lie, as Parquet by bucket and batch."""
    return f"{corpus.rstrip('/')}.ids"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _note(rows: DataFrame, corpus: str) -> None:
    """Adds (id, batch) to the ids; a batch that runs again overwrites what it noted before."""
    noted = rows.select("id", _bucket().alias("bucket"), "batch").repartition("bucket")
    noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(ids_of(corpus))


def stored_among(spark: SparkSession, corpus: str, buckets: list[int], batch: int) -> DataFrame:
    """Ids of these buckets that other batches have stored; the other buckets' files are not read."""
    ids = spark.read.schema("id string, bucket int, batch long").parquet(ids_of(corpus))
    return ids.filter(F.col("bucket").isin(buckets) & (F.col("batch") != batch)).select("id")


def ingest(spark: SparkSession, source: str, corpus: str, checkpoint: str, most: int | None = None) -> StreamingQuery:
    """Reads JSON lines that arrived since the last run, skips ids already stored, adds the rest as Parquet, and stops.

    Every record needs an id. Each micro-batch is a partition of its own (column batch) that a retry overwrites, so no record is stored twice,
    whether a batch runs again or a fresh checkpoint meets a corpus: then new batches are numbered on from those stored. Stored ids are looked up in the buckets
    that a batch's ids fall into. most: records that the corpus holds in all; beyond it none are added, those of a batch by id.
    """
    first = None

    def append(batch: DataFrame, number: int) -> None:
        nonlocal first
        if first is None:
            first = _first_number(spark, corpus, checkpoint)
            if _exists(spark, corpus) and not _exists(spark, ids_of(corpus)):  # a corpus from before there were buckets
                _note(spark.read.schema("id string, batch long").parquet(corpus), corpus)
        at = first + number
        rows = normalised(batch, number=False).dropDuplicates(["id"])
        if _exists(spark, ids_of(corpus)):
            buckets = sorted(r.bucket for r in batch.select(_bucket().alias("bucket")).filter("bucket is not null").distinct().collect())
            rows = rows.join(stored_among(spark, corpus, buckets, at), "id", "left_anti")
            if most is not None:
                held = spark.read.schema("bucket int, batch long").parquet(ids_of(corpus)).filter(F.col("batch") != at).count()
                rows = rows.orderBy("id").limit(max(0, most - held))
        elif most is not None:
            rows = rows.orderBy("id").limit(most)
        rows.write.mode("overwrite").parquet(f"{corpus}/batch={at}")
        _note(spark.read.schema("id string").parquet(f"{corpus}/batch={at}").withColumn("batch", F.lit(at).cast("long")), corpus)

    stream = spark.readStream.schema(SCHEMA).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first_number(spark: SparkSession, corpus: str, checkpoint: str) -> int:
    """Where this checkpoint's batches begin: kept beside the checkpoint, set once from the batches that the corpus holds."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/first-batch")
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        return int(spark.read.text(str(at)).first()[0])
    home = jvm.org.apache.hadoop.fs.Path(corpus)
    names = [s.getPath().getName() for s in home.getFileSystem(conf).listStatus(home)] if home.getFileSystem(conf).exists(home) else []
    first = max((int(n.split("=")[1]) + 1 for n in names if n.startswith("batch=")), default=0)
    spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.text(str(at))
    return first

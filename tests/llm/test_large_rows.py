"""Rows of megabytes in kept tables."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkstone.llm import hmm
from inkstone.plans.kept import kept


def test_rows_of_megabytes_are_read_a_few_at_a_time(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: F.xxhash64(x + F.col("id"))).alias("many"))
    out = kept(rows, "large-rows", large_rows=True)
    (file,) = out.inputFiles()
    said = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert said.num_rows == 40 and max(said.row_group(i).total_byte_size for i in range(said.num_row_groups)) < 32 << 20
    assert out.select("id", F.size("many").alias("n")).filter("n = 200000").count() == 40


def test_packs_are_written_as_large_rows(spark, monkeypatch):
    seen = {}

    def keep(df, tag, large_rows=False):
        seen[tag] = large_rows
        return kept(df, tag, large_rows)

    monkeypatch.setattr(hmm, "keep", keep)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    assert hmm.lm_scores(docs, 1).count() == 20
    assert seen["packs"] and seen["classes"] and not seen["counts"]

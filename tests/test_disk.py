"""What building, growing and asking an index leaves on disk while it runs."""

import os

from pyspark.sql import functions as F

from inkstone.plans import index, kept, store
from inkstone.plans.retrieve import retrieve


def articles(spark, n):
    said = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.xxhash64("id", F.lit(k)) % 500).cast("string")) for k in range(30)])
    none = [F.lit("").alias(c) for c in ("calendar", "source_url", "date_original")]
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("title").alias("title"), said.alias("text"), *[F.lit(1).alias(c) for c in ("year", "month", "day")], F.lit(False).alias("leap_month"), *none)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_postings_weighed_in_rounds_are_those_of_one(spark, monkeypatch):
    a = articles(spark, 300)
    one = index.build(a)
    monkeypatch.setattr(index, "ROUND_ROWS", 1500)
    many = index.build(a)
    assert len(list(index.weighed_rounds(index.term_counts(a), one.idf))) > 4
    assert rows(many.postings) == rows(one.postings) and rows(many.parts) == rows(one.parts)


def test_building_and_growing_leave_no_other_copies(spark, monkeypatch, tmp_path):
    seen = []
    written = kept._written
    monkeypatch.setattr(kept, "_written", lambda df, tag, *more: seen.append((tag, out := written(df, tag, *more))) or out)
    index.build(articles(spark, 50))
    assert [os.path.exists(path.removeprefix("file:")) for tag, (path, _) in seen if tag == "term-counts"] == [False]
    path, seen[:] = f"{tmp_path}/grown", []
    assert store.append(articles(spark, 40), path) == 40 and store.append(articles(spark, 40), path) == 0 and store.append(articles(spark, 60), path) == 20
    assert not seen and len([x for x in os.listdir(path) if x.startswith("articles-")]) == 2
    assert rows(store.merge(spark, path).postings) == rows(index.build(articles(spark, 60)).postings)


def test_a_merge_without_readers_deletes_the_old_postings_first(spark, monkeypatch, tmp_path):
    path = f"{tmp_path}/grown"
    store.append(articles(spark, 40), path)
    store.merge(spark, path)
    store.append(articles(spark, 60), path)
    weighed, held = store.weighed_rounds, []
    monkeypatch.setattr(store, "weighed_rounds", lambda *x: held.append((store.manifest(spark, path), os.listdir(path))) or weighed(*x))
    merged = store.merge(spark, path, alone=True)
    (said, folders), = held
    assert not any(x.startswith(("postings-", "parts-")) for x in folders) and not said["tables"] and len(said["pending"]) == 2
    want = rows(index.build(articles(spark, 60)).postings)
    assert rows(merged.postings) == want
    # a merge that failed there is made up for by the next one
    store._swap(spark, path, said)
    monkeypatch.setattr(store, "weighed_rounds", weighed)
    assert rows(store.merge(spark, path).postings) == want


def test_asking_deletes_the_tables_that_scores_were_read_from(spark, monkeypatch):
    built = index.build(articles(spark, 60))
    seen, written = [], kept._written
    monkeypatch.setattr(kept, "_written", lambda df, tag, *more: seen.append((tag, (out := written(df, tag, *more))[0])) or out)
    q = spark.createDataFrame([("a", "w1 w2 w3"), ("b", "nothing")], "qid string, original string")
    found = retrieve(built, q, min_similarity=0.0)
    assert found.evidence.count() > 0
    left = {tag for tag, path in seen if os.path.exists(path.removeprefix("file:"))}
    gone = {"question-parts", "surviving-pairs", "open-firsts"}
    assert gone <= {tag for tag, _ in seen} and not gone & left and {"base", "scored", "open-pairs", "evidence"} <= left

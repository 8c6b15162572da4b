"""Shards: the packing rule by plain loops, and what holds of every result."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import queries, shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_packing_is_the_highest_dot_product():
    draw = np.random.default_rng(4)
    for _ in range(20):
        v, room = draw.gamma(0.7, 10.0, (draw.integers(0, 90), 3)), draw.uniform(50, 300, (draw.integers(1, 9), 3))
        unit, turn = room.mean(0), int(draw.integers(0, 9))
        left, want = [list(r / unit) for r in room], {}
        for i in sorted(range(len(v)), key=lambda i: -max(v[i] / unit) if max(v[i] / unit) > shards.FIRST else 0):
            item = v[i] / unit
            score = lambda s: sum(a * b for a, b in zip(left[s], item))
            best = max(range(len(room)), key=lambda s: (round(score(s), 9), -((s - turn) % len(room))))
            left[best] = [a - b for a, b in zip(left[best], item)]
            want[i] = best
        assert shards.pack(v, room, turn).tolist() == [want[i] for i in range(len(v))]


def corpus(n, hot, seed=2):
    draw = random.Random(seed)
    texts = ["".join(draw.choices("ab é\n", k=int(draw.paretovariate(1.1) * 20) % 3000)) for _ in range(n)]
    texts += [draw.choice(texts) for _ in range(n // 10)] + ["copy of a text " * 5] * hot + [None, "", None]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "x", "en", "s", 0), (7, "y", "en", "s", 0), (7, "y", "en", "s", 0)]


def check(got, rows, most_apart):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, sums = defaultdict(list), np.zeros((16, 3))
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += (r.size, r.tokens, 1)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    assert (np.abs(sums / sums.mean(0) - 1) < most_apart).all(), sums / sums.mean(0)
    of = defaultdict(set)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard)
    return of


def test_shards_are_even_and_groups_stay_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "LOT", 200)
    monkeypatch.setattr(shards, "RUN", 20)
    rows = corpus(6000, 250)
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as h", "2 as row", "3 as shard", "4 as size", "5 as tokens").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_vector_packing"](spark, str(tmp_path)).collect()
    assert all(len(x) == 1 for x in check(got, rows, 0.05).values()) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    again = queries.QUERIES["op13_vector_packing"](spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    rows = corpus(4000, 2400)
    of = check(shards.assigned(spark.createDataFrame(rows, DOCS)).collect(), rows, 0.06)
    hot = ("copy of a text " * 5).encode()
    split = {k: x for k, x in of.items() if len(x) > 1}
    assert set(split) == {(zlib.crc32(hot), len(hot) + 1)} and 9 <= len(split[zlib.crc32(hot), len(hot) + 1]) <= 16


def test_empty_table_and_files(spark, tmp_path):
    assert shards.assigned(spark.createDataFrame([], DOCS)).count() == 0
    rows = corpus(100, 3)
    docs = spark.createDataFrame(rows, DOCS)
    shards.write_shards(docs, f"{tmp_path}/out", 4, rows_a_file=10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, rows))
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count(F.lit(1))).alias("ok")).filter("ok").count() == 4

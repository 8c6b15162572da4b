"""Importance resampling against plain loops over every run of words."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from inkstone.llm import queries, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def by_hand(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    count = lambda texts: np.bincount([bucket(f) for t in texts for f in runs(t)[1]] or [0][:0], minlength=10000)
    s, t = count([x for _, x in docs]).tolist(), count(target).tolist()
    big, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        w, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in rows]


def texts():
    draw = random.Random(3)
    words = ["Alpha", "beta-gamma", "x1", "É", "naïve", "ÀB", "the", " y", "z" * 70, "q" * 5000, "日本語", "_", "'s", "\x00n"]
    return [" ".join(draw.choices(words, draw.choices([1, 9], k=1) * 3 + [2] * (len(words) - 3), k=draw.choice([0, 1, 2, 3, 19, 20, 21, 60, 400]))) + draw.choice(["", ".", "\n"]) for _ in range(150)]


def test_checksums_of_joined_texts():
    draw = random.Random(8)
    a, b = ([bytes(draw.choices(range(256), k=draw.choice([0, 1, 5, 63, 64, 65, 127, 4096, 100_003]))) for _ in range(60)] for _ in range(2))
    sums = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    assert resample.appended(sums(a), sums(b), np.array(list(map(len, b)))).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_chunks_own_every_run_once():
    for text in texts():
        raw = text.encode()
        for size in (1, 7, 64, 10**6):
            words, found = resample.features(list(resample.chunks(raw, size)), 10**9)
            w, want = runs(text)
            assert words.sum() == len(w) and sorted(x for _, b in found for x in b.tolist()) == sorted(zlib.crc32(f.encode()) % 10**9 for f in want)


def test_ranks_of_whole_tables(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, ""), (902, "—"), (None, texts()[7]), (3, texts()[3]), (3, texts()[3])]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).selectExpr("*", "1 as row", "2 as own", "3 as weight", "4 as rank")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    target = ["the x1 the x1 É", None, "", "naïve the ÀB " * 30]
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(by_hand(docs, target), key=str)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for chunk in (50, resample.CHUNK):
        got = resample.importance_resample(read, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == want
    got = queries.QUERIES["op12_importance_resample"](spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == want
    drawn = resample.resampled(read, spark.createDataFrame([("the",)], "text string"), percent=50)
    assert set(drawn.columns) == set(rows.columns) and 0 < drawn.count() < rows.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample.importance_resample(none, spark.createDataFrame([], "text string")).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 20, "en", "s", 0)], DOCS)
    assert resample.importance_resample(some, none.select("text")).first().n_features == 177

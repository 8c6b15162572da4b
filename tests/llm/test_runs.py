"""Periodic runs against a search of every period and place."""

import hashlib
import random
import zlib

import numpy as np

from inkstone.llm import queries, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(x):
    found = {}
    for q in range(1, len(x) // 3 + 1):
        same = [x[i] == x[i + q] for i in range(len(x) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def drawn(seed):
    draw, out = random.Random(seed), []
    letters = draw.choice([1, 2, 2, 3, 5, 50])
    while len(out) < draw.choice([0, 60, 200, 400]):
        unit = [draw.randrange(letters) for _ in range(draw.randrange(1, draw.choice([3, 10, 40])))]
        out += (unit * draw.choice([1, 3, 5, 30]))[draw.randrange(len(unit)) :] + [draw.randrange(letters)] * draw.randrange(2)
    return (out * draw.randrange(1, 4))[:500]


def test_runs_are_those_of_every_period_and_place():
    for seed in range(400):
        x = drawn(seed)
        assert runs.find_runs(np.array(x, np.int32)) == by_hand(x), seed


def test_long_texts_of_few_words():
    assert runs.find_runs(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]
    blocks = np.array(([0] * 900 + [1]) * 30, np.int32)
    assert runs.find_runs(blocks) == sorted([(901 * k, 900, 1) for k in range(30)] + [(0, 901 * 30, 901)])


def test_report_of_whole_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 64)  # words are numbered piece by piece
    draw = random.Random(5)
    rows = [(i, " \n".join(f"w{k}" for k in drawn(1000 + i)) + draw.choice(["", "\t", " é\x85x\x1cy "]), "en", "s", 0) for i in range(120)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n ", "en", "s", 0), (None, "a b " * 40, "en", "s", 0), (3, "again " * 30, "en", "s", 0), (3, "again " * 30, "en", "s", 0)]
    clash = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as runs", "2 as collapsed", "3 as best", "4 as start", "5 as words")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        found = by_hand([number[x] for x in w])
        out = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in out))))
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120))
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0

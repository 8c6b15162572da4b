"""Periodic run detection: aligned power-of-two blocks are searched across their text, hits seed exact runs.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST_WORDS, LEAST_TIMES * q) words that no neighbouring word
extends keeping period q. For each size b = 8, 16, 32, ... the text's blocks at multiples of b become keys (sequences of word numbers) of an
automaton, which then reads the text. A run with period q in [b, 2b), for b = 8 in [1, 2b), has LEAST_TIMES * q words or more, hence holds a whole
block that occurs again q words on. So every run is seeded by a hit at a distance that fits the block's size, and grows from there
in both directions, word by word, to its exact ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, mix64, shingle_hashes, slices

LEAST_WORDS, LEAST_TIMES, FIRST_BLOCK = 24, 3, 8
#: Bytes of a text whose words are Python objects at the same time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as places in its list of distinct words, and that list."""
    known: dict[bytes, int] = {}
    parts, a = [np.zeros(0, np.int32)], 0
    while a < len(raw):
        cut = _SPACE.search(raw, a + PIECE)
        b = cut.start() if cut else len(raw)
        found = raw[a:b].split()
        at = list(map(known.get, found))
        if None in at:
            at = [known.setdefault(w, len(known)) for w in found]
        parts.append(np.array(at, np.int32))
        a = b
    return np.concatenate(parts), list(known)


def _alike(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, one by one."""
    left, k, size = len(x) - max(i, j), 0, 64
    while k < left:
        m = min(size, left - k)
        other = x[i + k : i + k + m] != x[j + k : j + k + m]
        at = int(other.argmax())
        if other[at]:
            return k + at
        k, size = k + m, min(4 * size, 1 << 16)
    return left


def _recurring(x: np.ndarray) -> np.ndarray | None:
    """Whether the FIRST_BLOCK words from each place on occur at another place too; None if that holds nowhere.

    By hashes, so that a block with a word group found nowhere else, which can't recur, needs no search; a clash only asks for a search too many.
    """
    h = shingle_hashes(mix64(x.astype(np.uint64)), FIRST_BLOCK)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return twice[at] == h


def _hits(x: np.ndarray, size: int, starts: list[int], open_: np.ndarray) -> tuple[list[int], dict[int, np.ndarray]]:
    """The key of each aligned block, and where in the text each key occurs, in order; open_: the places at which a block may begin."""
    import ahocorasick

    search, keys, of = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}, []
    for s in starts:
        block = tuple(x[s : s + size].tolist())
        key = keys.get(block)
        if key is None:
            key = keys[block] = len(keys)
            search.add_word(block, key)
        of.append(key)
    search.make_automaton()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
    places: dict[int, list[int]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        first = a - size + 1
        for end, key in search.iter(tuple(x[a : b + size - 1].tolist())):
            places.setdefault(key, []).append(first + end)
    return of, {key: np.array(at) for key, at in places.items()}


def _linked(known: list[tuple[int, int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Seeds (place, distance) from pairs of runs (start, end, period) of one period: their starts meet, or their ends.

    Of runs as long as a block few begin within reach of each other.
    """
    out, by_period = [], {}
    for start, end, period in known:
        by_period.setdefault(period, []).append((start, end))
    for runs in by_period.values():
        for side in (0, 1):
            runs.sort(key=lambda r: r[side])
            at = np.array([r[side] for r in runs])
            first, last = np.searchsorted(at, at + low), np.searchsorted(at, at + high)
            out += [(int(at[i]) - side, int(at[j] - at[i])) for i in range(len(at)) for j in range(first[i], last[i])]
    return out


def find_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period.

    Within a known run of period q <= size / 3 blocks recur every q words, to no avail: a distance inside the run leads to that run again,
    and a longer period that links two runs of period q must bring their starts together, or their ends. So such runs
    seed by their ends and the automaton reads the other places only, where a block recurs within its reach a few times at most: the work stays
    in proportion to the text, times the number of sizes.
    """
    n = len(x)
    recurring = _recurring(x) if n >= LEAST_WORDS else None
    if recurring is None:
        return []
    upto = np.concatenate(([0], np.cumsum(recurring)))
    back, found, size = x[::-1], {}, FIRST_BLOCK
    while size == FIRST_BLOCK or LEAST_TIMES * size <= n:
        low, high = 1 if size == FIRST_BLOCK else size, min(2 * size, n // LEAST_TIMES + 1)
        groups = size - FIRST_BLOCK + 1
        open_ = upto[groups:] - upto[:-groups] == groups
        # from 32 on a stretch that holds a block of such a period is long enough to be a run
        known = [(s, s + length, q) for (s, length), q in found.items() if LEAST_TIMES * q <= size <= length] if size >= LEAST_WORDS else []
        for a, b, _ in known:
            open_[a : b - size + 1] = False
        seeds = _linked(known, low, high)
        aligned = np.arange(0, n - size - low + 1, size)
        starts = aligned[open_[aligned]].tolist()
        if starts:
            of, places = _hits(x, size, starts, open_)
            for s, key in zip(starts, of):
                near = places[key]
                seeds += [(s, p - s) for p in near[np.searchsorted(near, s + low) : np.searchsorted(near, s + high)].tolist()]
        settled: dict[int, int] = {}
        for s, d in sorted(seeds):
            if d >= high or settled.get(d, 0) > s or x[s] != x[s + d]:
                continue
            begin, end = s - _alike(back, n - s, n - s - d), s + _alike(x, s, s + d)
            settled[d] = end
            length = end - begin + d
            if length >= max(LEAST_WORDS, LEAST_TIMES * d):
                found[begin, length] = min(d, found.get((begin, length), d))
        size *= 2
    return sorted((s, length, q) for (s, length), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def _searched(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in slices(batches, "text"):
        counts, runs, collapsed = [], [], []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            x, words = word_numbers(raw)
            found = find_runs(x)
            counts.append(len(x))
            runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
            left = x[kept_words(len(x), found)] if found else x
            collapsed.append(b" ".join(b" ".join(map(words.__getitem__, left[a : a + PIECE].tolist())) for a in range(0, len(left), PIECE)))
        more = [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the text's words, one space apart, less those that repeat a run's first period.

    For every row of (doc_id, text). Null and empty texts have no words, no runs and an empty `collapsed`. Repeated rows and rows without id each
    give their row; an empty table gives none; extra columns are ignored. Equal stretches under several periods
    are one run with the smallest; runs that overlap all count. A text is searched whole in one task, since a run may span it: memory is some
    tens of bytes for each of its words that recur, a few for the others. Nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_searched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """Texts in which every tenth id, by crc32, gets its tail replaced by a periodic one; the other texts are left alone.

    With h = crc32(decimal doc_id) and g = h div 10, of the n words those from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words from a on.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def replaced(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        i = F.sequence(F.lit(0).cast("long"), n - 1)
        said = F.transform(i, lambda k: F.get(w, F.when(k < a, k).otherwise(a + F.pmod(k - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(said, " ")).otherwise(F.lit(""))

    return F.when(F.pmod(h, F.lit(10)) == 0, F.element_at(F.transform(F.array(words), replaced), 1)).otherwise(text)


def run_report(found: DataFrame) -> DataFrame:
    """Digests of periodic_runs: number of runs, the run of greatest length / period (ties: smallest start, then period), and sha256 of all runs and of the collapsed text."""
    better = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", F.expr(better))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

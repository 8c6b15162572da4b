"""Substring dedup by compact windows.

For a hash function over a text's 5-word shingles, a compact window (l, c, r) stands for all subsequences that start in [l, c] and end in
[c, r]: shingle c has the smallest hash in [l, r], so they all share it as their min-hash. The windows are the nodes of the
Cartesian tree of the hashes; those at least as long as the shortest passage number about 2n / length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, hashed_words, mix64, shingle_hashes, slices, words_of
from .components import stars

HASHES, WIDTH, LEAST_WORDS = 8, 5, 50
#: Of HASHES functions so many must agree on windows that can hold one passage.
AGREE = 2
MOST_BROADCAST = 1_000_000
#: A value that this share of sampled documents' windows hold (one document in SAMPLE) is dealt to SALTS tasks; there are HOT of them at most.
SAMPLE, HOT, SALTS = 64, 10_000, 64
#: How far to both sides of a window's anchor the shingles lie that tell its surroundings: of a passage's 46 shingles, 22 lie on one side of any.
REACH = (6, 22)
#: Any two passages that reach the similarity share so many shingles in a row (22 words): an edit parts two runs and costs four shingles of one and five of the
#: other at least, so a similarity of 0.75 asks for 27 shared shingles an edit, and 46 shingles with one edit for 42 in two runs.
RUN = 18
#: How many shingles to either side of a window's anchor are compared, and how many two windows must have in common there, repeats counted.
BESIDE, ALIKE = 72, 24
#: What two passages of the least length (46 shingles) and a similarity of 0.75 have in common around some run of RUN: so many shingles, spread over so many places.
#: Shared runs outweigh the gaps between them threefold (27 an edit, of which one side lacks four). Runs that lie further than BESIDE - 45 from all others, over less than
#: 46 places, cost more in gaps than they bring, so others outweigh theirs without them; what is left is one run of 46 or runs close together, that take up 46 places.
#: Among those a run of 36 has them itself; if none is so long, two or three runs in a row have them, with 23 places in gaps at most.
HELD, SPREAD = 36, 46
#: Windows of one value that meet in one task.
BLOCK = 4096
#: Pairs of one document that are verified in one task.
MEET = 1000
#: Pairs of places that two texts' equal shingles make before the commonest meet by rank, and the widest gap within a passage's chain.
MOST_PLACES, WIDEST = 100_000, 64
#: Places of one shingle, on average, from which on a chain's places are worked through shingle by shingle, and the bits (places of one text by those of the other) it may take.
MANY, MOST_BITS = 4, 200_000_000


def _slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` values."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _tree(values: np.ndarray, least: int) -> np.ndarray:
    """(l, c, r) of the Cartesian trees' nodes that span `least` places or more; zeros in values part texts.

    Such a node is the smallest of some run of `least` values, and so are the nearest smaller values on its sides. Of equal minima
    the leftmost is the upper node; nodes of one value that follow closer than `least` on the one before are left to it.
    """
    if len(values) < least:
        return np.zeros((0, 3), np.int64)
    low = _slide(np.minimum, values, least)
    pad = np.zeros(least - 1, values.dtype)
    places = np.nonzero((_slide(np.maximum, np.concatenate((pad, low, pad)), least) == values) | (values == 0))[0]
    vals = values[places]
    before, after = _smaller(vals), len(vals) - 1 - _smaller(vals[::-1], strict=True)[::-1]
    left = np.where(before >= 0, places[np.maximum(before, 0)] + 1, 0)
    right = np.where(after < len(vals), places[np.minimum(after, len(vals) - 1)] - 1, -1)
    equal = np.nonzero((before >= 0) & (vals[np.maximum(before, 0)] == vals) & (vals > 0))[0]
    said = np.arange(len(vals))
    for i, j in zip(equal.tolist(), before[equal].tolist()):
        if places[i] - places[said[j]] < least:
            said[i] = said[j]
            left[i] = places[i] + 1  # no window of its own
    found = np.stack((left, places, right), axis=1)
    return found[(right - left + 1 >= least) & (vals > 0)]


def _smaller(values: np.ndarray, strict: bool = False) -> np.ndarray:
    """For each place the nearest one before it whose value is no larger (strict: smaller), -1 if there is none; zeros look no further than one place.

    All places look on at once from where what they met looks to. Places that still look after many rounds, since
    they must pass many that have ended, go one by one, as on a stack.
    """
    at = np.arange(-1, len(values) - 1)
    on = np.nonzero(values[1:] > 0)[0] + 1
    for _ in range(32):
        met = values[at[on]]
        on = on[(at[on] >= 0) & ((met >= values[on]) & (met > 0) if strict else met > values[on])]
        if not len(on):
            return at
        at[on] = at[at[on]]
    for i in on.tolist():
        j, x = int(at[i]), values[i]
        while j >= 0 and values[j] and (values[j] >= x if strict else values[j] > x):
            j = int(at[j])
        at[i] = j
    return at


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of one text's compact windows of `least` places or more."""
    if not len(values):
        return []
    found = _tree(np.concatenate(([0], values, [0])).astype(np.uint64), least)
    return [tuple(w) for w in (found - 1).tolist()]


def _lines(batch, least_words: int, pad: int):
    """The batch's rows whose documents have an id and words enough, their shingles in one line with `pad` zeros before, between and after the texts, and where
    each text begins and ends there."""
    words, sizes = hashed_words(batch.column("text"))
    some = np.nonzero((sizes >= max(least_words, WIDTH)) & np.asarray(batch.column("doc_id").is_valid()))[0]
    shingles = shingle_hashes(words, WIDTH) if len(some) else words[:0]  # those over a text's end are left out
    count = sizes[some] - WIDTH + 1
    begins = pad + np.cumsum(count + pad) - (count + pad)
    line = np.zeros(pad + int((count + pad).sum()), np.uint64)
    at = _count_up(count)
    line[np.repeat(begins, count) + at] = shingles[np.repeat((np.cumsum(sizes) - sizes)[some], count) + at]
    return some, line, begins, begins + count


_ROWS = "key long, salt int, doc_id long, span long, around int"


def _around(line: np.ndarray, c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A byte for each shingle REACH places to the left and to the right of the anchors, as far as the text goes."""
    out = np.zeros(len(c), np.uint64)
    for sign in (-1, 1):
        for d in REACH:
            at = c + sign * d
            ok = (at >= begin) & (at < end)
            out = out << np.uint64(8) | mix64(np.where(ok, line[np.where(ok, at, 0)], np.uint64(0))) >> np.uint64(56)
    return out.astype(np.uint32).view(np.int32)


def _salt_of(doc: np.ndarray) -> np.ndarray:
    return (1 + mix64(doc.view(np.uint64) * np.uint64(31)) % np.uint64(SALTS)).astype(np.int32)


def _windows(least_words: int, hot: np.ndarray):
    """A row for each compact window: key (function and min-hash), salt, document, span (anchor and how far the window goes to its left and right, 65,535
    at most), and 16 bits each for the shingles to the left and right of the anchor."""
    least = least_words - WIDTH + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text", 1_000_000):
            some, line, begins, ends = _lines(batch, least_words, 1)
            if not len(some):
                continue
            docs, parted = np.asarray(batch.column("doc_id").take(pa.array(some))).astype(np.int64), line == 0
            for k in range(HASHES):
                values = mix64(line + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                values[parted] = 0
                left, c, right = _tree(values, least).T
                # the lowest bits of the key say which function it is of
                key = ((values[c] >> np.uint64(3) << np.uint64(3)) | np.uint64(k)).view(np.int64)
                of = np.searchsorted(begins, c, "right") - 1
                doc = docs[of]
                salt = np.where(np.isin(key, hot), _salt_of(doc), 0) if len(hot) else np.zeros(len(key))
                span = (c - begins[of]) << 32 | np.minimum(c - left, 65_535) << 16 | np.minimum(right - c, 65_535)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "salt": pa.array(salt.astype(np.int32)), "doc_id": pa.array(doc), "span": pa.array(span), "around": pa.array(_around(line, c, begins[of], ends[of]))})

    return run


#: A bucket of values holds the windows of so many words, unless that makes too many or too few buckets; windows that are dealt to buckets at once.
BUCKET_WORDS, BUCKETS, MOST_WORDS, DEALT = 60_000, (64, 4096), 10_000_000, 500_000
_BUCKETS = "bucket int, key binary, salt binary, doc_id binary, span binary, around binary"
_KINDS = {"key": np.int64, "salt": np.int8, "doc_id": np.int64, "span": np.int64, "around": np.int32}


def _buckets(words: int) -> int:
    return max(min(max(words // BUCKET_WORDS, BUCKETS[0]), BUCKETS[1]), words // MOST_WORDS)


def _bucketed(least_words: int, hot: np.ndarray, buckets: int):
    """The windows of _windows, those of one bucket of values (and salts) side by side in one row for each column, so that few rows are shuffled."""
    windows = _windows(least_words, hot)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def dealt(held):
            columns = {n: np.concatenate([b.column(n).to_numpy() for b in held]).astype(kind) for n, kind in _KINDS.items()}
            mixed = columns["key"].view(np.uint64) + columns["salt"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = (mix64(mixed) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            some = np.nonzero(sizes)[0]
            upto = np.concatenate(([0], np.cumsum(sizes[some])))
            cell = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((upto * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x[order].tobytes())])
            return pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32))} | {n: cell(x) for n, x in columns.items()})

        held, size = [], 0
        for batch in windows(batches):
            held.append(batch)
            size += batch.num_rows
            if size > DEALT:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, and how far the window goes to the left and right."""
    return span >> 32, span >> 16 & 65_535, span & 65_535


def _starts(*columns: np.ndarray) -> np.ndarray:
    """For rows in order, the place where each row's run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether any shingle of the surroundings is the same at the same distance."""
    differ = x ^ y
    return np.logical_or.reduce([(differ >> shift & 255) == 0 for shift in (0, 8, 16, 24)])


def _meet(sides: bool):
    """Rows of whole buckets of values, sorted by bucket, or without `sides` windows sorted by key: each window meets the first of its value and salt by document and span, if a shingle beside the anchors
    agrees, and with `sides` the firsts of those that have the same shingles to the left or to the right of the anchor.

    p, q, low, high, held: documents in order, where a passage around both anchors can lie in p, and the functions (bits) that say so; what overlaps is one
    row (see _joined). The firsts of salted values go on (held is 0, low the span) under a key that tells what they are the first of, to meet those of the other salts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def flush(key, salt, doc, span, around):
            order = np.argsort(key, kind="stable")
            key, salt, doc, span, around = (x[order] for x in (key, salt, doc, span, around))
            lone = _starts(key)
            some = np.nonzero((np.bincount(lone, minlength=len(key))[lone] > 1) | (salt > 0))[0]
            some = some[np.lexsort((span[some], doc[some], salt[some], key[some]))]
            key, salt, doc, span, around = (x[some] for x in (key, salt, doc, span, around))
            at = np.arange(len(key))
            lone = _starts(key, salt)
            firsts = [(lone, np.full(len(key), 1 << 20))]
            for side in ((around >> 16 & 65_535, 65_536 + (around & 65_535)) if sides else ()):
                order = np.argsort(lone << 17 | side, kind="stable")
                first = np.empty(len(key), np.int64)
                first[order] = order[_starts(lone[order], side[order])]
                firsts.append((first, side))
            couples, again = [], [np.zeros((3, 0), np.int64)]
            for nth, (first, name) in enumerate(firsts):
                ok = (doc[first] != doc) | (span[first] != span)
                if sides and nth == 0:
                    ok &= _alike(around[first], around)
                couples.append(first[ok] * len(key) + at[ok])
                if sides:
                    on = np.nonzero((salt > 0) & (first == at))[0]
                    value = key[on].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + name[on].astype(np.uint64)
                    again.append(np.stack(((mix64(value) >> np.uint64(3) << np.uint64(3) | key[on].view(np.uint64) & np.uint64(7)).view(np.int64), doc[on], span[on])))
            couple = np.unique(np.concatenate(couples)) if len(couples) > 1 else couples[0]
            x, y = (couple // max(1, len(key)), couple % max(1, len(key)))  # the first of the two holds the smaller document
            (cx, bx, ax), (_, by, ay) = _unpack(span[x]), _unpack(span[y])
            pairs = _joined(doc[x], doc[y], cx - np.minimum(bx, by), cx + np.minimum(ax, ay), 1 << (key[x] & 7))
            more = np.concatenate(again, axis=1)
            return pairs, (more[1], more[0], more[2], more[2], np.zeros(more.shape[1], np.int64))

        def joined(key, salt, doc, span, around):
            """Rows that are done with; what a task has met so far is joined anew as long as that makes it fewer."""
            nonlocal met
            now, again = flush(key, salt, doc, span, around)
            met = [*met, now]
            if len(again[0]):
                yield again
            if sum(len(x[0]) for x in met) > 400_000:
                met = [_joined(*(np.concatenate(x) for x in zip(*met)))]
                if len(met[0][0]) > 200_000:
                    yield met.pop()

        def columns_of(batch):
            """What tells which windows come together, then the windows' columns."""
            if not sides:
                columns = [np.asarray(batch.column(n)).astype(np.int64) for n in _KINDS]
                return [columns[0], *columns]
            columns = [np.frombuffer(b"".join(batch.column(n).to_pylist()), kind).astype(np.int64) for n, kind in _KINDS.items()]
            sizes = np.asarray(pc.binary_length(batch.column("salt")))
            return [np.repeat(np.asarray(batch.column("bucket")).astype(np.int64), sizes), *columns]

        rows = lambda x: pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(("p", "q", "low", "high", "held"), x)})
        met: list[tuple[np.ndarray, ...]] = []
        held, size = [], 0
        for batch in slices(batches, "span", 1_600_000) if sides else batches:
            if batch.num_rows == 0:
                continue
            held.append(columns_of(batch))
            size += len(held[-1][0])
            if size < 200_000:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last one's rows may go on
            if cut:
                yield from map(rows, joined(*(x[:cut] for x in columns[1:])))
            held, size = [[x[cut:] for x in columns]], 0
        if held:
            yield from map(rows, joined(*[np.concatenate(x) for x in zip(*held)][1:]))
        if met:
            yield rows(_joined(*(np.concatenate(x) for x in zip(*met))))

    return run


#: Rows that go on hold document, key and span in p, q and low.
_MET = "p long, q long, low long, high long, held long"


def _joined(p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (p, q, low, high, functions held) with those of one pair that overlap along p as one; of a pair that AGREE functions hold already, one row is left.

    Interval join: a run goes on while the next interval begins before the farthest end of those in it. Runs that are joined early
    become the same runs as those joined at the end.
    """
    if not len(p):
        return p, q, low, high, held
    order = np.lexsort((low, q, p))
    p, q, low, high, held = (x[order] for x in (p, q, low, high, held))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    group = np.cumsum(new) - 1
    far = np.maximum.accumulate(high + group * (1 << 32)) - group * (1 << 32)
    begins = new.copy()
    begins[1:] |= low[1:] > far[:-1]
    starts = np.nonzero(begins)[0]
    held = np.bitwise_or.reduceat(held, starts)
    ends = np.append(starts[1:], len(p)) - 1
    # a pair that is found needs no other row
    enough = np.bitwise_count(held.astype(np.uint64)) >= AGREE
    group = group[starts]
    found = np.zeros(group[-1] + 1, bool)
    found[group[enough]] = True
    stay = ~found[group]
    stay[np.nonzero(enough)[0][np.unique(group[enough], return_index=True)[1]]] = True
    return p[starts][stay], q[starts][stay], low[starts][stay], far[ends][stay], held[stay]


def _found_pairs(p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q, _, _, held = _joined(p, q, low, high, held)
    enough = np.bitwise_count(held.astype(np.uint64)) >= AGREE
    return p[enough], q[enough]


def agreeing(p: np.ndarray, q: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of which AGREE functions or more have windows that overlap along p; place: anchor, how far the window goes to its left and right, and function, packed."""
    anchor, before, after, function = place >> 35, place >> 19 & 65_535, place >> 3 & 65_535, place & 7
    return _found_pairs(p, q, anchor - before, anchor + after, 1 << function)


def _agree(batches: Iterator) -> Iterator:
    """The pairs that AGREE functions hold, from rows sorted by pair."""
    import pyarrow as pa

    def flush(rows):
        p, q = _found_pairs(*(rows[n].to_numpy() for n in ("p", "q", "low", "high", "held")))
        yield pa.RecordBatch.from_pydict({"p": pa.array(p), "q": pa.array(q)})

    yield from _whole(batches, ("p", "q"), flush, 200_000)


def _selected(values: np.ndarray, least: int) -> np.ndarray:
    """Anchors c of compact windows of `least` places or more: the leftmost minimum of some run of `least`; zeros in values part texts.

    A run of `least` values that two texts share has its leftmost minimum at the same place in both, so no shared run is without a common anchor.
    """
    if len(values) < least:
        return np.zeros(0, np.int64)
    low = _slide(np.minimum, values, least)
    pad = np.zeros(least - 1, values.dtype)
    low = np.concatenate((pad, low, pad))  # of the run that ends at a place
    c = np.nonzero((_slide(np.maximum, low, least) == values) & (values > 0))[0]
    # only a minimum with an equal one close before it may be leftmost in no run; the last run that it is smallest in tells
    again = np.nonzero((np.diff(c) < least) & (values[c[1:]] == values[c[:-1]]))[0] + 1
    if not len(again):
        return c
    ends = c[again][:, None] + np.arange(least)
    last = c[again] + least - 1 - np.argmax((low[np.minimum(ends, len(low) - 1)] == values[c[again]][:, None])[:, ::-1], axis=1)
    return np.delete(c, again[last - least + 1 <= c[again - 1]])


def _thinned(line: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Anchors without those inside a stretch that repeats with a period of less than RUN places, of which the first and last are left.

    An anchor goes if the run of RUN shingles around it comes once more as many places before as after: shared passages that cover such a stretch's start or end have
    that one's anchor in common, those within two stretches both.
    """
    gap = np.diff(c)
    some = np.nonzero((gap < RUN) & (line[c[1:]] == line[c[:-1]]))[0]
    reach = np.arange(1 - RUN, RUN)
    same = line[np.clip(c[some, None] + reach, 0, len(line) - 1)] == line[np.clip(c[some + 1, None] + reach, 0, len(line) - 1)]
    period = np.zeros(len(c) + 1, np.int64)  # with which each anchor repeats the one before it
    some = some[_around_middle(same) >= RUN]
    period[some + 1] = gap[some]
    return c[(period[:-1] == 0) | (period[:-1] != period[1:])]


def _around_middle(same: np.ndarray) -> np.ndarray:
    """Length of the run of true values that holds the middle of each row."""
    middle = same.shape[1] // 2
    left, right = np.argmin(same[:, middle::-1], axis=1), np.argmin(same[:, middle:], axis=1)
    left[same[:, : middle + 1].all(axis=1)] = middle + 1
    right[same[:, middle:].all(axis=1)] = middle + 1
    return np.maximum(0, left + right - 1)


def _run_places(least_words: int):
    """A row for each compact window of RUN shingles or more, of one function: key (min-hash), document, its class and the anchor's place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text", 1_000_000):
            some, line, begins, _ = _lines(batch, least_words, RUN)
            if not len(some):
                continue
            docs, classes = (np.asarray(batch.column(n).take(pa.array(some))).astype(np.int64) for n in ("doc_id", "cls"))
            values = mix64(line + np.uint64(0x9E3779B97F4A7C15))
            values[line == 0] = 0
            c = _thinned(line, _selected(values, RUN))
            of = np.searchsorted(begins, c, "right") - 1
            yield pa.RecordBatch.from_pydict({"key": pa.array(values[c].view(np.int64)), "doc_id": pa.array(docs[of]), "cls": pa.array(classes[of]), "at": pa.array((c - begins[of]).astype(np.int32))})

    return run


#: An odd number and its inverse among 64-bit numbers.
_POWERS = (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _surroundings(batches: Iterator) -> Iterator:
    """32 bits of each shingle up to BESIDE places to either side of the places of a text, zero beyond the text; windows of a text with the same key and surroundings are one row."""
    import pyarrow as pa

    wide = 2 * BESIDE + 1
    for batch in slices(batches, "text", 1_000_000):
        _, line, begins, ends = _lines(batch, 0, BESIDE)
        lines = np.zeros(len(line), np.uint32)
        inside = np.repeat(begins, ends - begins) + _count_up(ends - begins)
        lines[inside] = np.maximum(line[inside] >> np.uint64(32), np.uint64(1))
        at = [places.values.to_numpy() + begin for places, begin in zip(batch.column("at"), begins)]
        sizes = [len(x) for x in at]
        at = np.concatenate(at) - BESIDE
        # sums of a window's shingles times powers of one number tell windows apart: differences of sums up to their ends, brought to the same power
        powers, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(lines), x, np.uint64)))) for x in _POWERS)
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lines * powers[:-1])))
        sums = (upto[at + wide] - upto[at]) * back[at]
        doc, cls = (np.repeat(batch.column(name).to_numpy(), sizes) for name in ("doc_id", "cls"))
        key, n = (batch.column(name).flatten().to_numpy() for name in ("keys", "n"))
        told = mix64(mix64(key.view(np.uint64) + mix64(sums)) + doc.view(np.uint64))
        once = np.sort(np.unique(told, return_index=True)[1])
        around = np.lib.stride_tricks.sliding_window_view(lines, wide)[at[once]]
        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * wide), len(once), [None, pa.py_buffer(around.tobytes())])
        yield pa.RecordBatch.from_pydict({"key": pa.array(key[once]), "n": pa.array(n[once]), "doc_id": pa.array(doc[once]), "cls": pa.array(cls[once]), "around": cells.cast(pa.binary())})


def _around_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), 2 * BESIDE + 1)


def _marks(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mark for each shingle of the surroundings that tells the first copy from the second and so on, and those up to the anchor from those after it; zero beyond the text. Then their places.

    Windows around a run of one passage have as many marks in common as shingles that lie on the same side of the anchors, repeats counted.
    """
    marks, places = [], []
    for side, cells in enumerate((around[:, : BESIDE + 1], around[:, BESIDE + 1 :])):
        places.append(np.argsort(cells, axis=1, kind="stable"))
        cells = np.take_along_axis(cells, places[-1], axis=1)
        at = np.arange(cells.shape[1])
        new = np.ones(cells.shape, bool)
        new[:, 1:] = cells[:, 1:] != cells[:, :-1]
        copy = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
        marks.append(np.where(cells > 0, mix64(cells.astype(np.uint64) << np.uint64(8) | (2 * copy + side).astype(np.uint64)), np.uint64(0)))
    return np.concatenate(marks, axis=1), np.concatenate((places[0], places[1] + BESIDE + 1), axis=1)


def _marked(batches: Iterator) -> Iterator:
    """A row for each mark of a window and the place where it stands."""
    import pyarrow as pa

    for batch in batches:
        for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
            marks, places = _marks(_around_of(part.column("around")))
            row, column = np.nonzero(marks)
            columns = {name: part.column(name).take(pa.array(row)) for name in ("key", "window", "cls")}
            yield pa.RecordBatch.from_pydict(columns | {"mark": pa.array(marks[row, column].view(np.int64)), "place": pa.array(places[row, column].astype(np.int32))})


def _needed_marks(row: np.ndarray, place: np.ndarray, alike: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which marks, each row's from the rarest to the commonest, one must be shared of: those from which on `alike` marks over `spread` places are left."""
    if not len(row):
        return np.zeros(0, bool)
    back = row[::-1]
    begin = _starts(back)
    shift = np.cumsum(np.concatenate(([0], back[1:] != back[:-1]))) * (2 << 20)
    high = np.maximum.accumulate(place[::-1] + shift) - shift
    low = shift - np.maximum.accumulate(shift - place[::-1])
    return ((np.arange(len(row)) - begin + 1 >= alike[back]) & (high - low + 1 >= spread[back]))[::-1]


def _rare_marks(alike: int, spread: int):
    """The marks of a window by which it meets others."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = batch.column("held")
            row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            marks = held.flatten()
            some = np.full(batch.num_rows, 1)
            ok = _needed_marks(row, marks.field("place").to_numpy().astype(np.int64), alike * some, spread * some)
            row = pa.array(row[ok])
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(row), "window": batch.column("window").take(row), "mark": marks.field("mark").filter(pa.array(ok))})

    return run


def _by_rare_marks(rows: DataFrame, alike: int, spread: int) -> DataFrame:
    """Windows under a key for each of their rare marks instead of their value: two of one value and different classes with `alike` marks in common, over `spread` places, still meet.

    Only marks count that two classes of the value hold. The rarest mark that two such windows share is one from which on either has `alike` marks over `spread`
    places, so a phrase of fewer shingles, however many documents hold it, brings no windows together.
    """
    rows = rows.withColumn("window", F.xxhash64("doc_id", "around"))
    each = rows.mapInArrow(_marked, "key long, window long, cls long, mark long, place int")
    times = each.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("times"), F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("key", "mark", "times")
    held = each.join(times, ["key", "mark"]).groupBy("key", "window").agg(F.sort_array(F.collect_list(F.struct("times", "mark", "place"))).alias("held")).filter(F.size("held") >= alike)
    rare = held.mapInArrow(_rare_marks(alike, spread), "key long, window long, mark long")
    out = rows.join(rare, ["key", "window"]).select(F.xxhash64("key", "mark").alias("key"), "doc_id", "cls", "around")
    of = Window.partitionBy("key")
    return out.withColumns({"n": F.count(F.lit(1)).over(of), "a": F.min("cls").over(of), "b": F.max("cls").over(of)}).filter("a < b").select("key", "n", "doc_id", "cls", "around")


def _same_run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two windows' surroundings are the same over RUN places or more around the anchors."""
    near = slice(BESIDE + 1 - RUN, BESIDE + RUN)
    x, y = x[:, near], y[:, near]
    return _around_middle((x == y) & (x > 0)) >= RUN


def _in_common(x: np.ndarray, y: np.ndarray, alike: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Whether `alike` of the first windows' shingles lie in the second ones too, on the same side of the anchors, and over some `spread` places or more two thirds of them do."""
    held = np.zeros(x.shape, bool)
    name = np.arange(len(x), dtype=np.uint64)[:, None] << np.uint64(33)
    for part in (slice(0, BESIDE + 1), slice(BESIDE + 1, None)):
        one, other = (name | z[:, part] for z in (x, y))
        held[:, part] = _shared(np.sort(other, axis=1).ravel(), one.ravel()).reshape(one.shape) & (x[:, part] > 0)
    ok = held.sum(axis=1) >= alike
    upto = np.pad(np.cumsum(3 * held.astype(np.int32) - 2, axis=1), ((0, 0), (1, 0)))
    for width in np.unique(spread[ok]):
        some = np.nonzero(ok & (spread == width))[0]
        least = np.minimum.accumulate(upto[some, : upto.shape[1] - width], axis=1)
        ok[some] = (upto[some, width:] >= least).any(axis=1)
    return ok


def _spans(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of rows that add about `most` each to the running sum, one row at least."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _whole(batches: Iterator, names: tuple, flush, most: int) -> Iterator:
    """flush over rows of whole keys (the first names), of about `most` rows or more."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [rows[n].to_numpy() for n in names]
        cut = int(_starts(*keys)[-1])  # the last key may go on
        if cut:
            yield from flush(rows.slice(0, cut))
        held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
    if held:
        yield from flush(pa.Table.from_batches(held))


def _rarest(value: np.ndarray, cls: np.ndarray, around: np.ndarray, alike: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the marks by which they meet others (see _by_rare_marks), by name and class; where that makes more pairs than all rows of a value that have such marks, these meet under one name."""
    marks, places = _marks(around)
    row, column = np.nonzero(marks)
    name, place = mix64(marks[row, column] + value[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), places[row, column]
    order = np.argsort(name)
    row, name, place = row[order], name[order], place[order]
    begins = np.nonzero(np.concatenate((np.ones(min(1, len(name)), bool), name[1:] != name[:-1])))[0]
    if not len(begins):
        return row, name
    times = np.diff(np.append(begins, len(name)))
    held = np.repeat(np.minimum.reduceat(cls[row], begins) < np.maximum.reduceat(cls[row], begins), times)
    row, name, place, times = row[held], name[held], place[held], np.repeat(times, times)[held]
    order = np.lexsort((name, times, row))
    row, name, place = row[order], name[order], place[order]
    ok = _needed_marks(row, place, alike, spread)
    row, name = row[ok], name[ok]
    _, of, times = np.unique(name, return_inverse=True, return_counts=True)
    live = np.unique(row)
    many = np.bincount(value[row], weights=times[of] if len(of) else None, minlength=len(value)) > np.bincount(value[live], minlength=len(value)) ** 2.0
    apart, whole = ~many[value[row]], live[many[value[live]]]
    row, name = np.concatenate((row[apart], whole)), np.concatenate((name[apart], mix64(value[whole].astype(np.uint64) + np.uint64(1))))
    order = np.lexsort((cls[row], name))
    return row[order], name[order]


def _cross_meet(batches: Iterator) -> Iterator:
    """Rows of one key and pair of blocks (u, v): documents p < q of different classes that have windows with a run in common and `alike` shingles around it, over `spread` places.

    Windows meet by their rare shingles (see _by_rare_marks), not all with all.
    """
    import pyarrow as pa

    def flush(rows):
        key, u, v, mine, doc, cls, alike, spread = (rows[n].to_numpy() for n in ("key", "u", "v", "block", "doc_id", "cls", "alike", "spread"))
        around = _around_of(rows["around"])
        row, name = _rarest(_starts(key, u, v), cls, around, alike, spread)
        if not len(row):
            return
        ends = lambda begin: begin + np.bincount(begin, minlength=len(row))[begin]
        after = ends(_starts(name, cls[row]))  # the other classes of a name
        later = ends(_starts(name)) - after
        for lo, hi in _spans(np.cumsum(later), 200_000):
            x = np.repeat(np.arange(lo, hi), later[lo:hi])
            x, y = row[x], row[after[x] + _count_up(later[lo:hi])]
            # pairs within one block meet where both blocks are that one
            ok = (doc[x] != doc[y]) & ((u[x] == v[x]) | (mine[x] != mine[y]))
            x, y = np.divmod(np.unique(np.minimum(x, y)[ok] * len(key) + np.maximum(x, y)[ok]), len(key))
            for a in range(0, len(x), 4000):
                m, n = x[a : a + 4000], y[a : a + 4000]
                ok = _same_run(around[m], around[n])
                m, n = m[ok], n[ok]
                ok = np.ones(len(m), bool)
                for one, other in ((around[m], around[n]), (around[n], around[m])):
                    ok &= _in_common(one, other, alike[m], spread[m])
                m, n = m[ok], n[ok]
                if len(m):
                    p, q = np.unique(np.stack((np.minimum(doc[m], doc[n]), np.maximum(doc[m], doc[n]))), axis=1)
                    yield pa.RecordBatch.from_pydict({"p": pa.array(p), "q": pa.array(q)})

    yield from _whole(batches, ("key", "u", "v"), flush, 2 * BLOCK)


def _words(batches: Iterator) -> Iterator:
    """32 bits of each word's hash: two shingles that differ are taken for one once in four thousand million."""
    import pyarrow as pa

    for batch in slices(batches, "text", 1_000_000):
        words, sizes = hashed_words(batch.column("text"))
        upto = np.concatenate(([0], np.cumsum(4 * sizes))).astype(np.int32)
        raw = np.ascontiguousarray((words >> np.uint64(32)).astype(np.uint32))
        cells = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "words": cells})


def _places(x: np.ndarray, y: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where both texts hold the same shingle, by i and from the last j to the first.

    All copies of a shingle meet, the rarest shingles first, as far as MOST_PLACES go; the others meet by rank, the first copy with the first, the last with the last.
    apart: x and y are one text; each place meets the nearest later copy.
    """
    order_y = np.argsort(y, kind="stable")
    sorted_y = y[order_y]
    if apart:
        again = sorted_y[1:] == sorted_y[:-1]
        i, j = order_y[:-1][again], order_y[1:][again]
        order = np.argsort(i)
        return i[order], j[order]
    low, high = np.searchsorted(sorted_y, x, "left"), np.searchsorted(sorted_y, x, "right")
    i = np.nonzero(high > low)[0]
    low, copies = low[i], (high - low)[i]
    if (copies > 1).any() or len(np.unique(low)) < len(low):
        _, name, times = np.unique(low, return_inverse=True, return_counts=True)
        width = np.zeros(len(times), np.int64)
        width[name] = copies
        by = np.argsort(width * times, kind="stable")
        full = np.zeros(len(times), bool)
        full[by] = np.cumsum((width * times)[by]) <= MOST_PLACES
        by_name = np.argsort(name, kind="stable")
        rank = np.empty(len(i), np.int64)
        rank[by_name] = np.arange(len(i)) - _starts(name[by_name])
        ranked = ~full[name]
        front, back = rank, copies - times[name] + rank
        some = [(np.repeat(i[~ranked], copies[~ranked]), np.repeat(low[~ranked], copies[~ranked]) + _count_up(copies[~ranked]))]
        some += [(i[ok], (low + nth)[ok]) for nth in (front, back) for ok in (ranked & (nth >= 0) & (nth < copies),)]
        i, at = (np.concatenate(z) for z in zip(*some))
        i, back = np.divmod(_distinct(i * len(y) + (len(y) - 1 - order_y[at])), len(y))
        return i, len(y) - 1 - back
    return i, order_y[low]


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _boxes(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Places in groups that lie further than WIDEST apart in one of the texts."""
    out, todo = [], [np.arange(len(i))]
    while todo:
        box = todo.pop()
        for along in (i[box], j[box]):
            held = np.zeros(int(along.max()) + 1, bool)
            held[along] = True
            at = np.flatnonzero(held)
            cuts = at[1:][np.diff(at) > WIDEST]  # where a part begins
            if len(cuts):
                part = np.searchsorted(cuts, along, "right")
                todo += np.split(box[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part))[:-1])
                break
        else:
            out.append(box)
    return out


def _longest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of a longest chain that rises in both texts (patience sorting); places by i and from the last j to the first."""
    rows = np.nonzero(np.concatenate(([True], i[1:] != i[:-1])))[0]
    if len(i) > MANY * len(rows):
        held = np.zeros(int(j.max()) + 1, bool)
        held[j] = True
        number = np.cumsum(held) - 1
        width = int(number[-1]) + 1
        return _longest_by_bits(number[j], width, rows) if len(rows) * width <= MOST_BITS else _longest_by_rows(j, rows)
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(i)
    for k, y in enumerate(j.tolist()):
        at = bisect_left(tails, y)
        if at:
            before[k] = ends[at - 1]
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        elif y < tails[at]:
            tails[at], ends[at] = y, k
    return _traced(before, ends[-1])


def _longest_by_rows(j: np.ndarray, rows: np.ndarray) -> list[int]:
    """The same chain, all places of one i at once: as they go from the last to the first, none of them builds on another, and of those with one rank the first in y stays."""
    tails, ends, before, size, idle = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.full(len(j), -1), 0, j[:0]
    for lo, hi in zip(rows.tolist(), [*rows[1:].tolist(), len(j)]):
        row = j[lo:hi]
        if len(row) == len(idle) and (row == idle).all():  # as the row before, which changed nothing
            continue
        ys = row[::-1]
        at = tails[:size].searchsorted(ys)
        first = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate(([0], first))
        rank, y = at[first], ys[first]
        new = y < tails[np.minimum(rank, len(rows) - 1)]
        new[-1] |= rank[-1] == size
        rank, k = rank[new], hi - 1 - first[new]
        if len(rank):
            before[k] = np.where(rank > 0, ends[rank - 1], -1)
            tails[rank], ends[rank], idle, size = y[new], k, j[:0], max(size, int(rank[-1]) + 1)
        else:
            idle = row
    return _traced(before, int(ends[size - 1]))


def _longest_by_bits(at: np.ndarray, width: int, rows: np.ndarray) -> list[int]:
    """The same chain: after each i, the zero bits are the least ends in y of chains of each length, which one addition moves. at: places in y, numbered."""
    full = now = (1 << width) - 1
    sizes = np.diff(np.append(rows, len(at)))
    _, first, name = np.unique(np.add.reduceat(mix64(at.astype(np.uint64) + np.uint64(1)), rows), return_index=True, return_inverse=True)
    states, masks = [now], []
    for r in first.tolist():
        bits = np.zeros(width, np.uint8)
        bits[at[rows[r] : rows[r] + sizes[r]]] = 1
        masks.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
    for x in name.tolist():
        on = now & masks[x]
        now = (now + on | now - on) & full
        states.append(now)
    chain, t = [], len(rows)
    y = (~now & full).bit_length() - 1
    while y >= 0:
        while not states[t - 1] >> y & 1:
            t -= 1
        t -= 1
        chain.append(t * width + width - 1 - y)
        y = (~states[t] & (1 << y) - 1).bit_length() - 1
    return np.searchsorted(np.repeat(np.arange(len(rows)), sizes) * width + (width - 1 - at), chain[::-1]).tolist()


def _traced(before, k: int) -> list[int]:
    chain = []
    while k >= 0:
        chain.append(int(k))
        k = before[k]
    return chain[::-1]


def _fewest(least: int, percent: int) -> int:
    """Shared shingles of two passages of the least length."""
    return -(-2 * least * percent // (100 + percent))


def _shared(ordered: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the shingle of each place of y is among the sorted ones."""
    return ordered[np.minimum(np.searchsorted(ordered, y), len(ordered) - 1)] == y


def _reaches(score: np.ndarray, least: int, slack: int = 0) -> bool:
    """Whether some `least` places or more in a row have a sum of scores of -slack or more."""
    if len(score) < least:
        return False
    upto = np.concatenate(([0], np.cumsum(score)))
    return bool((upto[least:] - np.minimum.accumulate(upto[: len(upto) - least]) >= -slack).any())


def _sorted_with_gaps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles in order, and for each place how far before it the same shingle lies, 0 if nowhere."""
    order = np.argsort(x, kind="stable")
    ordered, gap = x[order], np.zeros(len(x), np.int64)
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    gap[order[again + 1]] = order[again + 1] - order[again]
    return ordered, gap


#: A stretch has so many shingles more, at most, than places whose shingle does not lie so near before them.
_NEAR_BEFORE = (1, 4, 16)


def _may_share(x: np.ndarray, of_x: tuple, y: np.ndarray, least: int, percent: int) -> bool:
    """Whether two texts can share a passage, by the places of each whose shingle the other holds. of_x: what _sorted_with_gaps says of x.

    A passage has as many shared places as its similarity asks for, so either side holds that share of them, and the shorter one 2 * percent / (100 + percent). As a set,
    either side has percent shared shingles at least for 100 - percent that the other text lacks.
    """
    at_y = _shared(of_x[0], y)
    if at_y.sum() < _fewest(least, percent) or not _reaches(100 * at_y - percent, least):
        return False
    of_y = _sorted_with_gaps(y)
    at_x = _shared(of_y[0], x)
    if not _reaches(100 * at_x - percent, least) or not any(_reaches((100 + percent) * at - 2 * percent, least) for at in (at_x, at_y)):
        return False
    for at, gap in ((at_y, of_y[1]), (at_x, of_x[1])):
        for near in _NEAR_BEFORE if gap.any() else ():
            new = (100 - percent) * (at & ((gap == 0) | (gap > near))) - percent * (~at & (gap == 0))
            if not _reaches(new, least, (100 - percent) * near):
                return False
    return True


def _chains(x: np.ndarray, y: np.ndarray, least: int, percent: int, apart: bool) -> list[tuple[int, int, int, int]]:
    """Half-open shingle ranges (x start, x end, y start, y end) that are alike, from the places where both hold the same shingle.

    The longest chain of places in the same order in both is cut at its widest gap until its parts reach the similarity, by places and by sets, or are too short; parts are
    carried on at their ends as far as the texts agree. What it leaves is gone through again, so passages in another order
    in the two texts are found too, down to chains too short for a passage. A gap of WIDEST shingles or more may part a passage in two, of which one still is
    long and similar enough, since three times as many shingles must be shared beside it. apart: x and y are one text.
    """
    i, j = _places(x, y, apart)
    fewest = _fewest(least, percent)
    if len(i) < fewest:
        return []
    out: list[tuple[int, int, int, int]] = []
    if (np.diff(i) > 0).all() and (np.diff(j) > 0).all():
        _cut(x, y, i, j, least, percent, out)
        return out
    for box in _boxes(i, j):
        while len(box) >= fewest:
            chain = np.array(_longest(i[box], j[box]))
            if len(chain) < fewest:
                break
            _cut(x, y, i[box[chain]], j[box[chain]], least, percent, out)
            used = np.zeros(int(i[box[-1]]) + 1, bool)
            used[i[box[chain]]] = True
            box = box[~used[i[box]]]
    # a chain may have taken its places from several repetitions; stretches that are the same in both are found all the same
    straight = _diagonals(i, j, least)
    straight = straight[np.argsort(straight[:, 0] - straight[:, 1], kind="stable")]
    for a, b, _, _ in out:
        straight = straight[~_overlap(straight, a, b)]
    while len(straight):  # the longest that is left
        out.append(tuple(straight[0].tolist()))
        straight = straight[1:][~_overlap(straight[1:], *out[-1][:2])]
    return sorted(out)


def _overlap(found: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which ranges of places have over half of their places in [a, b)."""
    return 2 * (np.minimum(found[:, 1], b) - np.maximum(found[:, 0], a)) > found[:, 1] - found[:, 0]


def _diagonals(i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Stretches of `least` shingles or more that both texts hold unchanged, from places (i, j)."""
    if not len(i):
        return np.zeros((0, 4), np.int64)
    beyond = int(i.max()) + 2  # so that the end of one diagonal is not beside the start of the next
    along = np.sort((j - i) * beyond + i)
    begins = np.nonzero(np.concatenate(([True], np.diff(along) != 1)))[0]
    sizes = np.diff(np.append(begins, len(along)))
    begins, sizes = begins[sizes >= least], sizes[sizes >= least]
    off, i = np.divmod(along[begins], beyond)
    return np.stack((i, i + sizes, i + off, i + off + sizes), axis=1)


def _sets(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and union of two sequences' sets."""
    m, n = _distinct(x), _distinct(y)
    both = int(_shared(m, n).sum())
    return both, len(m) + len(n) - both


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _alike_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both, either = _sets(x, y)
    return 100 * both >= percent * either


def _cut(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, percent: int, out: list) -> None:
    todo = [(0, len(i))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        i0, j0, i1, j1, same = int(i[a]), int(j[a]), int(i[b - 1]) + 1, int(j[b - 1]) + 1, b - a
        while i0 and j0 and x[i0 - 1] == y[j0 - 1]:
            i0, j0, same = i0 - 1, j0 - 1, same + 1
        while i1 < len(x) and j1 < len(y) and x[i1] == y[j1]:
            i1, j1, same = i1 + 1, j1 + 1, same + 1
        n, m = i1 - i0, j1 - j0
        if min(n, m) >= least and 100 * same >= percent * (n + m - same) and _alike_sets(x[i0:i1], y[j0:j1], percent):
            out.append((i0, i1, j0, j1))
        elif min(n, m) >= least:
            gaps = np.diff(i[a:b]) + np.diff(j[a:b])
            k = a + 1 + int(gaps.argmax())
            todo += [(a, k), (k, b)]


def passages_of(p: int, xs: np.ndarray, q: int, ys: np.ndarray, least: int, percent: int) -> list[list[int]]:
    """Passages that two texts (sequences of shingles) share: aligned, long and similar enough as sets of shingles."""
    out = []
    for s in _chains(xs, ys, least, percent, p == q):
        if p == q and s[2] < s[1]:
            continue
        both, either = _sets(xs[s[0] : s[1]], ys[s[2] : s[3]])
        if 100 * both >= percent * either:
            out.append([p, s[0], s[1] + WIDTH - 1, q, s[2], s[3] + WIDTH - 1, both, either])
    return out


_FOUND = ("p", "p_start", "p_end", "q", "q_start", "q_end", "shared", "either")


def _verify(least_words: int, percent: int):
    """A document (kind 0) comes before those it is paired with (kind 1), so that its text travels once for many pairs."""
    least = least_words - WIDTH + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, xs, of_xs = None, None, None
        for batch in batches:
            out: list[list[int]] = []
            for p, part, kind, q, words in zip(*(batch.column(c).to_pylist() for c in ("p", "part", "kind", "q")), batch.column("words")):
                shingles = shingle_hashes(mix64(np.frombuffer(words.as_buffer(), np.uint32).astype(np.uint64) + np.uint64(1)), WIDTH)
                if kind == 0:
                    now, xs, of_xs = (p, part), shingles, _sorted_with_gaps(shingles)
                elif now == (p, part) and (p == q or _may_share(xs, of_xs, shingles, least, percent)):
                    out += passages_of(p, xs, q, shingles, least, percent)
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(_FOUND)})

    return run


def _prints(batches: Iterator) -> Iterator:
    """Fingerprint of each text's words, and their number."""
    import pyarrow as pa
    import xxhash

    for batch in slices(batches, "text"):
        words = [words_of(x, lower=True) for x in batch.column("text").to_pylist()]
        prints = [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": prints, "n": pa.array([len(w) for w in words], pa.int64())})


def _hot_values(docs: DataFrame, least_words: int, keep: Callable) -> np.ndarray:
    """Values that many documents hold, from the windows of one document in SAMPLE; HOT of them at most reach the driver.

    They only decide over how many tasks a value's rows are dealt: those above a ten-thousandth of all rows.
    """
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_windows(least_words, np.zeros(0, np.int64)), _ROWS).groupBy("key").count()
    counts = keep(counts.filter(F.col("count") >= 16), "hot")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter(F.col("count") > total / HOT).orderBy(F.col("count").desc(), "key").limit(HOT).select("key")
    return np.array([r.key for r in hot.collect()], np.int64)


def _verified(docs: DataFrame, pairs: DataFrame, least_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The passages that pairs (p, q) of documents share."""
    keep = scratch.keep
    ends = pairs.select(F.col("p").alias("d")).unionByName(pairs.select(F.col("q").alias("d")))
    needed = keep(ends.distinct(), "needed")
    if needed.count() <= MOST_BROADCAST:
        needed = F.broadcast(needed)
    words = keep(docs.join(needed, docs["doc_id"] == needed["d"]).select("doc_id", "text").mapInArrow(_words, "doc_id long, words binary"), "passage-words")
    parts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts"))
    x = words.join(parts, F.col("doc_id") == F.col("p")).select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("p").alias("q"), "words")
    y = pairs.join(parts, "p").select("p", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "q").join(words, F.col("q") == F.col("doc_id")).drop("doc_id")
    dealt = x.unionByName(y).repartition("p", "part").sortWithinPartitions("p", "part", "kind", "q")
    return dealt.mapInArrow(_verify(least_words, percent), ", ".join(f"{n} long" for n in _FOUND))


def _shared_runs(docs: DataFrame, label: DataFrame, least_words: int, alike: int = ALIKE, spread: int = 1, keep: Callable = lambda df, tag: df) -> DataFrame:
    """Windows (key, doc_id, around) of values that lie in two classes or more, with the class (cls), dealt to pairs of blocks (u, v), so that no task holds more than two blocks of a value.

    Values of more than one block are parted by rare shingles first; see _by_rare_marks. alike, spread: how many shingles two windows must have in common, and over how many places.
    """
    labelled = docs.join(label, docs["doc_id"] == label["u"], "left").select("doc_id", F.coalesce("v", "doc_id").alias("cls"), "text")
    of = Window.partitionBy("key")
    places = labelled.mapInArrow(_run_places(least_words), "key long, doc_id long, cls long, at int")
    places = places.withColumns({"n": F.count(F.lit(1)).over(of), "a": F.min("cls").over(of), "b": F.max("cls").over(of)}).filter("a < b")
    places = keep(places.select("key", "doc_id", "cls", "at", "n"), "run-places")
    by_doc = places.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("key", "n", "at")).alias("held"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), "cls", F.col("held.key").alias("keys"), F.col("held.n").alias("n"), F.col("held.at").alias("at"))
    needed = places.select(F.col("doc_id").alias("d")).distinct()
    if needed.count() <= MOST_BROADCAST:
        docs = docs.join(F.broadcast(needed), docs["doc_id"] == needed["d"], "left_semi")
    rows = docs.join(by_doc, docs["doc_id"] == by_doc["d"]).select("doc_id", "cls", "text", "keys", "n", "at")
    rows = keep(rows.mapInArrow(_surroundings, "key long, n long, doc_id long, cls long, around binary"), "runs")
    if not places.filter(F.col("n") > BLOCK).isEmpty():
        rows = rows.filter(F.col("n") <= BLOCK).unionByName(_by_rare_marks(rows.filter(F.col("n") > BLOCK), alike, spread))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id", "around"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "doc_id", "cls", "around", "block", other)
    return rows.select("key", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "doc_id", "cls", "around", F.lit(alike).alias("alike"), F.lit(spread).alias("spread"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = 75) -> DataFrame:
    """Near-duplicate passages between texts of (doc_id, text): one row per document that repeats a passage of a partner.

    doc_id, start_word, n_words: the passage in this document; partner_id, partner_start, partner_words: its counterpart in the
    partner; similarity: of their sets of 5-word shingles; class_id: the smallest document linked to it through such rows.

    0. Texts of the same words are one text from here on, under the smallest doc_id; each copy gives one row with its
       whole length, and the text they stand under one with its first copy.
    1. Eight hash functions give compact windows of 50 words or more; rows of one value (function and min-hash) share a min-hash.
    2. Within a value every window meets the window of the smallest document, if any of the shingles 6 and 22 places to either side of the anchors is the same, and
       that of the smallest document which has both shingles to the left, or both to the right. So a passage that thousands of documents share makes a
       few pairs for each, not all pairs, and documents that share a passage meet even where the value is but a common phrase that the smallest document
       holds too: of a passage's 46 shingles, 22 lie on one side of any. Values that a large part of the corpus holds are dealt by document to several
       tasks, whose firsts meet.
    3. Interval join across hash functions: a pair is a candidate if windows of two functions or more overlap, so that one
       passage can lie in all of them.
    4. Candidates are verified on the texts' words: shingles are aligned in longest rising chains, which must reach 50 words and a similarity of 0.75.
    5. The exact rest: two such passages always share RUN shingles in a row, so their documents have a compact window of RUN shingles in common, by one
       function. Documents in different classes that share such a run, and are alike around it, are all verified, in blocks of windows where a value has many.
       So no link between two classes is lost; pairs within one class are reported where step 2 or 5 made them meet.

    A document's words are lower-cased. Documents of fewer words, null texts and rows without doc_id take no part; of rows that share a doc_id the
    largest text counts. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    prints = docs.mapInArrow(_prints, "doc_id long, print string, n long").filter(F.col("n") >= least_words)
    prints = keep(prints.groupBy("doc_id").agg(F.max(F.struct("n", "print")).alias("m"), F.count(F.lit(1)).alias("rows")).select("doc_id", "m.*", "rows"), "prints")
    first_of = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))
    copies = keep(prints.join(first_of, "print").filter("doc_id <> rep").select("doc_id", "rep", "n"), "copies")
    gone = copies.select(F.col("doc_id").alias("d")).distinct()
    if copies.count() <= MOST_BROADCAST:  # 8 MB of ids; beyond that the texts are shuffled to them
        gone = F.broadcast(gone)
    docs = docs.join(gone, docs["doc_id"] == gone["d"], "left_anti")
    repeated = keep(prints.filter("rows > 1").select(F.col("doc_id").alias("d")), "repeated")
    if not repeated.isEmpty():  # rows that share a doc_id
        several = docs.join(repeated, docs["doc_id"] == repeated["d"], "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.size(F.split("text", r"[\x20\x09-\x0D]+")), "text"))["text"].alias("text"))
        docs = docs.join(repeated, docs["doc_id"] == repeated["d"], "left_anti").unionByName(several)
    buckets = _buckets(prints.agg(F.sum("n")).first()[0] or 0)
    rows = docs.mapInArrow(_bucketed(least_words, _hot_values(docs, least_words, keep), buckets), _BUCKETS)
    met = keep(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(True), _MET), "met-windows")
    zero = F.lit(0)
    firsts = met.filter("held = 0").select(F.col("q").alias("key"), zero.alias("salt"), F.col("p").alias("doc_id"), F.col("low").alias("span"), zero.alias("around"))
    second = firsts.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(False), _MET)
    pairs = met.filter("held > 0").unionByName(second)
    candidates = pairs.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(_agree, "p long, q long")
    candidates = keep(candidates, "passage-pairs")
    scratch.drop(met)

    found = keep(_verified(docs, candidates, least_words, percent, scratch), "passages")
    same = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    label = stars(found.select(F.col("p").alias("u"), F.col("q").alias("v")), keep)

    # what is not in one class by now meets wherever it shares a run
    runs = _shared_runs(docs, label, least_words, HELD, SPREAD, keep)
    crossing = runs.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(_cross_meet, "p long, q long").distinct()
    crossing = keep(crossing.join(candidates, ["p", "q"], "left_anti"), "crossing-pairs")
    if not crossing.isEmpty():
        found = keep(found.unionByName(_verified(docs, crossing, least_words, percent, scratch)), "all-passages")

    similarity = (F.col("shared") / F.col("either")).alias("similarity")
    side = lambda a, b: found.select(
        F.col(a).alias("doc_id"), F.col(f"{a}_start").alias("start_word"), (F.col(f"{a}_end") - F.col(f"{a}_start")).alias("n_words"),
        F.col(b).alias("partner_id"), F.col(f"{b}_start").alias("partner_start"), (F.col(f"{b}_end") - F.col(f"{b}_start")).alias("partner_words"), similarity)
    zero = F.lit(0).cast("long")
    back = copies.groupBy("rep").agg(F.min(F.struct("doc_id", "n")).alias("m")).select(F.col("rep").alias("doc_id"), F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"))
    whole = copies.unionByName(back).select(
        "doc_id", zero.alias("start_word"), F.col("n").alias("n_words"), F.col("rep").alias("partner_id"), zero.alias("partner_start"), F.col("n").alias("partner_words"), F.lit(1.0).alias("similarity"))
    label = stars(found.select(F.col("p").alias("u"), F.col("q").alias("v")).unionByName(same), keep)
    both = side("q", "p").unionByName(side("p", "q")).unionByName(whole).join(label, F.col("doc_id") == F.col("u"), "left")
    out = both.select("doc_id", "start_word", "n_words", "partner_id", "partner_start", "partner_words", "similarity", F.coalesce("v", "doc_id").alias("class_id"))
    return scratch.result(out, "repeated-passages")

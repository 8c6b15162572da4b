"""Target-distribution importance resampling over hashed word runs, with overlap chunking of long texts.

A document's features are its runs of one to WIDTH consecutive words. Every feature falls into one of BUCKETS buckets by crc32; a bucket's gain says how much more of
the target than of the corpus lies in it, a document's weight is the sum of its features' gains, and seeded Gumbel noise turns weights into a weighted
draw without replacement.

Long texts are cut at word boundaries into chunks that are dealt to other tasks. A chunk owns the features that start in it, and carries the WIDTH - 1 words after it,
which those features may need; so each feature counts once, in one chunk, and a document's counts and weight are the sums over its chunks.

Checksums of runs are put together from those of their words: appending n bytes to a text is a linear map of its checksum, tabulated by n.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, slices

BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes beyond which a text is cut into chunks of this size.
CHUNK = 16_384
#: Letters A-Z in lower case; letters, digits and bytes of other characters stay; everything else parts words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def chunks(raw: bytes, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """Parts of a text of `size` bytes or up to the end of the word there, each with the WIDTH - 1 words that follow it."""
    said, a = raw.translate(_FOLDED), 0
    while a < len(said):
        b = said.find(b" ", a + size)
        b = c = len(said) if b < 0 else b
        for _ in range(WIDTH - 1):
            word = _WORD.search(said, c)
            c = word.end() if word else c
        yield said[a:b], said[b:c]
        a = b


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What 0 to 63 appended bytes, and 64, 128, 256, ..., do to each byte of a checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    few = []
    for _ in range(65):
        few.append(now)
        now = (now >> 8) ^ step[now & 255]
    many = [few.pop()]
    while len(many) < 26:
        many.append(_mapped(many[-1].ravel(), many[-1].ravel(), 0).reshape(4, 256))
    return np.stack(few).ravel(), [x.ravel() for x in many]


def _mapped(sums: np.ndarray, table: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Checksums through the linear map whose table begins at `at`."""
    byte = lambda k: (sums >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64) + 256 * k + at
    return table[byte(0)] ^ table[byte(1)] ^ table[byte(2)] ^ table[byte(3)]


_FEW, _MANY = _tables()


def appended(sums: np.ndarray, more: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums of texts of checksum `sums`, each followed by n bytes of checksum `more`."""
    out = _mapped(sums, _FEW, (n & 63) << 10)
    for k, table in enumerate(_MANY):
        long = n >> (6 + k)
        if not long.any():
            break
        odd = (long & 1).astype(bool)
        if odd.any():
            out[odd] = _mapped(out[odd], table, 0)
    return out ^ more


def features(parts: list[tuple[bytes, bytes | None]], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of parts (own text, carried text): the number of own words of each, and for each length of run the part and the bucket of every run that starts in it."""
    found: list[bytes] = []
    owned, ends = [], []
    for own, carried in parts:
        words = own.translate(_FOLDED).split()
        found += words
        owned.append(len(words))
        if carried:
            found += carried.split()
        ends.append(len(found))
    known: dict[bytes, int] = {}
    at = np.array([known.setdefault(w, len(known)) for w in found], np.int64)
    count = len(known)
    alone = np.fromiter(map(zlib.crc32, known), np.uint32, count)
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, count)
    sizes = np.fromiter(map(len, known), np.int64, count) + 1
    owned, ends = np.array(owned, np.int64), np.array(ends, np.int64)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    part = np.repeat(np.arange(len(owned)), owned)
    place = np.arange(len(part)) + np.repeat(begins - (np.cumsum(owned) - owned), owned)
    sums, out = alone[at[place]], []
    for width in range(1, WIDTH + 1):
        if width > 1:
            inside = place + width - 1 < ends[part]
            part, place, sums = part[inside], place[inside], sums[inside]
            last = at[place + width - 1]
            sums = appended(sums, spaced[last], sizes[last])
        out.append((part, (sums % np.uint32(buckets)).astype(np.int64)))
    return owned, out


def _cut(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "own", 1_000_000):
            for row, own in zip(batch.column("row").to_pylist(), batch.column("own").to_pylist()):
                rows = list(chunks(own, size))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row] * len(rows), pa.int64()), "nth": pa.array(range(len(rows)), pa.int64()), "own": pa.array([r[0] for r in rows], pa.binary()), "carried": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _parts(batch) -> list[tuple[bytes, bytes | None]]:
    return [(own or b"", carried) for own, carried in zip(batch.column("own").to_pylist(), batch.column("carried").to_pylist())]


def _counted(buckets: int):
    """A task's features by bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "own"):
            for _, found in features(_parts(batch), buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return run


def _weighed(shared):
    """Words, features and weight of each part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gains = shared.value
        for batch in slices(batches, "own"):
            words, found = features(_parts(batch), len(gains))
            n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for part, bucket in found:
                n += np.bincount(part, minlength=len(words))
                upto = np.concatenate(([0], np.cumsum(gains[bucket])))
                edges = np.searchsorted(part, np.arange(len(words) + 1))
                weight += upto[edges[1:]] - upto[edges[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def _pieces(docs: DataFrame, size: int, keep: Callable) -> tuple[DataFrame, DataFrame]:
    """row, doc_id, own, carried: short texts whole, where they are, and without row; long ones in chunks that are dealt out, with a number for each text. Also row and doc_id of the long ones."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("own"))
    short = own.filter(F.octet_length("own") <= size).select(F.lit(None).cast("long").alias("row"), "doc_id", "own", F.lit(None).cast("binary").alias("carried"))
    long = keep(own.filter(F.octet_length("own") > size).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    cut = long.select("row", "own").mapInArrow(_cut(size), "row long, nth long, own binary, carried binary").repartition("row", "nth")
    return short.unionByName(keep(cut.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)), "chunks").select("row", "doc_id", "own", "carried")), long.select("row", "doc_id")


def _bucket_counts(pieces: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    counted = pieces.select("own", "carried").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how often the target falls into a bucket against the corpus), one added to each bucket of both."""
    of, to = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    ratio = lambda s, t: (float(t + 1) * float(of)) / (float(s + 1) * float(to))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text) as a draw towards target (text).

    Of the N documents with least_words words or more floor(percent * N / 100) are drawn, by score, ties to the smaller doc_id; rank is their place, null for all
    others. Words: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. score: weight + floor(-1000 * ln(-ln(u))), u from sha256 of
    "seed:doc_id".

    Null and empty texts have no words and weight 0. A null doc_id counts as empty in the noise and comes last among ties. Repeated rows are documents of their own;
    equal ones get ranks one after another. Empty tables give no rows, an empty target leaves the corpus against the uniform share of buckets.
    Extra columns are ignored.

    1. Short texts stay where they are; chunks of long ones are written once, dealt by text and chunk, so no task has more than CHUNK bytes of one text.
    2. Every task sums its features by bucket; bucket counts of corpus and target (10,000 numbers) come to the driver, gains go back.
    3. Weights of chunks are summed by text.
    4. Scores are ordered by range partitioning; a partition's rows are numbered in place, and one count per partition says where it begins.
    """
    scratch = Scratch(docs.sparkSession)
    pieces, long = _pieces(docs, chunk, scratch.keep)
    aims, _ = _pieces(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), chunk, scratch.keep)
    gains = bucket_gains(_bucket_counts(pieces, buckets), _bucket_counts(aims, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = pieces.mapInArrow(_weighed(docs.sparkSession.sparkContext.broadcast(gains)), f"row long, doc_id {kind}, n_words long, n_features long, weight long")
    weighed = scratch.keep(weighed, "weights")
    sums = ["n_words", "n_features", "weight"]
    summed = weighed.filter("row is not null").groupBy("row").agg(*[F.sum(c).alias(c) for c in sums])
    whole = long.join(summed, "row").select("doc_id", *sums).unionByName(weighed.filter("row is null").select("doc_id", *sums))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    whole = scratch.keep(whole.withColumn("score", F.col("weight") + noise), "scores")
    enough = whole.filter(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # the id of a row is its partition's number and its place there
    placed = enough.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.keep(placed, "score-order").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    starts = sizes.select("part", before.alias("before"), F.floor(percent * total / 100).alias("drawn"))  # a row a partition
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    columns = ["doc_id", *sums, "score", "rank"]
    rest = whole.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return scratch.result(ranked.select(*columns).unionByName(rest.select(*columns)), "resampled")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents of the draw, with all their columns; rows that share a doc_id are drawn together, those without one not at all."""
    drawn = importance_resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == drawn["_drawn"], "left_semi")

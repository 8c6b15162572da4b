"""MinHash near-dedup: banded candidates, odd sketches, confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, WordHasher, mix64, shingle_hashes, slices, words_of
from .components import connect

BANDS, ROWS, BITS = 40, 5, 512
#: Bits of the parity bitmap of a whole set, and the most node ids that are broadcast (8 bytes each).
SET_BITS, MOST_BROADCAST = 1024, 1_000_000
_SAMPLES = BANDS * ROWS


def _permutations(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    steps = mix64(np.arange(2 * _SAMPLES, dtype=np.uint64) + np.uint64(seed << 32))
    return (steps[:_SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (steps[_SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over a set of 64-bit shingle hashes."""
    top = (shingles >> np.uint64(32)).astype(np.uint32)
    low = None
    for i in range(0, len(top), 1024):
        values = top[i : i + 1024][None, :] * a[:, None]
        values += b[:, None]
        least = values.min(axis=1)
        low = least if low is None else np.minimum(low, least)
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every (place, sample) flips one of BITS bits; rows of BITS / 64 words."""
    n, k = samples.shape
    place = mix64(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    at = (np.arange(n, dtype=np.int64)[:, None] * BITS + place.astype(np.int64)).ravel()
    parity = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(parity, axis=1).view(np.int64).reshape(n, BITS // 64)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set itself; two sets differ in at least as many elements as their bitmaps in bits."""
    at = (shingles >> np.uint64(20)) % np.uint64(SET_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SET_BITS) & 1).astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS samples."""
    n = len(samples)
    parts = samples.reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (n, BANDS))
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def most_differing_bits(similarity: float, slack: float) -> int:
    """Bits in which two sketches differ at most if their sets' similarity, less slack, is reached.

    Sets of similarity J differ in about 2k(1 - J) samples; throwing those at n bits leaves n/2 (1 - (1 - 2/n)^(2k(1-J))) odd ones.
    """
    thrown = 2 * _SAMPLES * (1 - similarity + slack)
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** thrown))


def _signatures(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    hashed, (a, b) = WordHasher(), _permutations()
    for batch in slices(batches, "text", 2_000_000):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        sizes, digests, samples, filled, parities = [], [], [], [], []
        for k, text in enumerate(texts):
            words = words_of(text, lower=True)
            sizes.append(0)
            digests.append((None, None))
            if words and ids[k] is not None:
                found = np.unique(shingle_hashes(hashed(words)))
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                digests[k] = ((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63))
                samples.append(minhashes(found, a, b))
                parities.append(set_parity(found))
                filled.append(k)
                sizes[k] = len(found)
            elif words:
                sizes[k] = len(np.unique(shingle_hashes(hashed(words))))
        sketches, bands = [None] * len(ids), [None] * len(ids)
        if filled:
            matrix = np.stack(samples)
            whole = np.hstack((odd_sketches(matrix), np.stack(parities)))
            for k, s, t in zip(filled, whole.tolist(), band_keys(matrix).tolist()):
                sketches[k], bands[k] = s, t
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "s1": pa.array([x for x, _ in digests], pa.int64()), "s2": pa.array([x for _, x in digests], pa.int64()),
            "sketch": pa.array(sketches, pa.list_(pa.int64())), "bands": pa.array(bands, pa.list_(pa.int64()))})


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    hashed = WordHasher()
    for batch in slices(batches, "text", 2_000_000):
        sets = [np.unique(shingle_hashes(hashed(words_of(x, lower=True)))).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "shingles": pa.array(sets, pa.binary())})


def _confirm(percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q)
                merged = np.concatenate((p, q))
                merged.sort()
                shared = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    return run


def _differing(x: str, y: str, start: int, bits: int) -> Column:
    """Bits in which the words from start on of two nodes' bitmaps differ."""
    words = [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(start, start + bits // 64)]
    return sum(words[1:], words[0])


def _close(x: str, y: str, percent: int, slack: float) -> Column:
    """Whether two nodes can reach the similarity.

    First by the MinHash odd sketches' estimate, less slack; then by a bound that loses nothing: sets with n + m elements that
    differ in d or more reach (n + m - d) / (n + m + d) at most, and d is at least the bits that their set parities differ in.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    estimate = _differing(x, y, 0, BITS) <= most_differing_bits(percent / 100, slack)
    apart = _differing(x, y, BITS // 64, SET_BITS)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & estimate & (100 * (n + m - apart) >= percent * (n + m + apart))


def near_duplicates(docs: DataFrame, percent: int = 75, slack: float = 0.16) -> DataFrame:
    """Groups of near copies among (doc_id, text): one row per row of docs.

    1. Each text's set of 5-word shingles gives 200 MinHash samples; 40 bands of 5 are the candidate keys and an odd
       sketch of 512 parity bits folds them all. Equal sets are one node, named by its smallest doc_id, so groups of
       exact copies, however large, go on as one row. A link of similarity 0.75 shares no band once in 50,000.
    2. In every bucket all members are compared with the bucket's smallest member only. Pairs whose sketches
       differ in more bits than similarity - slack allows are out (slack is over four standard errors); for each
       node the pair with the closest sketches is confirmed first, on full sets. A parity bitmap of the whole set
       adds a bound that loses no link, so that pairs just below the similarity don't pile up.
    3. Confirmed links join components. Pairs that would join two components are confirmed in turn, then pairs of
       other members of a bucket that lie in different components, until nothing new is left. So no link
       between components goes unchecked, and a group of near copies costs its size, not its square.

    Null or empty texts, or texts without words, have no shingles and are linked with nothing; rows without doc_id
    likewise (component_id null, kept). Rows that share a doc_id count as one document. Extra columns are ignored.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    docs = docs.select("doc_id", "text")
    signed = keep(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>, bands array<long>"), "signatures")
    filled = signed.filter("s1 is not null")
    classes = keep(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    f, c = filled.alias("f"), classes.alias("c")
    nodes = f.join(c, (F.col("f.s1") == F.col("c.s1")) & (F.col("f.s2") == F.col("c.s2")) & (F.col("f.doc_id") == F.col("c.node")))
    nodes = keep(nodes.select("node", F.col("n_shingles").alias("n"), "f.s1", "sketch", "bands").dropDuplicates(["node", "s1"]).drop("s1"), "nodes")
    sketches = nodes.select("node", "n", "sketch")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    shared = keep(banded.join(hubs, "key"), "buckets")
    pairs = shared.filter("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    p = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.node")).join(sketches.alias("y"), F.col("b") == F.col("y.node"))
    pool = keep(p.filter(_close("x", "y", percent, slack)).select("a", "b", _differing("x", "y", 0, BITS).alias("bits")), "pool")

    def confirmed(some: DataFrame) -> DataFrame:
        """a, b, linked of each pair, by the exact sizes of intersection and union."""
        needed = some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
        needed = keep(needed, "needed")
        if needed.count() <= MOST_BROADCAST:  # 8 MB of ids; beyond that the texts are shuffled to them
            needed = F.broadcast(needed)
        d = docs.filter("doc_id is not null and text is not null")
        sets = d.join(needed, d["doc_id"] == needed["node"]).select("node", "text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node", "shingles"])
        sets = keep(sets, "sets")
        joined = some.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return keep(joined.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "confirmed")

    labels = sketches.select("node", F.col("node").alias("label")).distinct()
    tried = None

    def settle(some: DataFrame) -> None:
        """Confirm pairs and join the components that they link."""
        nonlocal labels, tried
        result = confirmed(some)
        tried = result if tried is None else tried.unionByName(result)
        labels = keep(connect(labels, result.filter("linked").select("a", "b"), keep), "labels")

    def apart(some: DataFrame) -> DataFrame:
        """Pairs not tried yet whose ends lie in different components."""
        l, r = labels.alias("l"), labels.alias("r")
        found = some.join(l, F.col("a") == F.col("l.node")).join(r, F.col("b") == F.col("r.node")).filter("l.label <> r.label").select("a", "b")
        return found.join(tried, ["a", "b"], "left_anti")

    if not pool.isEmpty():
        best = pool.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        settle(best)
        more = keep(apart(pool), "more")
        if not more.isEmpty():
            settle(more)
    members = shared.filter("node > hub")
    while True:
        # members other than the hub, in buckets that still hold several components
        m = members.join(labels, "node")
        split = m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
        m = m.join(split, "key", "left_semi").join(sketches, "node").select("key", "node", "label", "n", "sketch")
        # sets alike in size lie in the same class of sizes or in neighbouring ones, so a crowded bucket is dealt by size
        size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
        x, y = m.withColumn("size", size).alias("x"), m.withColumn("size", F.explode(F.array(size - 1, size, size + 1))).alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & _close("x", "y", percent, slack)
        found = x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        more = keep(found.join(tried, ["a", "b"], "left_anti") if tried is not None else found, "more")
        if more.isEmpty():
            break
        settle(more)
    member = classes.join(labels, "node").select("s1", "s2", F.col("label").alias("component"))
    s, g = signed.alias("s"), member.alias("g")
    joined = s.join(g, (F.col("s.s1") == F.col("g.s1")) & (F.col("s.s2") == F.col("g.s2")), "left")
    component = F.coalesce(F.col("g.component"), F.col("s.doc_id"))
    out = joined.select("s.doc_id", "s.n_shingles", component.alias("component_id"), F.coalesce(F.col("s.doc_id") == component, F.lit(True)).alias("kept"))
    return scratch.result(out, "near-duplicates")


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with all their columns, of each group of near copies the smallest doc_id alone.

    Rows that share a doc_id stay or go together; rows without doc_id, and null or empty texts, stay. An empty table gives no rows.
    """
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


#: The same as SQL: every pair of documents that share a shingle is counted.
ORACLE = f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') as w from documents),
p as (select doc_id, len(w) as n, generate_subscripts(w, 1) as i, unnest(w) as x from w),
g as (select doc_id, n, i, concat_ws(' ', x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o) as shingle from p window o as (partition by doc_id order by i)),
s as (select distinct doc_id, shingle from g where i <= greatest(1, n - 4)),
c as (select doc_id, count(*) as n_shingles from s group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select u, v from shared join c x on x.doc_id = u join c y on y.doc_id = v where 100 * n >= 75 * (x.n_shingles + y.n_shingles - n)),
e as (select u, v from l union all select v, u from l),
r as (with recursive t(d, z) as (select doc_id, doc_id from documents union select t.d, e.v from t join e on e.u = t.z) select d, z from t),
k as (select d, min(z) as component_id from r group by d)
select w.doc_id, cast(coalesce(n_shingles, 0) as bigint) as n_shingles, component_id, w.doc_id = component_id as kept from w left join c using (doc_id) join k on k.d = w.doc_id"""

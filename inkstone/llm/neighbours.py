"""Approximate nearest neighbours on shifted space-filling curves.

Several Hilbert orderings of projected vectors are sorted by range partitioning; a query meets the rows in windows around the places of its key
and of keys beside it in each order, and the windows' finds are merged and reranked by exact distance. The length of the windows is fitted to a
recall that brute force measures on a bounded sample of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

CURVES, AXES, DEPTH, PROBES = 4, 16, 2, 32
#: Rows of the shortest window, rows that meet queries at a time, rows the curves are fitted on, and queries the windows are fitted on.
LEAST_WINDOW, PIECE, FIT_ROWS, FIT_QUERIES = 256, 4096, 4096, 128
#: Cells along an axis end at these multiples of the spread, the quartiles of a normal spread.
_CUTS = np.array([-0.6744897501960817, 0.0, 0.6744897501960817])


def hilbert_keys(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows of AXES coordinates below 2^depth).

    Works on the coordinates' bits from the highest down: where a bit is set the lower bits of the first coordinate are
    flipped, otherwise they are exchanged with the first coordinate's; a Gray decoding across the coordinates ends it.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    n, bit = len(x), 1 << (depth - 1)
    q = bit
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = bit
    while q > 1:
        gray ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ gray) >> b) & 1)
    return key


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_size(batches: Iterator) -> Iterator:
    """Parts of batches whose vectors have one length, with the vectors as a matrix."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("embedding")))
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            yield int(size), part, _matrix(part.column("embedding"))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-zero vector of finite components, equal rows once."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)).distinct()


class Curves:
    """Axes of every curve for each length of vectors, fitted on a bounded sample of rows.

    A curve's axes are a random rotation of the sample's leading principal directions (those that hold 95 % of its variance, AXES at least);
    along each axis a cell is a quantile range of the sample's spread.
    """

    def __init__(self, sample: list[np.ndarray], seed: int = 11):
        self.seed, self.fitted, self.rows = seed, {}, {}
        for size in {len(x) for x in sample}:
            rows = np.stack([x for x in sample if len(x) == size])
            self.rows[size] = rows
            with np.errstate(all="ignore"):
                centre = rows.mean(0)
                _, spread, directions = np.linalg.svd(np.nan_to_num(rows - centre), full_matrices=False)
                share = np.cumsum(spread**2) / max(float((spread**2).sum()), 1e-300)
            leading = directions[: max(AXES, int(np.searchsorted(np.nan_to_num(share), 0.95)) + 1)]
            self.fitted[size] = (centre, [self._axes(leading, rows - centre, c) for c in range(CURVES)])

    def parts(self) -> tuple[int, dict, dict]:
        """What is sent to the executors, which need no copy of this class."""
        return self.seed, self.fitted, self.rows

    @classmethod
    def of_parts(cls, seed: int, fitted: dict, rows: dict) -> Curves:
        out = cls([], seed)
        out.fitted, out.rows = fitted, rows
        return out

    def _axes(self, leading: np.ndarray, rows: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed + curve)
        turn = np.linalg.qr(draw.normal(size=(max(len(leading), AXES), AXES)))[0][: len(leading)]
        axes = leading.T @ turn
        return axes, np.maximum(np.nan_to_num((rows @ axes).std(0)), 1e-300)

    def of(self, size: int):
        if size not in self.fitted:  # no row of this length in the sample: unit spread along random axes
            eye = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(size, size)))[0] if size <= 4096 else np.eye(size, AXES).T
            self.fitted[size] = (np.zeros(size), [self._axes(eye, np.eye(2, size), c) for c in range(CURVES)])
        return self.fitted[size]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        centre, curves = self.of(vectors.shape[1])
        axes, spread = curves[curve]
        with np.errstate(all="ignore"):
            place = np.nan_to_num((vectors - centre) @ axes / spread)
        cuts = _CUTS  # quantiles of a normal spread
        return hilbert_keys(np.searchsorted(cuts, place.ravel()).reshape(place.shape))


def _codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One signed byte a component, the step that a byte stands for, and how far the coded vector lies from the true one."""
    step = np.abs(vectors).max(1) / 127
    codes = np.rint(vectors / step[:, None])
    gap = vectors - codes * step[:, None]
    return codes.astype(np.int8), step, np.sqrt((gap**2).sum(1)) * (1 + 1e-9)


_ORDER = "curve int, size int, key long, kind int, id long, probe int, code binary, step double, gap double"


def _row_keys(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        curves = Curves.of_parts(*shared.value[0])
        for size, part, vectors in _by_size(batches):
            codes, step, gap = _codes(vectors)
            n, raw = len(vectors), [x.tobytes() for x in codes]
            for c in range(CURVES):
                yield pa.RecordBatch.from_pydict({
                    "curve": pa.array(np.full(n, c, np.int32)), "size": pa.array(np.full(n, size, np.int32)), "key": pa.array(curves.keys(vectors, c)), "kind": pa.array(np.ones(n, np.int32)),
                    "id": part.column("vec_id").cast(pa.int64()), "probe": pa.array(np.full(n, -1, np.int32)), "code": pa.array(raw, pa.binary()), "step": pa.array(step), "gap": pa.array(gap)})

    return run


def _probe_keys(shared):
    """Keys at which a query looks: its own, and those of seeded points about as far from it as a kth neighbour is."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts, far = shared.value
        curves = Curves.of_parts(*parts)
        for size, part, vectors in _by_size(batches):
            n, ids = len(vectors), part.column("vec_id").to_pylist()
            centre = curves.of(size)[0]
            away = vectors - centre
            norm = np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
            noise = np.stack([np.random.default_rng((i & (1 << 63) - 1, 5)).normal(size=(PROBES, size)) for i in ids])
            noise *= far.get(size, 0.0) / np.maximum(np.linalg.norm(noise, axis=2, keepdims=True), 1e-300)
            noise[:, 0] = 0
            for probe in range(PROBES):
                moved = away + noise[:, probe]
                moved *= norm / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
                for c in range(CURVES):
                    i32 = lambda x: pa.array(np.full(n, x, np.int32))
                    none = lambda t: pa.nulls(n, t)
                    yield pa.RecordBatch.from_pydict({
                        "curve": i32(c), "size": i32(size), "key": pa.array(curves.keys(moved + centre, c)), "kind": i32(0), "id": pa.array(ids, pa.int64()), "probe": i32(probe),
                        "code": none(pa.binary()), "step": none(pa.float64()), "gap": none(pa.float64())})

    return run


def _number(batches: Iterator) -> Iterator:
    """Number of rows (kind 1) before each entry among its partition's entries of one curve; entries arrive in order."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, curve, upto = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        c, kind = (np.asarray(batch.column(x)).astype(np.int64) for x in ("curve", "kind"))
        place = np.empty(len(c), np.int64)
        cuts = [0, *(np.nonzero(np.diff(c))[0] + 1), len(c)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if c[a] != curve:
                curve, upto = c[a], 0
            run = np.cumsum(kind[a:b])
            place[a:b] = upto + run - kind[a:b]
            upto += int(run[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])


def _ordered(entries: DataFrame, keep: Callable) -> DataFrame:
    """Entries with `g`, the number of rows before them on their curve.

    A range partitioning sorts; each partition numbers its own entries, and one count per partition and curve says where it begins.
    """
    by = ["curve", "size", "key", "kind", "id", "probe"]
    numbered = entries.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_number, f"{_ORDER}, part int, place long")
    numbered = keep(numbered, "curve-order")
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = numbered.groupBy("curve", "part").agg(F.sum("kind").alias("n")).select("curve", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(sizes), ["curve", "part"]).withColumn("g", F.col("before") + F.col("place"))  # one row per partition and curve


def _meet(k: int):
    """Per window: queries first, then rows in pieces; a query's k nearest of each piece, as far as coded vectors can tell.

    True and coded distance differ by the row's gap at most, so rows stay that can be among the piece's k nearest and no farther than
    the query's limit: nothing is lost to the coding.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        window, held, ids, limits = None, [], None, None

        def pairs(row_ids, codes, step, gap):
            rows = codes * step[:, None]
            squares = (rows**2).sum(1)
            for a in range(0, len(ids), 256):
                q = queries[a : a + 256]
                distance = np.sqrt(np.maximum((q**2).sum(1)[:, None] + squares[None, :] - 2 * q @ rows.T, 0))
                slack = gap[None, :] + 1e-6 * (1 + np.sqrt(squares))[None, :]
                high = distance + slack
                most = np.partition(high, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(q), np.inf)
                i, j = np.nonzero(distance - slack <= np.minimum(most, limits[a : a + 256])[:, None])
                yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[a : a + 256][i], pa.int64()), "vec_id": pa.array(row_ids[j], pa.int64())})

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("curve", "size", "window", "kind")], axis=1)
            cuts = [0, *(np.nonzero((np.diff(key, axis=0) != 0).any(1))[0] + 1), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if tuple(key[a, :3]) != window:
                    window, held, ids = tuple(key[a, :3]), [], None
                if key[a, 3] == 0:
                    held.append((np.asarray(part.column("id")), np.asarray(part.column("limit")), _matrix(part.column("embedding"))))
                    continue
                if held:
                    ids, limits, queries = (np.concatenate(x) for x in zip(*held))
                    held = []
                if ids is None:
                    continue
                for c in range(0, b - a, PIECE):
                    piece = part.slice(c, PIECE)
                    codes = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.int8).reshape(piece.num_rows, -1).astype(np.float64)
                    yield from pairs(np.asarray(piece.column("id")), codes, np.asarray(piece.column("step")), np.asarray(piece.column("gap")))

    return run


def _closest(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k rows of each partition nearest to each of a bounded number of queries, by brute force."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for size, part, vectors in _by_size(batches):
            if size not in queries:
                continue
            ids, q = queries[size]
            row_ids = np.asarray(part.column("vec_id")).astype(np.int64)
            for i, x in zip(ids, q):
                far = np.sqrt(((vectors - x) ** 2).sum(1))
                far[row_ids == i] = np.inf
                best = np.lexsort((row_ids, far))[:k]
                best = best[np.isfinite(far[best])]
                yield pa.RecordBatch.from_pydict({"rep": pa.array(np.full(len(best), i), pa.int64()), "vec_id": pa.array(row_ids[best]), "score": pa.array(far[best])})

    return run


def _limits(shared, k: int):
    """An upper bound of each query's distance to its kth other row: its (k + 1)th distance within the fitting sample, which holds rows of the table."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sample = Curves.of_parts(*shared.value[0]).rows
        for size, part, vectors in _by_size(batches):
            rows, limits = sample.get(size, np.zeros((0, size))), np.full(len(vectors), np.inf)
            if len(rows) > k:
                for a in range(0, len(vectors), 256):
                    q = vectors[a : a + 256]
                    far = (q**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * q @ rows.T
                    limits[a : a + 256] = np.sqrt(np.maximum(np.partition(far, k, axis=1)[:, k], 0)) * (1 + 1e-6) + 1e-6
            yield pa.RecordBatch.from_pydict({"id": part.column("vec_id").cast(pa.int64()), "limit": pa.array(limits)})

    return run


def _window(placed: DataFrame, truth: dict[int, set[int]], target: float, least: int) -> tuple[int, float]:
    """The smallest window, doubling from `least` rows, that finds `target` of the sampled queries' true neighbours, and its recall.

    Only places of the sampled queries' probes and of their true neighbours reach the driver, both of bounded number.
    """
    if not truth:
        return least, 1.0
    wanted = sorted(set().union(*truth.values()))
    probes, places, last = {}, {}, 0
    for r in placed.filter((F.col("kind") == 0) & F.col("id").isin(list(truth))).select("curve", "size", "id", "g").collect():
        probes.setdefault(r.id, set()).add((r.curve, r.size, r.g))
    for r in placed.filter((F.col("kind") == 1) & F.col("id").isin(wanted)).select("curve", "size", "id", "g").collect():
        places.setdefault(r.id, []).append((r.curve, r.size, r.g))
        last = max(last, r.g)
    pairs = [(q, x) for q, xs in truth.items() for x in xs]
    while True:
        seen = {q: {(c, s, g // least) for c, s, g in at} for q, at in probes.items()}
        recall = sum(any((c, s, g // least) in seen[q] for c, s, g in places[x]) for q, x in pairs) / max(1, len(pairs))
        if recall >= target or least > last:
            return least, recall
        least *= 2


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, target: float = 0.96, least: int = LEAST_WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query of (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by `every`, candidates all others. score is the Euclidean distance in double precision;
    ties go to the smaller vec_id. Null or zero vectors and those with null or non-finite components take no part, nor do
    rows without id. Vectors of different lengths never meet. Equal rows of one vec_id count once. Fewer candidates than k
    give all that are found. Extra columns are ignored; an empty table gives no rows.

    1. Every row gets a key on CURVES Hilbert curves (Curves, fitted on FIT_ROWS rows); a query, PROBES keys on each: its own and those of
       points about it. Queries of equal vectors are one query until the end. Rows and probes are range-partitioned in one order, so that a probe learns its place.
    2. Windows are runs of rows in that order. Their length is fitted: brute force finds the true neighbours of FIT_QUERIES queries, and the smallest
       window that holds `target` of them is taken. On vectors without structure it grows towards the table.
    3. Within each window queries meet rows as coded vectors (a byte a component), whose error is bounded, so the coding loses no one.
    4. The finds of all windows merge, one pair once, and are ranked by exact distance on the original vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    keep = scratch.keep
    rows = keep(_usable(vectors), "vectors")
    asks = rows.filter(F.col("vec_id") % every == 0)
    reps = keep(asks.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "queries")
    members = asks.join(reps.withColumnRenamed("vec_id", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep")
    some = lambda df, n: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    curves = Curves([np.array(r.embedding, np.float64) for r in some(rows, FIT_ROWS)])
    asked: dict[int, list] = {}
    for r in some(reps, FIT_QUERIES):
        asked.setdefault(len(r.embedding), []).append((r.vec_id, r.embedding))
    fit = {size: (np.array([i for i, _ in x]), np.array([v for _, v in x], np.float64)) for size, x in asked.items()}
    close = rows.mapInArrow(_closest(fit, k), "rep long, vec_id long, score double").distinct()
    close = _best(close.withColumnRenamed("rep", "query_id"), k).collect() if fit else []
    truth: dict[int, set[int]] = {}
    last: dict[int, float] = {}
    for r in close:
        truth.setdefault(r.query_id, set()).add(r.vec_id)
        last[r.query_id] = max(r.score, last.get(r.query_id, 0.0))
    far = {size: float(np.median([last[i] for i in ids.tolist() if i in last] or [0.0])) for size, (ids, _) in fit.items()}
    shared = spark.sparkContext.broadcast((curves.parts(), far))
    placed = _ordered(rows.mapInArrow(_row_keys(shared), _ORDER).unionByName(reps.mapInArrow(_probe_keys(shared), _ORDER)), keep)
    window, _ = _window(placed, truth, target, least)
    placed = placed.withColumn("window", F.floor(F.col("g") / window))
    limits = reps.mapInArrow(_limits(shared, k), "id long, limit double")
    queries = reps.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).join(limits, "id")
    at = ["curve", "size", "window", "kind", "id"]
    probes = placed.filter("kind = 0").select(*at).distinct().join(queries, "id")
    both = placed.filter("kind = 1").select(*at, "code", "step", "gap").unionByName(probes, allowMissingColumns=True)
    dealt = both.repartition(*at[:3]).sortWithinPartitions(*at[:4])
    found = keep(dealt.mapInArrow(_meet(k + 1), "rep long, vec_id long").distinct(), "neighbour-pairs")
    x = reps.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("x"))
    pairs = found.join(x, "rep").join(rows.select("vec_id", F.col("embedding").alias("y")), "vec_id")
    score = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    scored = pairs.select("rep", "vec_id", score.alias("score")).distinct()
    # a member of a class of equal queries drops itself only, so k + 1 ids of the class are enough for it
    ids = scored.groupBy("rep", "vec_id").agg(F.min("score").alias("near"))
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("near", "vec_id"))).filter(F.col("nth") <= k + 1).select("rep", "vec_id")
    scored = scored.join(ids, ["rep", "vec_id"])
    out = _best(members.join(scored, "rep").filter("query_id <> vec_id").select("query_id", "vec_id", "score").distinct(), k)
    return scratch.result(out, "neighbours")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same as SQL over every pair of a query and a row.
ORACLE = """with e as (select distinct vec_id, cast(embedding as double[]) as v from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, e.vec_id as vec_id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as score from e q join e on e.vec_id <> q.vec_id and len(e.v) = len(q.v) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10"""

"""Sharding by vector bin packing: shards get near-equal bytes, tokens and rows at once.

Documents of equal text are one group, a vector of bytes, tokens and rows. Groups go to the shard whose residual capacity has the highest dot product
with the group's vector, both measured in shares of a shard: large groups first, by size, the others in the order of a hash. (By size
throughout, the shard of a hot group of short rows would see no long texts any more when it needs them to even out its bytes.)

Spark-wise: groups above LARGE of a shard in any measure are few at any size of corpus (at most shards * 3 / LARGE), so one task places them one by one. The others are
dealt into lots of about LOT groups by a hash. Each lot gets its part of what the shards have left and is packed by the same rule in a task of its own; lots are
packed as evenly as their smallest groups allow, so their sums are even, too. That happens class by class of size, and the capacity left is
counted anew between the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, n_words

MEASURES = ("bytes", "tokens", "rows")
#: Shares of a shard that part the classes of groups, the least first class for one task; groups in a lot; rows that get their slots together.
LARGE, SMALL, LOT, RUN = 1e-3, 1e-6, 8192, 16_384
#: Share of a shard, or of a shard's part of a lot, above which groups are placed first, by size.
FIRST = 1 / 128


def pack(vectors: np.ndarray, capacity: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each group: vectors (n, m) are placed one by one, each where its dot product with the residual capacity (k, m) is highest.

    Those above FIRST of a shard in a measure go first, by their largest share, then the others as they come. Ties go to the first shard from `turn` on. Capacity may be overrun where nothing fits; residuals then are negative and repel.
    """
    k = len(capacity)
    unit = np.maximum(capacity.mean(0), 1e-12)
    shares, order = vectors / unit, (np.arange(k) + turn) % k
    left, out = (capacity / unit)[order], np.zeros(len(vectors), np.int32)
    most = shares.max(1, initial=0.0)
    for i in np.argsort(-np.where(most > FIRST, most, 0.0), kind="stable").tolist():
        at = int((left @ shares[i]).argmax())
        left[at] -= shares[i]
        out[i] = order[at]
    return out


_KEY = ["h", "size", "piece"]
_PLACED = "h long, size long, piece int, bytes double, tokens double, rows double, shard int"


def _packer(left: np.ndarray, whole: bool):
    """A lot's groups with their shards; left: what each shard can still take, of which a lot gets its part unless it is the whole class."""

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(_KEY)  # by hash
        vectors = lot[list(MEASURES)].to_numpy(np.float64)
        room = np.maximum(left, 0.0)
        part = room / np.maximum(room.sum(0), 1e-12) * vectors.sum(0)
        return lot[[*_KEY, *MEASURES]].assign(shard=pack(vectors, left if whole else part, int(lot["lot"].iloc[0])))

    return run


def assigned(docs: DataFrame, shards: int = 16, tokens: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot of every row of (doc_id, text), and the columns named in carry.

    size: UTF-8 bytes of the text and one; tokens: words unless said otherwise. Documents of equal text share a shard, null counting as empty text. Only a group
    that exceeds a whole shard's share of bytes, tokens or rows is split, into pieces of half a shard so that others can even them out, its rows dealt by hash. Slots number a shard's rows from
    0 without gaps. Repeated rows, and rows without doc_id, each get a slot; ties between groups go by hash of their texts, between shards in turn.
    Extra columns are ignored. An empty table gives no rows. Texts stay in the scan unless carried.

    Broadcast are the groups above LARGE of a shard alone, at most shards * 3 / LARGE keys (48,000 for 16 shards) and what splitting adds; rows of all other groups
    meet theirs by a shuffle in which no key has more than LARGE of a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
        (n_words(text) if tokens is None else tokens).cast("long").alias("tokens"), F.struct(*[F.col(c) for c in carry] or [F.lit(0)]).alias("carried"))
    sized = scratch.keep(sized, "sizes")
    vector = [F.sum("size").cast("double").alias("bytes"), F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).cast("double").alias("rows")]
    total = sized.agg(*vector).first()
    each = [max((total[m] or 0.0) / shards, 1e-12) for m in MEASURES]
    share = F.greatest(*[F.col(m) / e for m, e in zip(MEASURES, each)])
    groups = scratch.keep(sized.groupBy("h", "size").agg(*vector).withColumn("share", share), "groups")
    # a group that fills more than a shard: at most 3 * shards of them
    over = groups.filter("share > 1").select("h", "size", F.ceil(2 * F.col("share")).cast("int").alias("pieces"))
    split = sized.join(F.broadcast(over), ["h", "size"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int"))
    pieces = split.filter("pieces is not null").groupBy(*_KEY).agg(*vector).withColumn("share", share)
    columns = [*_KEY, *MEASURES, "share"]
    groups = scratch.keep(groups.filter("share <= 1").withColumn("piece", F.lit(0)).select(*columns).unionByName(pieces.select(*columns)), "pieces")

    left, placed = np.array([each] * shards), []
    bounds = [float("inf"), LARGE, SMALL, -1.0]
    for k, (most, least) in enumerate(zip(bounds, bounds[1:])):
        members = groups.filter((F.col("share") > least) & (F.col("share") <= most))
        n = members.count()
        lots = 1 if k == 0 else -(-n // LOT)
        if n:
            dealt = members.withColumn("lot", F.pmod(F.xxhash64(F.lit(k), *_KEY), F.lit(max(1, lots))).cast("int"))
            members = scratch.keep(dealt.groupBy("lot").applyInPandas(_packer(left, k == 0), _PLACED), "placed")
            for r in members.groupBy("shard").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect():
                left[r.shard] -= [r[m] for m in MEASURES]
        placed.append((n, members.withColumn("shard", F.col("shard").cast("int") if n else F.lit(0)).select(*_KEY, "shard")))
    (_, large), *others = placed
    large = split.drop("pieces").join(F.broadcast(large), _KEY, "left")
    rows = large.filter("shard is not null")
    for n, rest in others:
        if n:
            rows = rows.unionByName(large.filter("shard is null").drop("shard").join(rest.hint("merge"), _KEY))
    rows = scratch.keep(rows.select("doc_id", "size", "text_crc32", "tokens", "shard", "row", "carried"), "rows")
    # slots: a shard's rows are numbered run by run, a count per run says where it begins
    runs = max(1, int((total["rows"] or 0) // (shards * RUN)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select("shard", "run", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "run").orderBy(F.col("doc_id").asc_nulls_last(), "row")) - 1
    out = rows.withColumn("nth", nth).join(starts, ["shard", "run"]).withColumn("slot", (F.col("before") + F.col("nth")).cast("long"))
    return scratch.result(out.select("doc_id", "size", "text_crc32", "tokens", "shard", "slot", *[F.col("carried")[c].alias(c) for c in carry if c != "doc_id"]), "shards")


def write_shards(docs: DataFrame, path: str, shards: int = 16, rows_a_file: int = 100_000, **options) -> None:
    """Documents with all their columns as Parquet, a folder shard=k for each shard, in files of about rows_a_file rows."""
    clash = {"size", "text_crc32", "tokens", "shard", "slot"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be written twice")
    out = assigned(docs, shards, carry=tuple(docs.columns), **options)
    part = F.floor(F.col("slot") / rows_a_file)
    out.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)

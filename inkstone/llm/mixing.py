"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Shards that share one part's quota, and blocks that one row is spread into in one go.
PARTY, SPREAD = 1000, 1024


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source of (source, source_size).

    Sources by code point, null last, weigh `weights` in turn and divide share * all words by
    weight, none above cap * its own size; what is cut is divided anew among the others. The
    end of that process is one level L with target = min(cap * size, L * weight), found
    from running sums over the sources by cap * size / weight. One row per source, so the
    window without partition sorts sources, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = sizes.withColumn("_k", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_k") + 1)
    listed = listed.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    run = listed.select(
        "*", (share * F.sum("source_size").over(everything)).alias("_all"), F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("_full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
    )
    level = run.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    ratio = F.col("most") / F.col("weight")
    level = level.withColumn("_l", F.min(F.when(F.col("_level") <= ratio, F.struct(ratio.alias("ratio"), "_level"))).over(everything)["_level"])
    target = F.when(F.col("_l").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("_l") * F.col("weight")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, seats: Column, of: list[str], key: list[str]) -> DataFrame:
    """Integer quotas by highest quotients weight / (2 * seat - 1).

    parties: columns `of` (the group whose seats are shared; may be empty), `key`, and a double
    `weight`; `seats` is the number for the whole group. The divisor method gives a party its exact share
    give or take n * share + 1 seats, n being the parties of its group, so only
    that many quotients per party compete; the seats below are certain. Ties go to the smaller key.
    """
    group = Window.partitionBy(*(of or [F.lit(1)]))
    p = parties.withColumn("_s", seats.cast("long")).withColumn("_w", F.sum("weight").over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    part = F.when(F.col("_w") > 0, F.col("weight") / F.col("_w")).otherwise(F.lit(0.0))
    p = p.withColumn("_q", F.col("_s") * part).withColumn("_m", F.ceil(F.col("_n") * part) + 1)
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_q")).cast("long") - F.col("_m"))).withColumn("_left", F.col("_s") - F.sum("_sure").over(group))
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.ceil(F.col("_q")).cast("long") + F.col("_m"))).alias("_seat")
    named = [F.col(c).isNull() for c in key] + [F.col(c) for c in key]
    rivals = p.filter("weight > 0").select(*of, *[c for c in key if c not in of], "weight", "_left", seat)
    rank = F.row_number().over(Window.partitionBy(*(of or [F.lit(1)])).orderBy((F.col("weight") / (2 * F.col("_seat") - 1)).desc(), *named, "_seat"))
    won = rivals.withColumn("_r", rank).filter("_r <= _left").groupBy(*dict.fromkeys([*of, *key])).agg(F.count(F.lit(1)).alias("_won"))
    on = F.lit(True)
    a, b = p.alias("a"), won.alias("b")
    for c in dict.fromkeys([*of, *key]):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """How many words of each document of (doc_id, text, source) the mix takes, whole repeats counted.

    1. Sources get targets (source_targets), then integer quotas of `block`-word blocks by highest quotients.
    2. A source is dealt into shards of about shard_words words by a hash of the document, so that a hot source is many small groups; the source's quota is
       apportioned to parts of PARTY shards, and each part's to its shards, in the same way.
    3. Within a shard the documents lie end to end in a seeded order and are cut into blocks. A quota of q words
       of a shard of n takes every block q div n times and then blocks in seeded order until
       q mod n words more are taken, the last block in part.

    Size: words of the text, null 0. Documents without words take nothing. Null sources are one source. Repeated rows
    are documents of their own, told apart by a count among equals. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(docs["text"]).alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    sized = keep(sized.withColumn("_copy", F.row_number().over(same)), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sources, weights, share, cap), "mix-targets")
    everything = Window.partitionBy(F.lit(1))
    quotas = sainte_lague(targets.withColumn("weight", F.col("target")), F.round(F.sum("target").over(everything) / block), [], ["source"])
    quotas = quotas.select(F.col("source").alias("_source"), "source_size", "target", F.least(F.col("quota") * block, F.col("source_size") * 2).alias("words"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    dealt = sized.join(quotas, sized["source"].eqNullSafe(quotas["_source"])).select(
        "doc_id", "source", "size", "_copy", "source_size", "target", "words", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_copy"), shards).alias("shard"))
    dealt = keep(dealt, "mix-dealt")
    per_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("words").alias("words"))
    per_shard = keep(per_shard.withColumn("weight", F.col("shard_size").cast("double")).withColumn("part", F.floor(F.col("shard") / PARTY)), "mix-shards")
    # a source's blocks go to parts of PARTY shards first, then within each part, so that no window holds all shards of a hot source
    per_part = per_shard.groupBy("source", "part").agg(F.sum("weight").alias("weight"), F.max("words").alias("words"))
    parts = sainte_lague(per_part, F.round(F.col("words") / block), ["source"], ["source", "part"]).select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.col("quota").alias("blocks"))
    per_shard = per_shard.join(parts, per_shard["source"].eqNullSafe(parts["_source"]) & (per_shard["part"] == parts["_part"])).drop("_source", "_part")
    shared = sainte_lague(per_shard, F.col("blocks"), ["source", "part"], ["source", "part", "shard"])
    # the words that blocks can't tell apart go to the first shard, within what it can hold
    firsts = shared.groupBy(F.col("source").alias("_first_of")).agg(F.min("shard").alias("_first"))
    shared = shared.join(firsts, shared["source"].eqNullSafe(firsts["_first_of"]))
    first = F.when(F.col("shard") == F.col("_first"), F.col("words") - F.round(F.col("words") / block) * block).otherwise(F.lit(0))
    shared = shared.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size",
        F.greatest(F.lit(0), F.least(F.col("quota") * block + first, 2 * F.col("shard_size"))).cast("long").alias("due"))
    placed = dealt.join(shared, dealt["source"].eqNullSafe(shared["_source"]) & (dealt["shard"] == shared["_shard"])).drop("_source", "_shard")
    in_order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_copy"), "doc_id", "_copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(in_order)).withColumn("start", F.col("end") - F.col("size"))
    times = F.when(F.col("shard_size") > 0, F.floor(F.col("due") / F.col("shard_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("whole", times.cast("long")).withColumn("rest", F.col("due") - F.col("whole") * F.col("shard_size"))
    placed = keep(placed, "mix-placed")
    blocks = placed.filter("size > 0").groupBy("source", "shard").agg(F.max("shard_size").alias("shard_size"), F.max("rest").alias("rest")).filter("rest > 0")
    # a few rows become many: dealt out before they do
    last = F.floor((F.col("shard_size") - 1) / block)
    blocks = blocks.select("source", "shard", "shard_size", "rest", F.explode(F.sequence(F.lit(0), F.floor(last / SPREAD))).alias("run")).repartition("source", "shard", "run")
    upto = F.least(last, F.col("run") * SPREAD + SPREAD - 1)
    blocks = blocks.select("source", "shard", "shard_size", "rest", F.explode(F.sequence(F.col("run") * SPREAD, upto)).alias("block"))
    length = F.least(F.col("shard_size") - F.col("block") * block, F.lit(block))
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    chosen = blocks.withColumn("length", length).withColumn("upto", F.sum("length").over(seeded))
    chosen = chosen.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("block").alias("_block"), F.least(F.col("length"), F.col("rest") - F.col("upto") + F.col("length")).alias("got")).filter("got > 0")
    pieces = placed.filter("size > 0 and rest > 0").select("doc_id", "_copy", "source", "shard", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    # both sides grow with the corpus: never broadcast
    hit = pieces.join(chosen.hint("merge"), pieces["source"].eqNullSafe(chosen["_source"]) & (pieces["shard"] == chosen["_shard"]) & (pieces["block"] == chosen["_block"]))
    overlap = F.greatest(F.lit(0), F.least(F.col("end"), F.col("block") * block + F.col("got")) - F.greatest(F.col("start"), F.col("block") * block))
    extra = hit.groupBy("doc_id", "_copy", "source").agg(F.sum(overlap).alias("extra"))
    p, x = placed.alias("p"), extra.alias("x")
    on = F.col("p.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("p._copy") == F.col("x._copy")) & F.col("p.source").eqNullSafe(F.col("x.source"))
    taken = (F.col("p.size") * F.col("p.whole") + F.coalesce(F.col("x.extra"), F.lit(0))).cast("long")
    return p.join(x.hint("merge"), on, "left").select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", taken.alias("taken"))


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: whole documents with all their columns, each as often as the words taken from it come to.

    A document of which 1.3 times its size is taken appears once, and with a seeded chance of 0.3 once more, so that sources keep
    their shares without cutting texts. Rows that share a doc_id share what is taken from them; rows without doc_id, and
    documents without words, are left out.
    """
    taken = mix(docs.select("doc_id", "text", "source"), seed=seed, **options).filter("doc_id is not null and size > 0")
    per_doc = taken.groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 3), "_doc"), F.col("_size")) < F.pmod(F.col("_taken"), F.col("_size"))
    times = F.floor(F.col("_taken") / F.col("_size")) + chance.cast("int")
    often = per_doc.select("_doc", times.cast("int").alias("_times")).filter("_times > 0")
    return docs.join(often, docs["doc_id"] == often["_doc"]).withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)

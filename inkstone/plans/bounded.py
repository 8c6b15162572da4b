"""Cosine scores of questions and articles that can reach a floor, by bounds on the parts of postings lists.

A part is a term's postings in articles of one kind (articles whose largest weight lies in one range); the index' directory holds its largest weight. For a
question and a kind of articles, a term adds at most its own weight times the part's largest. With terms in the order of these bounds:

- the weakest terms whose bounds together stay below the floor are optional: an article that shares no other term with the question can't reach the floor,
  and is never made a pair;
- of those, the weakest whose bounds stay below a share of the floor (SPARE) are late: their postings are not read in the first pass, which sums all
  other terms and keeps a pair only if its sum and what the late terms could add reach the floor;
- pairs that are left get the late terms' weights by (term, article), and with them their exact score.

Questions without a floor take all articles that share a term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.plans.index import Index
from inkstone.plans.kept import freed, kept

#: The share of the floor that late terms may hold, and what sums in another order may differ by.
SPARE, SLACK = 0.5, 1e-9
#: The names of so many parts are sent to all tasks, about 10 MB; where questions read more, all postings are shuffled.
MOST_PARTS = 200_000


def question_weights(q: DataFrame, idf: DataFrame) -> DataFrame:
    """qid, term, u, open: a question's terms, weighed and of length one; a term the index doesn't know weighs 1 and only lengthens the question."""
    terms = q.select("qid", "open", F.explode("qterms").alias("term")).groupBy("qid", "open", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = terms.join(idf.select("term", "idf"), "term", "left").select("qid", "open", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))
    return weighted.select("qid", "open", "term", (F.col("w") / norm).alias("u"))


def planned(weights: DataFrame, parts: DataFrame, floor: float, spare: float = SPARE) -> DataFrame:
    """qid, open, term, kind, slices, u, needed, late, rest: which parts a question reads, in which pass; rest: what its late terms may add to a pair of the kind."""
    asked = weights.join(parts.select("term", "kind", "slices", "most"), "term").withColumn("bound", F.col("u") * F.col("most"))
    weakest = Window.partitionBy("qid", "kind").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("upto", F.sum("bound").over(weakest)).withColumn("needed", F.col("open") | (F.col("upto") >= floor - SLACK))
    asked = asked.withColumn("late", ~F.col("open") & (F.col("upto") < spare * floor))
    rest = F.coalesce(F.max(F.when(F.col("late"), F.col("upto"))).over(Window.partitionBy("qid", "kind")), F.lit(0.0))
    return asked.withColumn("rest", rest).select("qid", "open", "term", "kind", "slices", "u", "needed", "late", "rest")


def asked_of(postings: DataFrame, plan: DataFrame) -> DataFrame:
    """Postings of the parts in a plan, picked where they are read, so that no others are shuffled."""
    parts = plan.select("term", "kind").distinct()
    if parts.count() > MOST_PARTS:
        return postings
    return postings.join(F.broadcast(parts), ["term", "kind"], "left_semi")


def survivors(plan: DataFrame, postings: DataFrame, floor: float) -> DataFrame:
    """qid, id, kind, open, sofar: pairs that the first pass can't rule out, with the sum of all but the late terms."""
    read = plan.filter("not late")
    parts = read.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "late")
    # few parts go to the postings, where an article's lie together, so that pairs are summed before they are shuffled
    met = postings.join(F.broadcast(parts), ["term", "kind", "slice"]) if parts.count() <= MOST_PARTS else parts.join(asked_of(postings, read), ["term", "kind", "slice"])
    pairs = met.groupBy("qid", "id").agg(
        F.sum(F.col("u") * F.col("weight")).alias("sofar"), F.bool_or("needed").alias("needed"), F.max("rest").alias("rest"), F.max("kind").alias("kind"), F.bool_or("open").alias("open"))
    return pairs.filter(F.col("needed") & (F.col("open") | (F.col("sofar") + F.col("rest") >= floor - SLACK))).select("qid", "id", "kind", "open", "sofar")


def finished(pairs: DataFrame, plan: DataFrame, postings: DataFrame, floor: float) -> DataFrame:
    """qid, id, base: exact scores of the surviving pairs that reach the floor; similarities count to 12 places."""
    late = plan.filter("late").select("qid", "kind", "term", "slices", "u")
    asks = pairs.filter("not open").select("qid", "id", "kind").join(late, ["qid", "kind"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    more = asks.join(asked_of(postings, plan.filter("late")).select("id", "term", "slice", "weight"), ["id", "term", "slice"]).groupBy("qid", "id").agg(F.sum(F.col("u") * F.col("weight")).alias("more"))
    scored = pairs.filter("not open").join(more, ["qid", "id"], "left").withColumn("base", F.col("sofar") + F.coalesce("more", F.lit(0.0)))
    whole = pairs.filter("open").select("qid", "id", F.col("sofar").alias("base"))  # open questions have no late terms
    return scored.filter(F.round("base", 12) >= floor).select("qid", "id", "base").unionByName(whole)


def bounded_scores(q: DataFrame, index: Index, floor: float, spare: float = SPARE, held: list[DataFrame] | None = None) -> DataFrame:
    """held: gets the tables that the scores are read from. qid, id, base of every pair of a question (qid, qterms, open) and an article that reaches the floor or, for open questions, shares a term."""
    plan = kept(planned(question_weights(q, index.idf), index.parts, floor, spare), "question-parts")
    pairs = kept(survivors(plan, index.postings, floor), "surviving-pairs")
    freed(q.sparkSession)
    if held is not None:
        held += [plan, pairs]
    return finished(pairs, plan, index.postings, floor)

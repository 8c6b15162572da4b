"""Retrieval for a whole table of questions: date filter, cosine and rerank, floor, fit-or-stop packing, date conflicts.

One question is a one-row table. Texts stay out of scoring: only ids, dates and token costs travel, and the answer joins texts back
for the few rows that were packed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from inkstone.functions.dates import date_spec, without_dates
from inkstone.functions.text import token_cost, words_asked
from inkstone.plans.bounded import bounded_scores
from inkstone.plans.index import Index, headers
from inkstone.plans.kept import dropped, freed, kept

#: Floors by backend, weights of title overlap and date in range, the number of conflicting records.
FLOOR = {"tfidf": 0.05, "dense": 0.30}
TITLE_WEIGHT, DATE_BONUS, CONFLICTS, BUDGET, LEAST_FILTERED = 0.15, 0.08, 3, 2400, 2


@dataclass
class Retrieved:
    """trace: one row per question; evidence: one row per question and packed article, in rank order."""

    trace: DataFrame
    evidence: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Deletes the tables that retrieval wrote."""
        for df in (self.trace, self.evidence, *self.held):
            dropped(df)


def prepared(questions: DataFrame, index: Index) -> DataFrame:
    """Questions (qid, original, rewritten?, token_budget?) with date filter, topical words and query terms.

    A date in the original question wins over one in the rewritten text.
    """
    have = questions.columns
    q = questions.select(
        "qid", "original", (F.coalesce("rewritten", "original") if "rewritten" in have else F.col("original")).alias("rewritten"),
        (F.col("token_budget") if "token_budget" in have else F.lit(BUDGET)).cast("long").alias("token_budget"))
    q = q.withColumn("asked", date_spec("original")).withColumn("inferred", date_spec("rewritten"))
    source = F.when(F.col("asked.year").isNotNull(), "original").when(F.col("inferred.year").isNotNull(), "regenerated").otherwise("none")
    q = q.withColumn("source", source).withColumn("spec", F.when(F.col("source") == "original", F.col("asked")).otherwise(F.col("inferred")))
    q = q.withColumn("topical_terms", words_asked(without_dates("rewritten"))).withColumn("asked_topic", F.size(words_asked(without_dates("original"))) > 0)
    return q.withColumn("waived", (F.col("source") == "original") & ~F.col("asked_topic")).withColumn("qterms", index.tokens(F.col("rewritten")))


def date_matches(q: str = "q", a: str = "a") -> Column:
    """Whether an article's date lies in a question's filter; what the filter leaves open matches anything, what an article leaves open nothing."""
    spec = lambda f: F.col(f"{q}.spec.{f}")
    inside = F.col(f"{a}.year").isNotNull() & F.col(f"{a}.year").between(spec("year"), spec("year_end"))
    parts = F.lit(True)
    for f in ("year", "month", "day"):
        parts = parts & (spec(f).isNull() | F.coalesce(F.col(f"{a}.{f}") == spec(f), F.lit(False)))
    return F.when(spec("year_end").isNotNull(), inside).otherwise(parts)


#: The key of all articles, whatever their date.
ANY_DATE = 0


def date_keys(year: Column, month: Column, day: Column) -> Column:
    """Keys under which an article's date is found: its year, its month, its day, as far as known."""
    y, part = year.cast("long") * 10_000, lambda c: c.between(1, 98)  # no filter asks for other months or days
    by_month = F.when(part(month), y + month * 100)
    return F.array_compact(F.array(y, by_month, F.when(part(day), by_month + day)))


def filter_keys(spec: Column, everything: Column) -> Column:
    """Keys of the articles in a question's filter: a day's, a month's or a year's, those of all years of a range (at most a hundred and one), or ANY_DATE."""
    years = F.transform(F.sequence(spec["year"], spec["year_end"]), lambda y: y.cast("long") * 10_000)
    one = spec["year"].cast("long") * 10_000 + F.coalesce(spec["month"] * 100 + F.coalesce(spec["day"], F.lit(0)), F.lit(0))
    return F.when(everything | spec["year"].isNull(), F.array(F.lit(ANY_DATE).cast("long"))).when(spec["year_end"].isNotNull(), years).otherwise(F.array(one))


#: Bytes of questions' vectors that are sent to all tasks at once.
SENT_BYTES = 32_000_000


def _dense_scores(q: DataFrame, vectors: DataFrame, index: Index, floor: float) -> DataFrame:
    """qid, id, base: dot products of the questions' vectors with the articles', in double precision, as far as they reach the floor or it is waived.

    Questions go in slices of bounded size to all tasks, where a slice meets each batch of articles as one matrix product.
    """
    asked = q.select("qid", "waived").join(vectors, "qid").select("qid", "waived", F.col("vector").cast("array<double>").alias("query"))
    size = asked.agg(F.sum(8 * F.size("query") + 64)).first()[0] or 0
    slices = int(-(-size // SENT_BYTES)) or 1
    sliced = kept(asked.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int")), "asked-vectors")
    out = None
    for i in range(slices):
        rows = sliced.filter(F.col("slice") == i).collect()
        found = index.articles.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_products(rows, floor), "qid string, id string, base double")
        out = found if out is None else out.unionByName(found)
    return out


def _products(rows: list, floor: float) -> Callable[[Iterator], Iterator]:
    import numpy as np

    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.query), []).append(r)
    asked = {size: (np.array([r.qid for r in x], object), np.array([r.query for r in x], np.float64), np.array([r.waived for r in x], bool)) for size, x in by_size.items()}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("vector")), -1))
            for size in set(sizes.tolist()) & set(asked):
                part = batch.filter(pa.array(sizes == size))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
                ids, (qids, queries, waived) = np.array(part.column("id").to_pylist(), object), asked[size]
                for a in range(0, len(qids), 256):
                    base = queries[a : a + 256] @ x.T
                    i, j = np.nonzero((base >= floor - 1e-9) | waived[a : a + 256, None])
                    yield pa.RecordBatch.from_pydict({"qid": pa.array(qids[a : a + 256][i], pa.string()), "id": pa.array(ids[j], pa.string()), "base": pa.array(base[i, j])})

    return run


def retrieve(index: Index, questions: DataFrame, *, min_similarity: float | None = None, vectors: DataFrame | None = None, counter: Callable[[Column], Column] = token_cost, counter_label: str = "conservative-char-v1") -> Retrieved:
    """Date-filter, score, apply the floor and pack whole articles, for every question at once.

    Packing is fit-or-stop: a strict prefix of the ranking. Ranks and the floor compare similarities rounded to 12 places, since sums after
    a shuffle differ in the last bits; ties go to the smaller id. counter: cost in tokens of a text, one at least.
    """
    q = said = kept(prepared(questions, index), "prepared")  # dates are read once, and later plans stay small
    floor = FLOOR[index.backend] if min_similarity is None else float(min_similarity)
    # read several times, so a counter goes through the texts once
    light = index.heads if counter is token_cost and index.heads is not None else kept(headers(index.articles, index.tokenizer, counter), "heads")
    n_all = F.lit(light.count())
    # how many articles each question's filter leaves; a filter inferred from the rewriting is dropped if too few
    dates = light.select(F.explode(date_keys(F.col("year"), F.col("month"), F.col("day"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = q.filter("spec.year is not null").select("qid", F.explode(filter_keys(F.col("spec"), F.lit(False))).alias("key"))
    per = keys.join(dates, "key").groupBy("qid").agg(F.sum("n").alias("n_match"))
    q = q.join(per, "qid", "left").withColumn("n_match", F.when(F.col("spec.year").isNull(), n_all).otherwise(F.coalesce("n_match", F.lit(0))))
    q = q.withColumn("widened", (F.col("n_match") < LEAST_FILTERED) & (F.col("source") == "regenerated"))
    q = q.withColumn("n_candidates", F.when(F.col("widened"), n_all).otherwise(F.col("n_match")))
    mode = F.when(F.col("widened"), "inferred-date-fallback-all").when(F.col("spec.year").isNull(), "all-records").when(F.col("spec.year_end").isNotNull(), "year-range").otherwise("exact-or-partial-date")
    # an open question has no floor: all articles of its filter are candidates
    open_ = F.lit(index.backend == "tfidf") & (F.col("waived") | F.lit(floor <= 0))
    q = asked = kept(q.withColumns({"mode": mode, "n_terms": F.size(F.array_distinct("qterms")), "open": open_}), "questions")
    budget, any_open = q.agg(F.max("token_budget"), F.bool_or("open")).first()
    most = int(budget or 0) + 1  # no more articles fit

    read: list[DataFrame] = []
    base = kept(bounded_scores(q, index, floor, held=read) if index.backend == "tfidf" else _dense_scores(q, vectors, index, floor), "base")
    for df in read:
        dropped(df)
    freed(q.sparkSession)
    head = q.select("qid", "spec", "widened", "waived", "open", "source", "asked_topic", "token_budget", "n_terms", F.array_distinct("qterms").alias("qset"))

    def ranked(pairs: DataFrame) -> DataFrame:
        met = pairs.alias("b").join(light.alias("a"), "id").join(head.alias("q"), "qid").withColumn("match", date_matches())
        return _ranked(met.withColumn("hits", F.size(F.array_intersect("qset", F.coalesce("title_tokens", F.array().cast("array<string>"))))), floor)

    scored = ranked(base)
    if any_open:
        # titles and filters come back to the few that are left, so none are sorted with all pairs
        some = _firsts(scored.filter("open"), most, lambda ids: ranked(base.join(ids, ["qid", "id"], "left_semi")))
        scored = ranked(base.join(q.filter("not open").select("qid"), "qid", "left_semi")).unionByName(some).unionByName(_ranked(_without_terms(head, some, light, most), floor))

    scored = kept(scored, "scored")
    freed(q.sparkSession)
    good = scored.filter("candidate and (waived or passes)")
    packed, stops = _pack(good, most)
    counts = good.groupBy("qid").agg(F.count(F.lit(1)).alias("n_kept"))
    taken = packed.groupBy("qid").agg(F.count(F.lit(1)).alias("n_taken"))
    q = q.join(counts, "qid", "left").join(stops, "qid", "left").join(taken, "qid", "left")

    # an explicit date without any record: the topic's records elsewhere tell which date the corpus gives
    lost = q.filter("source = 'original' and n_taken is null and stopped_at is null and asked_topic").select("qid")
    others = scored.filter("not candidate and passes").join(lost, "qid", "left_semi")
    others = others.withColumn("place", F.row_number().over(_order())).filter(F.col("place") <= CONFLICTS)
    record = F.struct("id", "date", "title", F.round("base", 6).alias("similarity"))
    conflicts = others.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", record.alias("r")))), lambda x: x["r"]).alias("conflict_records"))
    more, _ = _pack(others, most)

    columns = ["qid", "rank", "id", F.round("base", 6).alias("similarity"), F.round("rerank", 6).alias("rerank_score"), F.col("cost").alias("estimated_tokens")]
    evidence = packed.select(*columns, F.lit(False).alias("outside_date_filter")).unionByName(more.select(*columns, F.lit(True).alias("outside_date_filter")))
    evidence = kept(evidence, "evidence")
    # without a floor every candidate is kept, also those that the budget can't reach and that were therefore never listed
    below = F.col("n_candidates") - F.coalesce("n_kept", F.lit(0))
    if index.backend == "tfidf":
        below = F.when(F.col("waived") | F.lit(floor <= 0), F.lit(0).cast("long")).otherwise(below)
    used = evidence.groupBy("qid").agg(F.sum("estimated_tokens").alias("used"))
    trace = q.join(conflicts, "qid", "left").join(used, "qid", "left").select(
        "qid", F.col("original").alias("original_query"), F.col("rewritten").alias("rewritten_query"),
        F.struct("spec.year", "spec.month", "spec.day", "spec.year_end", "mode", "source", F.col("spec.text").alias("matched_text"), "widened").alias("date_filter"),
        F.struct(F.lit(floor).alias("value"), "waived", below.alias("below_floor")).alias("similarity_floor"),
        F.struct(F.lit("fit-or-stop").alias("policy"), "stopped_at").alias("packing"), "token_budget", F.lit(counter_label).alias("token_counter"),
        F.coalesce("used", F.lit(0)).cast("long").alias("estimated_tokens"), "topical_terms",
        F.when(F.col("conflict_records").isNotNull(), F.struct(F.struct("spec.year", "spec.month", "spec.day", "spec.year_end").alias("requested"), F.col("conflict_records").alias("records"))).alias("date_conflict"))
    # few rows that answers, prompts and checks all start from
    return Retrieved(kept(trace, "trace"), evidence, (said, asked, base, scored))


_SCORED = ["qid", "spec", "widened", "waived", "open", "source", "asked_topic", "token_budget", "n_terms", "id", "date", "title", "cost", "base", "rerank", "candidate", "passes"]


def _ranked(met: DataFrame, floor: float) -> DataFrame:
    """Pairs with their rank score, whether they are candidates, and whether they pass the floor."""
    in_range = F.col("spec.year").isNotNull() & F.coalesce(F.col("year"), F.lit(-1)).between(F.col("spec.year"), F.coalesce("spec.year_end", "spec.year"))
    overlap = F.col("hits") / F.greatest(F.lit(1), F.col("n_terms"))
    scored = met.withColumn("rerank", F.col("base") + TITLE_WEIGHT * overlap + F.when(in_range, DATE_BONUS).otherwise(0.0))
    return scored.withColumn("candidate", F.col("widened") | F.col("match")).withColumn("passes", F.round("base", 12) >= floor).select(*_SCORED)


def _order(*keys: str) -> WindowSpec:
    return Window.partitionBy("qid", *keys).orderBy(F.round("rerank", 12).desc(), "id")


def _firsts(scored: DataFrame, most: int, rows_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best of an open question's pairs: as many candidates as fit any budget, and one more, and as many others. rows_of: gives the rows of some (qid, id), if not from scored."""
    pairs = scored.select("qid", "id", "candidate", "rerank")
    ids = kept(pairs.withColumn("nth", F.row_number().over(_order("candidate"))).filter(F.col("nth") <= most).select("qid", "id"), "open-firsts")
    freed(scored.sparkSession)
    some = kept((scored.join(ids, ["qid", "id"], "left_semi") if rows_of is None else rows_of(ids)).select(*_SCORED), "open-pairs")
    dropped(ids)
    freed(scored.sparkSession)
    return some


def _without_terms(head: DataFrame, some: DataFrame, light: DataFrame, most: int) -> DataFrame:
    """Candidates that share no term with their open question, as far as its budget reaches.

    They rank below those that do, by id, since all have the same score. So a question needs none if its pairs use up the budget, else the first few by id of its filter:
    those before which articles of less than its whole budget come. Each date key's first articles are listed once, with what those before
    them cost (partly sorted where the articles are), and a question reads as many of them as its budget holds, and one more.
    """
    has = some.filter("candidate").groupBy("qid").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    short = head.filter("open").join(has, "qid", "left").filter((F.coalesce("cost", F.lit(0)) <= F.col("token_budget")) & (F.coalesce("n", F.lit(0)) < most)).drop("cost", "n")
    short = short.withColumn("key", F.explode(filter_keys(F.col("spec"), F.col("widened"))))
    keys = F.array_append(F.coalesce(date_keys(F.col("year"), F.col("month"), F.col("day")), F.array().cast("array<bigint>")), F.lit(ANY_DATE).cast("long"))
    dated = light.select("id", "year", "cost", "date", "title", F.explode(keys).alias("key")).join(short.select("key").distinct(), "key", "left_semi")
    by_id = Window.partitionBy("key").orderBy("id")
    listed = dated.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= most)
    listed = kept(listed.withColumn("before", F.coalesce(F.sum("cost").over(by_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "first-articles")
    found = short.join(listed, "key").filter(F.col("before") <= F.col("token_budget")).join(some.select("qid", "id"), ["qid", "id"], "left_anti")
    return found.withColumns({"base": F.lit(0.0), "hits": F.lit(0), "match": F.lit(True)})


def _pack(good: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose running cost stays in the budget, with their rank, and the id at which each question stopped; most: the largest budget, and one.

    Every cost is one at least, so the running sum rises strictly and the rows within budget are a prefix; no more rows than the budget can fit.
    """
    ranked = good.withColumn("rank", F.row_number().over(_order())).filter((F.col("rank") <= most) & (F.col("rank") <= F.col("token_budget") + 1))
    run = ranked.withColumn("running", F.sum("cost").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    stops = run.filter("running > token_budget").groupBy("qid").agg(F.min_by("id", "rank").alias("stopped_at"))
    return run.filter("running <= token_budget"), stops

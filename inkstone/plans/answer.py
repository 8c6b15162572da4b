"""Extractive answers, abstentions, grounding prompts and checks of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.functions.text import abstains, analysis_section, citation_label, cited_ids, date_label, joined_date, sentences, tokenize
from inkstone.plans.retrieve import Retrieved

#: Sentences of an answer, weights of rank score and position, the marker and texts of an abstention.
MOST_SENTENCES, RANK_WEIGHT, POSITION_WEIGHT = 6, 0.35, 1e-4
MARKER = "INSUFFICIENT EVIDENCE:"
OVER_BUDGET = "the highest-ranked matching article does not fit the token budget"
NOTHING_PASSED = "no article passed the date filter and similarity floor; the event may not be recorded in this corpus or may not exist"
UNMENTIONED = "The retrieved records do not mention the topic of the question."
#: So many ids of packed articles are sent to all tasks, about 20 MB; where there are more, all texts are shuffled to them.
MOST_SENT = 200_000
FURTHER = ". This extractive mode quotes source sentences without further interpretation; a grounded language-model generator adds contextual analysis."


def with_articles(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """Evidence with its articles' texts and labels: the only join that moves texts, and only those of packed rows, since their ids pick the articles where they are read."""
    label = date_label(F.col("year"), F.col("month"), F.col("day"), F.col("calendar"), F.col("leap_month"))
    light = articles.select("id", "title", "text", "source_url", "date_original", label.alias("date"))
    ids = evidence.select(F.col("id").alias("packed")).distinct()
    if ids.count() <= MOST_SENT:
        light = light.join(F.broadcast(ids), F.col("id") == F.col("packed"), "left_semi")
    return evidence.join(light, "id").withColumn("label", citation_label(F.col("id"), F.col("date"), F.col("title")))


def facts(found: Retrieved, articles: DataFrame, most: int = MOST_SENTENCES) -> DataFrame:
    """The best sentences of each question's evidence: qid, nth, text, citation_id, source_url, score, rank, date, label.

    A sentence scores by the share of the question's topical tokens that it holds, its article's rank score, and its place; one without
    such a token counts only for questions that ask by date alone. The same sentence counts once.
    """
    topical = F.array_distinct(tokenize(F.array_join("topical_terms", " ")))
    asked = found.trace.filter("date_conflict is null").select("qid", F.when(F.size(topical) > 0, topical).otherwise(F.array_distinct(tokenize(F.col("rewritten_query")))).alias("q"), F.col("similarity_floor.waived").alias("date_only"))
    rows = with_articles(found.evidence.filter("not outside_date_filter"), articles).join(asked, "qid")
    said = rows.select("qid", "q", "date_only", "rank", "id", "source_url", "rerank_score", "date", "label", F.posexplode(sentences(F.col("text"))).alias("position", "sentence")).filter("sentence <> ''")
    overlap = F.size(F.array_intersect("q", tokenize(F.col("sentence")))) / F.greatest(F.lit(1), F.size("q"))
    scored = said.withColumn("overlap", overlap).filter("overlap > 0 or date_only").withColumn("score", F.col("overlap") + F.col("rerank_score") * RANK_WEIGHT - F.col("position") * POSITION_WEIGHT)
    order = [F.round("score", 12).desc(), F.col("rank"), F.col("position")]
    once = scored.withColumn("_nth", F.row_number().over(Window.partitionBy("qid", F.lower("sentence")).orderBy(*order))).filter("_nth = 1")
    best = once.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("nth") <= most)
    return best.select("qid", "nth", F.col("sentence").alias("text"), F.col("id").alias("citation_id"), "source_url", F.round(F.col("score") + 1e-10, 6).alias("score"), "rank", "date", "label")


def _listed(rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """Per question, the items in order."""
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("x")))), lambda s: s["x"]).alias(name))


def answers(found: Retrieved, articles: DataFrame, most: int = MOST_SENTENCES) -> DataFrame:
    """One row per question: answer, facts, analysis, abstained, abstain_reason, citations."""
    picked = facts(found, articles, most)
    lines = _listed(picked, "nth", F.struct("text", "citation_id", "source_url", "score"), "facts")
    dates = picked.groupBy("qid").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    packed = with_articles(found.evidence, articles)
    cited = packed.join(picked.select("qid", F.col("citation_id").alias("id")).distinct(), ["qid", "id"], "left_semi").unionByName(packed.filter("outside_date_filter"))
    cites = _listed(cited, "rank", F.struct("id", "label", F.col("source_url").alias("url")), "citations")
    any_evidence = found.evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    t = found.trace.join(lines, "qid", "left").join(dates, "qid", "left").join(cites, "qid", "left").join(any_evidence, "qid", "left")
    reason = F.when(F.col("date_conflict").isNotNull(), "date-conflict").when(F.col("n").isNull(), "no-evidence").when(F.col("facts").isNull(), "no-topical-sentence").otherwise("")
    r = F.col("date_conflict.requested")
    listed = F.array_join(F.transform("date_conflict.records", lambda x: F.concat(F.when(F.coalesce(x["title"], F.lit("")) == "", x["id"]).otherwise(x["title"]), F.lit(" is dated "), x["date"], F.lit(" ["), x["id"], F.lit("]"))), "; ")
    analysis = F.concat(F.lit("The cited records are dated "), F.array_join("dates", ", "), F.lit(FURTHER))
    text = (
        F.when(F.col("reason") == "date-conflict", F.concat(F.lit(f"{MARKER} No record dated "), joined_date(r["year"], r["month"], r["day"]), F.lit(" supports this question. The matching records give a different date: "), listed, F.lit(".")))
        .when(F.col("reason") == "no-evidence", F.concat(F.lit(f"{MARKER} The retrieved records do not support an answer: "), F.when(F.col("packing.stopped_at").isNotNull(), OVER_BUDGET).otherwise(NOTHING_PASSED), F.lit(".")))
        .when(F.col("reason") == "no-topical-sentence", F.lit(f"{MARKER} {UNMENTIONED}"))
        .otherwise(F.concat(F.lit("Objective facts:\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f["text"], F.lit(" ["), f["citation_id"], F.lit("]"))), "\n"), F.lit("\n\nContextual analysis:\n"), analysis))
    )
    return t.withColumn("reason", reason).select(
        "qid", text.alias("answer"), F.when(F.col("reason") == "", F.col("facts")).alias("facts"), F.when(F.col("reason") == "", analysis).otherwise("").alias("analysis"),
        (F.col("reason") != "").alias("abstained"), F.col("reason").alias("abstain_reason"), "citations", F.lit("extractive-offline-baseline").alias("generation"))


def grounding_prompts(found: Retrieved, articles: DataFrame) -> DataFrame:
    """qid, prompt: the question with its date filter, then the sources, for a language model."""
    flag = F.when(F.col("outside_date_filter"), "\nNOTE: outside the requested date").otherwise("")
    original = F.when(F.coalesce("date_original", F.lit("")) != "", F.concat(F.lit(" | original: "), "date_original")).otherwise("")
    block = F.concat(F.lit("SOURCE ["), "id", F.lit("]\nDATE: "), "date", original, F.lit("\nTITLE: "), F.coalesce("title", F.lit("")), F.lit("\nURL: "), F.coalesce("source_url", F.lit("")), flag, F.lit("\nTEXT: "), "text")
    blocks = _listed(with_articles(found.evidence, articles), "rank", block, "blocks")
    f = F.col("date_filter")
    date = F.when(f["year"].isNull(), "none").otherwise(F.concat(joined_date(f["year"], f["month"], f["day"]), F.when(f["year_end"].isNotNull(), F.concat(F.lit(" to "), f["year_end"].cast("string"))).otherwise("")))
    head = F.concat(
        F.lit("QUESTION: "), "original_query", F.lit("\nREGENERATED QUERY: "), "rewritten_query", F.lit("\nDATE FILTER: "), date, F.lit(" (from "), f["source"], F.when(f["widened"], ", widened to all records").otherwise(""), F.lit(")\n"),
        F.when(F.col("date_conflict").isNotNull(), "NOTE: no record matched the requested date; the sources below come from other dates.\n").otherwise(""),
        F.when(F.col("blocks").isNull(), "NOTE: no source passed the date filter and similarity floor.\n").otherwise(""))
    return found.trace.join(blocks, "qid", "left").select("qid", F.concat(head, F.lit("\n"), F.coalesce(F.array_join("blocks", "\n\n"), F.lit(""))).alias("prompt"))


def checked(outputs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Model outputs (qid, text) against the evidence: citations in rank order, unknown_citations sorted, analysis, abstained."""
    known = evidence.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("known"))
    o = outputs.join(known, "qid", "left").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<string>)"))).withColumn("cited", cited_ids(F.col("text")))
    gone = abstains(F.col("text"))
    return o.select("qid", F.trim("text").alias("answer"), F.array_intersect("known", "cited").alias("citations"), F.array_sort(F.array_except("cited", "known")).alias("unknown_citations"),
                    analysis_section(F.col("text")).alias("analysis"), gone.alias("abstained"), F.when(gone, "model-abstained").otherwise("").alias("abstain_reason"))

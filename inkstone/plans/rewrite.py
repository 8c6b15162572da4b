"""Question rewriting from an alias table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.dates import date_spec
from inkstone.functions.text import joined_date

EVENTS = "pos int, name string, year int, month int, day int, aliases array<string>, details array<string>"
#: Bytes of terms that are sent to all tasks at once; a larger table takes several passes over the questions.
SENT_BYTES = 32_000_000


def _finder(terms: list[str]) -> Callable[[Iterator], Iterator]:
    """Which of the terms each text holds: one automaton a task, one pass a text."""

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        search = ahocorasick.Automaton()
        for term in terms:
            if term:
                search.add_word(term, term)
        search.make_automaton()
        everywhere = [t for t in terms if not t]
        for batch in batches:
            present = []
            for text in batch.column("low").to_pylist():
                found = dict.fromkeys(x for _, x in search.iter(text)) if text is not None and len(search) else {}
                present.append([*found, *(everywhere if text is not None else [])])
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(present, pa.list_(pa.string()))], ["qid", "present"])

    return run


def present_terms(texts: DataFrame, terms: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """qid, present: the distinct terms (term) that each text (qid, low) holds as a part; a row for each slice of the terms, of sent_bytes at most."""
    terms = terms.filter("term is not null").distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    slices = max(1, -(-size // sent_bytes))
    out = None
    for i in range(slices):
        part = sorted(r.term for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == i).collect())
        found = texts.select("qid", "low").mapInArrow(_finder(part), f"qid {texts.schema['qid'].dataType.simpleString()}, present array<string>")
        out = found if out is None else out.unionByName(found)
    return out


def rewritten(questions: DataFrame, events: DataFrame) -> DataFrame:
    """questions (qid, original) with column rewritten: the question, the terms and details of the events it names that it lacks, and a date.

    Events follow their position; the date is that of the first named event with a year, and is added only if the question has none. Matching ignores
    case. All terms and details are searched together, in one pass over a question; events meet questions by the terms found.
    """
    none = F.expr("cast(array() as array<string>)")
    e = events.select("*", F.concat(F.array("name"), F.coalesce("aliases", none)).alias("terms"), F.coalesce("details", none).alias("more")).withColumnRenamed("pos", "_pos")
    names = e.select("_pos", F.explode("terms").alias("term")).select("_pos", F.lower("term").alias("term"))
    said = names.select("term").unionByName(e.select(F.explode("more").alias("term")).select(F.lower("term").alias("term")))
    low = questions.select("qid", F.lower("original").alias("low"))
    present = present_terms(low, said).filter(F.size("present") > 0)
    present = present.groupBy("qid").agg(F.flatten(F.collect_list("present")).alias("present"))  # as many rows as slices
    named = present.select("qid", "present", F.explode("present").alias("term")).join(names, "term").select("qid", "present", "_pos").distinct().join(e, "_pos")
    lacks = lambda words: F.filter(words, lambda x: ~F.array_contains("present", F.lower(x)))
    date = F.when(F.col("year").isNotNull(), joined_date(F.col("year"), F.col("month"), F.when(F.col("month").isNotNull(), F.col("day"))))
    named = named.select("qid", "_pos", F.concat(lacks(F.col("terms")), lacks(F.col("more"))).alias("extra"), date.alias("date"))
    per = named.groupBy("qid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "extra"))), lambda s: s["extra"])).alias("extra"), F.min_by("date", F.when(F.col("date").isNotNull(), F.col("_pos"))).alias("date"))
    q = questions.join(per, "qid", "left").withColumn("_asked", date_spec("original")["year"])
    dated = F.when(F.col("_asked").isNull() & F.col("date").isNotNull(), F.array(F.concat(F.lit("approximate date: "), "date"))).otherwise(none)
    extra = F.concat(F.coalesce("extra", none), dated)
    text = F.when(F.size(extra) > 0, F.concat("original", F.lit(" | related: "), F.array_join(extra, "; "))).otherwise(F.col("original"))
    return q.withColumn("rewritten", text).select(*questions.columns, "rewritten")

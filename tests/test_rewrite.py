"""Alias matching by automaton against a search of every alias in every question."""

import random

from pyspark.sql import functions as F

from inkstone.plans.rewrite import EVENTS, present_terms, rewritten


def test_rewriting_by_every_alias(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abAB é가", k=draw.randint(1, 4)))
    events = [(i, word(), draw.choice([None, 1420]), draw.choice([None, 5]), draw.choice([None, 12]), draw.choice([None, [], [word() for _ in range(3)]]), draw.choice([None, [word()]])) for i in range(40)]
    events.append((40, "", None, None, None, ["zz"], ["é"]))  # an empty name is part of every question
    texts = ["".join(draw.choices("abAB é가", k=draw.randint(0, 12))) for _ in range(80)] + [None]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, original string")
    got = {r.qid: r.rewritten for r in rewritten(q, spark.createDataFrame(events, EVENTS)).collect()}
    for i, text in enumerate(texts):
        extra, date = [], None
        for _, name, y, m, d, aliases, details in events:
            terms = [name, *(aliases or [])]
            if text is not None and any(t.lower() in text.lower() for t in terms):
                extra += [x for x in [*terms, *(details or [])] if x.lower() not in text.lower()]
                if y and date is None:
                    date = "-".join(f"{x:02}" for x in (y, m, d if m else None) if x)
        extra += [f"approximate date: {date}"] if date else []
        assert got[i] == (f"{text} | related: {'; '.join(extra)}" if extra else text)


def test_a_hundred_thousand_aliases_in_one_pass(spark):
    events = spark.range(20_000).select(
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("event "), F.hex("id"), F.lit("!")).alias("name"), *[F.lit(None).cast("int").alias(c) for c in ("year", "month", "day")],
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("alias "), F.hex("id"), F.lit("."), k.cast("string"), F.lit(";"))).alias("aliases"), F.lit(None).cast("array<string>").alias("details"))
    q = spark.range(500).select(F.col("id").alias("qid"), F.concat(F.lit("of ALIAS "), F.hex("id"), F.lit(".3; and event "), F.hex(F.col("id") + 7), F.lit("!")).alias("original"))
    out = rewritten(q, events)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.qid: r.rewritten for r in out.collect()}
    assert len(rows) == 500 and rows[255].split(" | related: ")[1].split("; ")[0] == "event FF!" and rows[3].count("alias") == 9
    # a table above the size that is sent at once takes several passes
    terms = events.select(F.explode("aliases").alias("term")).select(F.lower("term").alias("term"))
    low = q.select("qid", F.lower("original").alias("low"))
    one = {(r.qid, t) for r in present_terms(low, terms).collect() for t in r.present}
    many = present_terms(low, terms, sent_bytes=3_000_000)
    assert {(r.qid, t) for r in many.collect() for t in r.present} == one and len(one) == 500 and many.count() > 500

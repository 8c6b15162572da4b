"""Registered queries of the retrieval engine and their SQL for DuckDB.

`documents` has no titles or dates, so the adapter view `articles` makes them up by the same formula in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.functions import text as T
from inkstone.functions.dates import date_spec, record_date, without_dates
from inkstone.plans import answer as A
from inkstone.plans import index as I
from inkstone.plans.kept import alive, file_marks
from inkstone.plans.retrieve import prepared, retrieve
from inkstone.plans.rewrite import EVENTS, rewritten
from inkstone.sources.articles import day_list, expand_years, resumed

TITLE = r"^[^.\n]{1,80}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), F.regexp_extract("text", TITLE, 0).alias("title"), "text", (1418 + d % 33).cast("int").alias("year"), (1 + d % 12).cast("int").alias("month"),
        (1 + d % 28).cast("int").alias("day"), (d % 37 == 0).alias("leap_month"), F.when(d % 2 == 0, "lunar").otherwise("").alias("calendar"), F.lit("").alias("source_url"), F.lit("").alias("date_original"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("original"))


def dated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with an explicit year that no article has."""
    return questions(spark, sf_dir).withColumn("original", F.concat("original", F.lit(" in 1900")))


def _strings(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(x: str) -> str:
    return (f"flatten(list_transform(regexp_extract_all({x}, '{T.RUNS}'), lambda r: case when regexp_matches(r, '^[{T.LATIN}]') then "
            f"case when length(r) > 1 and not list_contains({_strings(T.STOPWORDS)}, lower(r)) then [lower(r)] else cast([] as varchar[]) end "
            "when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) end))")  # fmt: skip


def _cost(x: str) -> str:
    hangul, hanja = f"len(regexp_extract_all({x}, '[{T.HANGUL}]'))", f"len(regexp_extract_all({x}, '[{T.HANJA}]'))"
    return f"cast(greatest(1, {hangul} + 2 * {hanja} + ceil(greatest(0, length(regexp_replace({x}, '\\s', '', 'g')) - {hangul} - {hanja}) / 3.0)) as bigint)"


_TWO = "case when length(cast({0} as varchar)) < 2 then lpad(cast({0} as varchar), 2, '0') else cast({0} as varchar) end"
_LABEL = f"concat_ws('-', {_TWO.format('year')}, {_TWO.format('month')}, {_TWO.format('day')}) || case when calendar = 'lunar' then case when leap_month then ' (lunar leap month)' else ' (lunar)' end else '' end"
ARTICLES = f"""articles as (select cast(doc_id as varchar) as id, regexp_extract(text, '{TITLE}', 0) as title, text, cast(1418 + doc_id % 33 as integer) as year,
  cast(1 + doc_id % 12 as integer) as month, cast(1 + doc_id % 28 as integer) as day, doc_id % 37 = 0 as leap_month, case when doc_id % 2 = 0 then 'lunar' else '' end as calendar from documents)"""
INDEX = f"""{ARTICLES},
tok as (select id, unnest({_tokens("title || ' ' || text")}) as term from articles), tf as (select id, term, count(*) as tf from tok group by all),
idf as (select term, count(*) as df, ln((1.0 + (select count(*) from articles)) / (1 + count(*))) + 1 as idf from tf group by term),
raw as (select id, term, round(tf * idf, 6) as w from tf join idf using (term)), norm as (select id, sqrt(sum(w * w)) as norm from raw group by id),
post as (select id, term, round(w / case when norm = 0 then 1 else norm end, 6) as weight from raw join norm using (id)),
title as (select distinct id, unnest({_tokens("title")}) as term from articles)"""


def _ranking(question: str) -> str:
    return f"""{INDEX},
q as (select cast(item_id as varchar) as qid, {question} as original from benchmark), qt as (select qid, unnest({_tokens("original")}) as term from q),
qtf as (select qid, term, count(*) as tf from qt group by all), qw as (select qid, term, tf * coalesce(idf, 1.0) as w from qtf left join idf using (term)),
qn as (select qid, sqrt(sum(w * w)) as n, count(*) as terms from qw group by qid),
base as (select qid, id, sum(w / n * weight) as base from qw join qn using (qid) join post using (term) group by all),
hit as (select qid, id, count(*) as hits from qw join title using (term) group by all),
scored as (select qid, id, base, base + 0.15 * (coalesce(hits, 0) / greatest(1, terms)) as rerank, {_cost("title || chr(10) || text")} as cost
  from base join qn using (qid) left join hit using (qid, id) join articles using (id)),
ranked as (select *, row_number() over (partition by qid order by round(rerank, 12) desc, id) as rank from scored where round(base, 12) >= 0.05),
run as (select *, sum(cost) over (partition by qid order by rank rows unbounded preceding) as running from ranked)"""


EVIDENCE_SQL = _ranking("text")
_SENTENCES = "string_split_regex(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+')"
_FACTS = f"""{EVIDENCE_SQL},
ev as (select * from run where running <= 2400), asked as (select qid, list_distinct({_tokens("original")}) as q from q),
said as (select qid, rank, id, round(rerank, 6) as rerank_score, generate_subscripts({_SENTENCES}, 1) - 1 as position, trim(unnest({_SENTENCES})) as sentence from ev join articles using (id)),
over as (select said.*, len(list_intersect(q, list_distinct({_tokens("sentence")}))) / greatest(1, len(q)) as overlap from said join asked using (qid) where sentence <> ''),
sc as (select *, overlap + rerank_score * 0.35 - position * 1e-4 as s from over where overlap > 0),
once as (select *, row_number() over (partition by qid, lower(sentence) order by round(s, 12) desc, rank, position) as k from sc),
best as (select *, row_number() over (partition by qid order by round(s, 12) desc, rank, position) as nth from once where k = 1 qualify nth <= 6)"""
_YEAR_FORMS = ["'in {y}'", "'{y} AD'", "'{y}년'", "'dated {y}.'", "'the policies of {y}?'", "'세종 ' || ({y} - 1418) || '년'", "'Sejong year ' || ({y} - 1418)"]
_DAY_FORMS = ["'{y}-{m}-{d}'", "'{y}/{m}/{d}'", "'{y}년 {m}월 {d}일'", "'{n} {d}, {y}'", "'{d} {n} {y}'", "'the {d}th of {n}, {y}'", "'세종 ' || ({y} - 1418) || '년 {m}월 {d}일'"]
_NAMES = "January February March April May June July August September October November December".split()
_EVENT_ROWS = [(0, "the reading", 1446, 9, None, ["and of", "THE new Script"], ["correct sounds"]), (1, "hall", 1420, 3, 16, ["thereth"], None), (2, "is the", None, None, None, [], ["detail of it"])]


def _filled(form: str) -> str:
    for k, v in (("y", "cast(y as string)"), ("m", "cast(m as string)"), ("d", "cast(d as string)"), ("n", f"element_at(array({', '.join(repr(n) for n in _NAMES)}), m)")):
        form = form.replace(f"({{{k}}} - 1418)", f"cast({k} - 1418 as string)").replace(f"{{{k}}}", f"' || {v} || '")
    return form


_BUILT: dict[tuple, I.Index] = {}


def _index(spark, d):
    """The articles' index, built once a session and written, as a service holds it; built anew where the table's files or its own have changed."""
    key = (spark.sparkContext.applicationId, d, file_marks(read(spark, d, "documents")))
    if key not in _BUILT or not all(map(alive, (_BUILT[key].idf, _BUILT[key].postings, _BUILT[key].parts, _BUILT[key].heads))):
        _BUILT[key] = I.build(articles(spark, d))
    return _BUILT[key]


def evidence_of(spark, d, q=None):
    return retrieve(_index(spark, d), questions(spark, d) if q is None else q)


def tokenize_bigram_runs(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return articles(spark, d).select("id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


def tokenize_legacy(spark: SparkSession, d: str) -> DataFrame:
    t = T.legacy_tokenize(F.col("text"))
    return articles(spark, d).select("id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", T.token_cost(F.concat("title", F.lit("\n"), "text")).alias("cost"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    return I.inverse_frequencies(I.term_counts(a), a).select("term", "df", F.round("idf", 10).alias("idf"))


def tfidf_postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.select("id", "term", "weight")


def retrieve_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence_of(spark, d).evidence.select("qid", F.col("rank").cast("long").alias("rank"), "id", "similarity", "rerank_score", "estimated_tokens")


def packing_stopped_at(spark: SparkSession, d: str) -> DataFrame:
    return evidence_of(spark, d).trace.select("qid", F.col("packing.stopped_at").alias("stopped_at"), "estimated_tokens", F.col("similarity_floor.below_floor").alias("below_floor"))


def date_conflict_records(spark: SparkSession, d: str) -> DataFrame:
    t = evidence_of(spark, d, dated_questions(spark, d)).trace.filter("date_conflict is not null")
    r = t.select("qid", F.posexplode("date_conflict.records").alias("place", "r"))
    return r.select("qid", (F.col("place") + 1).cast("long").alias("place"), "r.id", "r.date", "r.similarity")


def date_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = [("exact", "What happened on May 12, 1420?", None), ("partial", "records of March 1425", None), ("year", "policies in 1430", None), ("range", "between 1420 and 1425", None),
            ("inferred", "the new script", "the new script | related: sounds; approximate date: 1446-09"), ("widened", "the hall", "the hall | related: approximate date: 1899"), ("none", "28 letters", None)]
    q = spark.createDataFrame(rows, "qid string, original string, rewritten string")
    t = retrieve(_index(spark, d), q).trace
    f, s = F.col("date_filter"), F.col("similarity_floor")
    return t.select("qid", f["year"].alias("year"), f["month"].alias("month"), f["day"].alias("day"), f["year_end"].alias("year_end"), f["mode"].alias("mode"), f["source"].alias("source"), f["widened"].alias("widened"), s["waived"].alias("waived"))


def labels_and_citations(spark: SparkSession, d: str) -> DataFrame:
    label = T.date_label(*[F.col(c) for c in ("year", "month", "day", "calendar", "leap_month")])
    return articles(spark, d).select("id", label.alias("label"), T.citation_label(F.col("id"), label, F.col("title")).alias("citation"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = F.filter(T.sentences(F.col("text")), lambda x: x != "")
    return articles(spark, d).select("id", F.size(s).cast("long").alias("n_sentences"), F.array_join(s, "\n").alias("sentences"))


def extractive_facts(spark: SparkSession, d: str) -> DataFrame:
    f = A.facts(evidence_of(spark, d), articles(spark, d))
    return f.select("qid", F.col("nth").cast("long").alias("nth"), "text", "citation_id", "score")


def answers(spark: SparkSession, d: str) -> DataFrame:
    a = A.answers(evidence_of(spark, d), articles(spark, d))
    return a.select("qid", "answer", "analysis", "abstained", "abstain_reason", F.array_join(F.transform("citations", lambda c: c["label"]), "; ").alias("citations"))


def conflict_answers(spark: SparkSession, d: str) -> DataFrame:
    a = A.answers(evidence_of(spark, d, dated_questions(spark, d)), articles(spark, d))
    return a.select("qid", "abstain_reason", "abstained")


def grounding_prompts(spark: SparkSession, d: str) -> DataFrame:
    return A.grounding_prompts(evidence_of(spark, d), articles(spark, d)).select("qid", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def checked_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Model texts that cite an evidence id and an unknown one."""
    found = evidence_of(spark, d)
    out = found.evidence.filter("rank = 1").select("qid", F.concat(F.lit("It is so ["), "id", F.lit(", ghost]. Contextual analysis: from ["), "id", F.lit("]")).alias("text"))
    c = A.checked(out, found.evidence)
    return c.select("qid", F.array_join("citations", ",").alias("citations"), F.array_join("unknown_citations", ",").alias("unknown_citations"), "analysis", "abstained")


def rule_rewrite(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("original"))
    return rewritten(q, spark.createDataFrame(_EVENT_ROWS, EVENTS)).select("qid", "rewritten")


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "documents").select(F.lit("m").alias("month_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"))
    return resumed(ids, read(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id")


def crawl_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 new ids: the cap is the feature."""
    ids = read(spark, d, "documents").select(F.lit("m").alias("month_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"))
    return resumed(ids, read(spark, d, "labels").select(F.col("doc_id").alias("id")), 25).select("id")


def day_lists(spark: SparkSession, d: str) -> DataFrame:
    call = F.concat(F.lit("<a href=\"javascript:searchView('kda_1020503"), F.lit("0_"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit("')\">x</a>"))
    return day_list(read(spark, d, "pages").select(F.lit("kda_102050").alias("month_id"), F.concat(call, call, "html").alias("html"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def year_spec_expand(spark: SparkSession, d: str) -> DataFrame:
    return expand_years(spark.createDataFrame([("0-5,28",), ("7",), ("9-8,8",)], "spec string"))


def _dense(spark: SparkSession, d: str, asked: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit("").alias("text"), F.lit("").alias("title"),
        *[F.lit(None).cast("int").alias(c) for c in ("year", "month", "day")], F.lit("").alias("calendar"), F.lit(False).alias("leap_month"))
    q = e.filter(asked).select(F.col("id").alias("qid"), F.lit("stones").alias("original"), "vector")
    found = retrieve(I.build(e, backend="dense"), q.select("qid", "original"), vectors=q.select("qid", "vector"))
    return found.evidence.select("qid", F.col("rank").cast("long").alias("rank"), "id", "similarity")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    return _dense(spark, d, "cast(id as long) % 50 = 0")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).agg(F.count(F.lit(1)).alias("n_articles"), F.countDistinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if("leap_month").alias("n_leap"))


def _dated(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    k = F.col("o_orderkey")
    keys = read(spark, d, "orders").select(k.alias("key"), (1418 + k % 33).cast("int").alias("y"), (1 + k % 12).cast("int").alias("m"), (10 + k % 19).cast("int").alias("d"))
    whens = " ".join(f"when {i} then {_filled(f)}" for i, f in enumerate(forms))
    return keys.withColumn("said", F.expr(f"case key % {len(forms)} {whens} end"))


def date_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d, _DAY_FORMS).withColumn("s", date_spec("said")).select("key", "s.year", "s.month", "s.day")


def year_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d, _YEAR_FORMS).withColumns({"s": date_spec("said"), "more": F.concat(F.lit("halls "), "said")}).select("key", "s.year", "s.month", F.trim(without_dates("more")).startswith("halls").alias("blanked"))


def range_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    forms = ["'between {y} and ' || (y + 5)", "'from {y} to ' || (y + 5)", "'{y}–' || (y + 5)", "'{y}년부터 ' || (y + 5) || '년까지'"]
    return _dated(spark, d, forms).withColumn("s", date_spec("said")).select("key", "s.year", "s.year_end")


def bare_numbers_rejected(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (1418 + F.col("o_orderkey") % 33).cast("string").alias("y"))
    return r.withColumn("said", F.concat("y", F.lit(" soldiers marched"))).withColumns({"s": date_spec("said"), "f": record_date("y")}).select("key", F.col("s.year").alias("free_year"), F.col("f.year").alias("field_year"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_bigram_runs, tokenize_legacy, token_estimate, idf_table, tfidf_postings, retrieve_evidence, packing_stopped_at, date_conflict_records, date_filters, labels_and_citations,
        sentence_split, extractive_facts, answers, conflict_answers, grounding_prompts, checked_outputs, rule_rewrite, resume_anti_join, crawl_cap, day_lists, year_spec_expand, dense_topk,
        corpus_stats, date_parse_roundtrip, year_parse_roundtrip, range_parse_roundtrip, bare_numbers_rejected,
    )
}

_ANALYSIS = f"'The cited records are dated ' || array_to_string(list_sort(list(distinct date)), ', ') || '{A.FURTHER}'"
ORACLE_SQL: dict[str, str] = {
    "tokenize_bigram_runs": f"with {ARTICLES} select id, array_to_string({_tokens('text')}, ' ') as tokens, cast(len({_tokens('text')}) as bigint) as n_tokens from articles",
    "tokenize_legacy": f"with {ARTICLES}, t as (select id, list_transform(list_filter(regexp_extract_all(text, '[{T.LATIN}{T.HANGUL}]+'), lambda w: length(w) > 1), lambda w: lower(w)) as t from articles) select id, array_to_string(t, ' ') as tokens, cast(len(t) as bigint) as n_tokens from t",
    "token_estimate": f"with {ARTICLES} select id, {_cost('title || chr(10) || text')} as cost from articles",
    "idf_table": f"with {INDEX} select term, df, round(idf, 10) as idf from idf",
    "tfidf_postings": f"with {INDEX} select id, term, weight from post",
    "retrieve_evidence": f"with {EVIDENCE_SQL} select qid, rank, id, round(base, 6) as similarity, round(rerank, 6) as rerank_score, cost as estimated_tokens from run where running <= 2400",
    "packing_stopped_at": f"""with {EVIDENCE_SQL}, s as (select qid, min_by(id, rank) filter (running > 2400) as stopped_at, coalesce(sum(cost) filter (running <= 2400), 0) as used, count(*) as kept from run group by qid)
      select qid, stopped_at, cast(coalesce(used, 0) as bigint) as estimated_tokens, cast((select count(*) from articles) - coalesce(kept, 0) as bigint) as below_floor from q left join s using (qid)""",
    "date_conflict_records": f"""with {_ranking("text || ' in 1900'")} select qid, rank as place, id, {_LABEL} as date, round(base, 6) as similarity from ranked join articles using (id) where rank <= 3""",
    "date_filters": f"""with {ARTICLES}, v(qid, year, month, day, year_end, mode, source, widened, waived) as (values ('exact', 1420, 5, 12, null, 'exact-or-partial-date', 'original', false, true), ('partial', 1425, 3, null, null, 'exact-or-partial-date', 'original', false, true),
      ('year', 1430, null, null, null, 'exact-or-partial-date', 'original', false, false), ('range', 1420, null, null, 1425, 'year-range', 'original', false, true),
      ('inferred', 1446, 9, null, null, 'x', 'regenerated', false, false), ('widened', 1899, null, null, null, 'x', 'regenerated', false, false), ('none', null, null, null, null, 'all-records', 'none', false, false)),
      n as (select v.qid, count(a.id) as n from v left join articles a on a.year = v.year and (v.month is null or a.month = v.month) group by v.qid)
      select qid, cast(year as integer) as year, cast(month as integer) as month, cast(day as integer) as day, cast(year_end as integer) as year_end,
        case when mode <> 'x' then mode when n < 2 then 'inferred-date-fallback-all' else 'exact-or-partial-date' end as mode, source, source = 'regenerated' and n < 2 as widened, waived from v join n using (qid)""",
    "labels_and_citations": f"with {ARTICLES}, l as (select id, title, {_LABEL} as label from articles) select id, label, trim('[' || id || '] ' || label || ' ' || title) as citation from l",
    "sentence_split": f"with {ARTICLES}, s as (select id, list_filter(list_transform({_SENTENCES}, lambda x: trim(x)), lambda x: x <> '') as s from articles) select id, cast(len(s) as bigint) as n_sentences, array_to_string(s, chr(10)) as sentences from s",
    "extractive_facts": f"with {_FACTS} select qid, nth, sentence as text, id as citation_id, round(s + 1e-10, 6) as score from best",
    "answers": f"""with {_FACTS}, b as (select best.*, {_LABEL} as date from best join articles using (id)),
      g as (select qid, string_agg('- ' || sentence || ' [' || id || ']', chr(10) order by nth) as facts, {_ANALYSIS} as analysis from b group by qid),
      c as (select qid, string_agg(label, '; ' order by rank) as citations from (select distinct qid, rank, trim('[' || id || '] ' || {_LABEL} || ' ' || title) as label from best join articles using (id)) group by qid),
      st as (select qid, count(*) filter (running <= 2400) as n, count(*) filter (running > 2400) > 0 as stopped from run group by qid),
      r as (select qid, facts, g.analysis as found, citations, case when coalesce(n, 0) = 0 then 'no-evidence' when facts is null then 'no-topical-sentence' else '' end as reason, coalesce(stopped, false) as stopped
        from q left join g using (qid) left join c using (qid) left join st using (qid))
      select qid, case reason when '' then 'Objective facts:' || chr(10) || facts || chr(10) || chr(10) || 'Contextual analysis:' || chr(10) || found
        when 'no-evidence' then '{A.MARKER} The retrieved records do not support an answer: ' || case when stopped then '{A.OVER_BUDGET}' else '{A.NOTHING_PASSED}' end || '.' else '{A.MARKER} {A.UNMENTIONED}' end as answer,
        case when reason = '' then found else '' end as analysis, reason <> '' as abstained, reason as abstain_reason, citations from r""",
    "conflict_answers": f"""with {_ranking("text || ' in 1900'")} select qid, case when n > 0 then 'date-conflict' else 'no-evidence' end as abstain_reason, true as abstained from q left join (select qid, count(*) as n from ranked group by qid) using (qid)""",
    "grounding_prompts": f"""with {EVIDENCE_SQL}, b as (select qid, string_agg('SOURCE [' || id || ']' || chr(10) || 'DATE: ' || {_LABEL} || chr(10) || 'TITLE: ' || title || chr(10) || 'URL: ' || chr(10) || 'TEXT: ' || text, chr(10) || chr(10) order by rank) as blocks
        from run join articles using (id) where running <= 2400 group by qid),
      p as (select qid, 'QUESTION: ' || original || chr(10) || 'REGENERATED QUERY: ' || original || chr(10) || 'DATE FILTER: none (from none)' || chr(10)
        || case when blocks is null then 'NOTE: no source passed the date filter and similarity floor.' || chr(10) else '' end || chr(10) || coalesce(blocks, '') as prompt from q left join b using (qid))
      select qid, md5(prompt) as prompt_md5, cast(length(prompt) as bigint) as n_chars from p""",
    "checked_outputs": f"with {EVIDENCE_SQL} select qid, id as citations, 'ghost' as unknown_citations, 'from [' || id || ']' as analysis, false as abstained from run where running <= 2400 and rank = 1",
    "rule_rewrite": """with q as (select conv_id || '-' || turn as qid, text, lower(text) as low from conversations where role = 'user'),
      e(pos, terms, details, date) as (values (0, ['the reading', 'and of', 'THE new Script'], ['correct sounds'], '1446-09'), (1, ['hall', 'thereth'], cast([] as varchar[]), '1420-03-16'), (2, ['is the'], ['detail of it'], null)),
      m as (select qid, text, pos, date, list_filter(list_concat(terms, details), lambda t: not contains(low, lower(t))) as extra from q join e on len(list_filter(terms, lambda t: contains(low, lower(t)))) > 0),
      p as (select qid, flatten(list(extra order by pos)) as extra, min_by(date, pos) filter (date is not null) as date from m group by qid),
      x as (select q.qid, text, list_concat(coalesce(extra, []), case when date is null then cast([] as varchar[]) else ['approximate date: ' || date] end) as extra from q left join p using (qid))
      select qid, case when len(extra) > 0 then text || ' | related: ' || array_to_string(extra, '; ') else text end as rewritten from x""",
    "resume_anti_join": "select doc_id as id from documents where doc_id not in (select doc_id from labels)",
    "crawl_cap": "select doc_id as id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 25",
    "day_lists": "select 'kda_10205030_' || lpad(cast(page_id % 1000 as varchar), 3, '0') as id, count(*) as n from pages group by 1",
    "year_spec_expand": "select spec, cast(year as integer) as year from (values ('0-5,28', [0, 1, 2, 3, 4, 5, 28]), ('7', [7]), ('9-8,8', [8, 9])) v(spec, ys), unnest(ys) u(year)",
    "dense_topk": """with e as (select cast(vec_id as varchar) as id, vec_id, cast(embedding as double[]) as v from embeddings), s as (select q.id as qid, e.id as id, list_dot_product(q.v, e.v) as s from e q, e where q.vec_id % 50 = 0),
      r as (select *, row_number() over (partition by qid order by round(s, 12) desc, id) as rank from s where round(s, 12) >= 0.3) select qid, rank, id, round(s, 6) as similarity from r where rank <= 2400""",
    "corpus_stats": f"with {ARTICLES} select count(*) as n_articles, count(distinct year) as n_years, min(year) as first_year, max(year) as last_year, count(*) filter (leap_month) as n_leap from articles",
    "date_parse_roundtrip": "select o_orderkey as key, cast(1418 + o_orderkey % 33 as integer) as year, cast(1 + o_orderkey % 12 as integer) as month, cast(10 + o_orderkey % 19 as integer) as day from orders",
    "year_parse_roundtrip": "select o_orderkey as key, cast(1418 + o_orderkey % 33 as integer) as year, cast(null as integer) as month, true as blanked from orders",
    "range_parse_roundtrip": "select o_orderkey as key, cast(1418 + o_orderkey % 33 as integer) as year, cast(1423 + o_orderkey % 33 as integer) as year_end from orders",
    "bare_numbers_rejected": "select o_orderkey as key, cast(null as integer) as free_year, cast(1418 + o_orderkey % 33 as integer) as field_year from orders",
}

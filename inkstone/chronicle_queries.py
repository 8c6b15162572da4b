"""Registered queries of chronicle pages and model adapters, by round trips: strings built from known values must give these values back."""

from __future__ import annotations

import json
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.models import PROFILES, Command, Endpoint, answered_by, chat_payload, instructions, reasons, rewritten_by
from inkstone.queries import EVIDENCE_SQL, articles, evidence_of, questions, read
from inkstone.sources.chronicle import article_pages, crawl_cache, date_line, within_caps

MODELS = [("standard", "vendor/small-chat"), ("reasoning", "vendor/o3-mini")]

#: Pages by page_id: a reign year, month, day and leap month each, the id and the date line that tell them.
_KEYS = "page_id % 33 as reign, 1 + page_id % 12 as month, 1 + page_id % 28 as day, page_id % 2 as leap"
_ID = "'kda_1' || lpad(cast(reign as {s}), 2, '0') || lpad(cast(month as {s}), 2, '0') || cast(leap as {s}) || lpad(cast(day as {s}), 2, '0') || '_' || lpad(cast(page_id % 1000 as {s}), 3, '0')"
_LINE = """'세종실록 ' || cast(page_id % 90 as {s}) || '권, 세종 ' || case when reign = 0 then '즉위년' else cast(reign as {s}) || '년' end || case when leap = 1 then ' 윤' else ' ' end
  || cast(month as {s}) || '월 ' || cast(day as {s}) || '일 갑자 ' || cast(1 + page_id % 5 as {s}) || '/9기사 / ' || cast(1418 + reign as {s}) || '년'"""
_HTML = f"""'<nav>menu</nav><div class="detail-view"><div class="title-head"><p class="date">' || {_LINE} || '</p><h3>Title <em>' || cast(page_id as {{s}}) || '</em></h3></div><div class="view-item left">'
  || '<div class="view-text"><p class="paragraph">Halls   opened<sup>1)</sup> &amp; closed.</p><p class="paragraph"> </p><p class="paragraph">Then ' || cast(page_id as {{s}}) || '.</p>'
  || '<ul class="ins_footnote"><li>[註 001] a note</li></ul><ul class="bot-info"><li><a>law</a><span>copy</span></li></ul></div></div></div><div class="detail-view"><p class="paragraph">again</p></div>'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    keyed = read(spark, d, "pages").selectExpr("page_id", *_KEYS.split(", "))
    return keyed.selectExpr("page_id", f"{_ID.format(s='string')} as id", f"{_LINE.format(s='string')} as line", f"{_HTML.format(s='string')} as html")


def article_page_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    good, _ = article_pages(_pages(spark, d), "https://archive.invalid")
    return good.select("id", "date", "title", "text", "volume", "ganji", F.array_join("notes", "|").alias("notes"), F.array_join("categories", "|").alias("categories"), F.array_join("copies", "|").alias("copies"),
                       F.size("parse_warnings").cast("long").alias("n_warnings"))


def article_page_failures(spark: SparkSession, d: str) -> DataFrame:
    """The table's own pages are no chronicle pages: each fails, with its reason."""
    pages = read(spark, d, "pages").selectExpr("case when page_id % 2 = 0 then 'kda_10205029_001' else cast(page_id as string) end as id", "html")
    return article_pages(pages, "https://archive.invalid")[1].groupBy("id", "error").agg(F.count(F.lit(1)).alias("n"))


def date_line_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).withColumn("d", date_line(F.col("line")))
    return p.select("page_id", *[F.col(f"d.{c}").alias(c) for c in ("book", "vol", "king", "reign", "leap", "month", "day", "ganji", "seq", "total", "western")])


def crawl_total_cap(spark: SparkSession, d: str) -> DataFrame:
    """New ids up to 60 with those stored before them: the cap is the feature."""
    stored = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("stored"))
    ids = read(spark, d, "documents").select(F.lit(0).alias("month_pos"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id")).join(stored, "id", "left")
    return within_caps(ids.withColumn("stored", F.coalesce("stored", F.lit(False))), max_total=60).select("id")


def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    """A crawl over cached pages that resumes after every fifth article."""
    p = _pages(spark, d).withColumn("month_id", F.substring("id", 1, 10))
    index = p.select(F.concat(F.lit("search('"), "month_id", F.lit("', '1', '3')")).alias("html")).distinct()
    days = p.groupBy("month_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("searchView('"), "id", F.lit("')")))), "").alias("html"))
    _, _, summary = crawl_cache(index, days, p.select("id", "html"), p.filter("page_id % 5 = 0").select("id"), "https://archive.invalid")
    return summary.select("months", "skipped", "written", "failed", "stopped")


def chat_payloads(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").filter("role = 'user'")
    parts = None
    for kind, model in MODELS:
        body = turns.select("conv_id", "turn", chat_payload(model, "be brief", F.col("text"), most=400).alias("body"))
        get = lambda path: F.get_json_object("body", path)
        rows = body.select("conv_id", "turn", F.lit(kind).alias("kind"), get("$.model").alias("model"), get("$.messages[0].role").alias("role"), F.md5(get("$.messages[1].content")).alias("content_md5"),
                           get("$.temperature").alias("temperature"), get("$.max_tokens").alias("max_tokens"), get("$.max_completion_tokens").alias("max_completion_tokens"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def echo(url: str, body: str, headers: dict[str, str], seconds: int) -> str:
    """A transport without a network: cites the first source of the prompt and one that is unknown."""
    prompt = json.loads(body)["messages"][-1]["content"]
    at = prompt.find("\nSOURCE [")
    first = prompt[at + 9 : prompt.index("]", at)] if at >= 0 else None
    text = "INSUFFICIENT EVIDENCE: none" if first is None else f"So it is [{first}, ghost].\nContextual analysis: by [{first}]"
    return json.dumps({"choices": [{"message": {"content": text}}]})


def endpoint_answers(spark: SparkSession, d: str) -> DataFrame:
    a = answered_by(Endpoint("https://model.invalid", MODELS[1][1], transport=echo), evidence_of(spark, d), articles(spark, d))
    return a.select("qid", "answer", F.array_join("citations", ",").alias("citations"), F.array_join("unknown_citations", ",").alias("unknown_citations"), "analysis", "abstained", "abstain_reason", "chat_style")


def _short(url: str, body: str, headers: dict[str, str], seconds: int) -> str:
    """A transport that rewrites a question to its first forty characters and a word, or to nothing where it is of even length."""
    said = json.loads(body)["messages"][-1]["content"]
    return json.dumps({"choices": [{"message": {"content": said[:40] + ' again' if len(said) % 2 else ""}}]})


def endpoint_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Questions rewritten by a model; where it returns nothing they stay."""
    return rewritten_by(Endpoint("https://model.invalid", "m", transport=_short), questions(spark, d)).select("qid", "original", "rewritten")


#: A program that answers with the first record of the evidence, as JSON, or abstains in plain text.
_PROGRAM = "import json, sys; e = json.load(sys.stdin).get('evidence') or []; print(json.dumps({'answer': 'It is [' + e[0]['id'] + ', ghost]'}) if e else 'INSUFFICIENT EVIDENCE: none')"


def command_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a program on the executors."""
    a = answered_by(Command(shlex.join([sys.executable, "-c", _PROGRAM])), evidence_of(spark, d), articles(spark, d))
    return a.select("qid", "answer", F.array_join("citations", ",").alias("citations"), F.array_join("unknown_citations", ",").alias("unknown_citations"), "abstained", "generation", "prompt_profile")


def profile_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of all questions under every profile and task, as standard and as reasoning models take them."""
    parts = None
    for profile in PROFILES:
        for task in PROFILES[profile]:
            for style in ("standard", "reasoning"):
                body = chat_payload("m", instructions(profile, task), F.col("original"), style)
                get = lambda path, body=body: F.get_json_object(body, path)
                rows = questions(spark, d).select("qid", F.lit(profile).alias("profile"), F.lit(task).alias("task"), get("$.messages[0].role").alias("role"), F.md5(get("$.messages[0].content")).alias("system_md5"), get("$.messages[1].content").alias("content"))
                parts = rows if parts is None else parts.unionByName(rows)
    return parts


assert [reasons(m) for _, m in MODELS] == [False, True]

QUERIES = {f.__name__: f for f in (article_page_roundtrip, article_page_failures, date_line_roundtrip, crawl_total_cap, crawl_summary, chat_payloads, endpoint_answers, endpoint_rewrites, command_answers, profile_payloads)}

_K = f"with k as (select page_id, {_KEYS} from pages)"
ORACLE_SQL = {
    "article_page_roundtrip": f"""{_K} select {_ID.format(s='varchar')} as id, (1418 + reign) || '-' || lpad(cast(month as varchar), 2, '0') || '-' || lpad(cast(day as varchar), 2, '0') as date, 'Title ' || page_id as title,
      'Halls opened & closed.' || chr(10) || 'Then ' || page_id || '.' as text, '세종실록 ' || page_id % 90 || '권' as volume, '갑자' as ganji, 'a note' as notes, 'law' as categories, 'copy' as copies, cast(0 as bigint) as n_warnings from k""",
    "article_page_failures": """select case when page_id % 2 = 0 then 'kda_10205029_001' else cast(page_id as varchar) end as id, case when page_id % 2 = 0 then 'no article block' else 'not an article id of the chronicle' end as error, count(*) as n from pages group by all""",
    "date_line_roundtrip": f"""{_K} select page_id, '세종실록' as book, cast(page_id % 90 as integer) as vol, '세종' as king, cast(reign as integer) as reign, leap = 1 as leap, cast(month as integer) as month, cast(day as integer) as day,
      '갑자' as ganji, cast(1 + page_id % 5 as integer) as seq, 9 as total, cast(1418 + reign as integer) as western from k""",
    "crawl_total_cap": """select id from (select doc_id as id, row_number() over (order by doc_id) as met, doc_id in (select doc_id from labels) as stored from documents) where met <= 60 and not stored""",
    "crawl_summary": f"""{_K}, i as (select page_id, {_ID.format(s='varchar')} as id from k) select count(distinct substr(id, 1, 10)) as months, count(distinct case when page_id % 5 = 0 then id end) as skipped,
      count(distinct case when page_id % 5 <> 0 then id end) as written, cast(0 as bigint) as failed, false as stopped from i""",
    "endpoint_rewrites": "select cast(item_id as varchar) as qid, text as original, case when length(text) % 2 = 1 then trim(substr(text, 1, 40) || ' again') else text end as rewritten from benchmark",
    "command_answers": f"""with {EVIDENCE_SQL}, t as (select qid, id from q left join (select qid, id from run where running <= 2400 and rank = 1) using (qid))
      select qid, case when id is null then 'INSUFFICIENT EVIDENCE: none' else 'It is [' || id || ', ghost]' end as answer, coalesce(id, '') as citations, case when id is null then '' else 'ghost' end as unknown_citations, id is null as abstained,
        'command-unverified' as generation, 'journal' as prompt_profile from t""",
    "profile_payloads": f"""select cast(item_id as varchar) as qid, profile, task, role, md5(said) as system_md5, text as content from benchmark, (values ('developer'), ('system')) r(role),
      (values {", ".join(f"('{p}', '{t}', '{said.replace(chr(39), 2 * chr(39))}')" for p, tasks in PROFILES.items() for t, said in tasks.items())}) m(profile, task, said)""",
    "chat_payloads": """select conv_id, turn, kind, model, case kind when 'standard' then 'system' else 'developer' end as role, md5(text) as content_md5, case kind when 'standard' then '0' end as temperature,
      case kind when 'standard' then '400' end as max_tokens, case kind when 'reasoning' then '400' end as max_completion_tokens
      from conversations, (values ('standard', 'vendor/small-chat'), ('reasoning', 'vendor/o3-mini')) m(kind, model) where role = 'user'""",
    "endpoint_answers": f"""with {EVIDENCE_SQL}, t as (select qid, id from q left join (select qid, id from run where running <= 2400 and rank = 1) using (qid))
      select qid, case when id is null then 'INSUFFICIENT EVIDENCE: none' else 'So it is [' || id || ', ghost].' || chr(10) || 'Contextual analysis: by [' || id || ']' end as answer, coalesce(id, '') as citations,
        case when id is null then '' else 'ghost' end as unknown_citations, case when id is null then '' else 'by [' || id || ']' end as analysis, id is null as abstained, case when id is null then 'model-abstained' else '' end as abstain_reason,
        'reasoning' as chat_style from t""",
}

"""Registered queries of polite fetching over the table's own URLs, with a transport that answers by what a URL holds, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.kept import folder, kept
from inkstone.queries import read
from inkstone.sources.fetch import MOST_BYTES, CountedClock, Rules, fetch_all, fetched


def _transport():
    """Answers by a URL's host and first number: pages that are missing, too large, flaky, forbidden or never there, robots files of all kinds.

    A page is as long as its number says, so the only ones over the limit of the rules are those that are made so.
    """
    asked: dict[str, int] = {}
    large: list[bytes] = []

    def answer(url: str) -> tuple[int, str, bytes]:
        host, number = url.split("/")[2], re.search(r"/(\d+)", url)
        asked[url] = asked.get(url, 0) + 1
        if url.endswith("/robots.txt"):
            return [(200, "text/plain", b"User-agent: *\nDisallow: /fr/\n"), (404, "", b""), (200, "text/html", b"<html>no file here"), (403, "", b""), (500, "", b"")][len(host) % 5]
        n = int(number[1]) if number else 0
        if n % 50 == 7:
            return 403, "", b""
        if n % 10 == 3:
            return 404, "", b""
        if n % 40 == 11 or n % 10 == 5 and asked[url] == 1:
            return 503, "", b""
        if n % 20 == 9:
            large[:] = large or [b"x" * (MOST_BYTES + 1)]
            return 200, "text/html", large[0]
        return 200, "text/html", b"x" * (n + 1)

    return answer


_RULES = Rules()


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("page_id").cast("string").alias("key"), F.col("page_id").alias("pos"), "url")


def polite_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Every page, each seventh from the cache: outcome, attempts and the second of its first request."""
    cache = read(spark, d, "pages").filter("page_id % 7 = 0").select(F.col("page_id").cast("string").alias("key"), "html")
    log = kept(fetched(_wanted(spark, d), cache, _transport(), _RULES, CountedClock), "polite-fetch")
    return log.select("host", "key", "outcome", "status", "attempts", "at", F.length("html").cast("long").alias("n_chars"))


def fetch_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A crawl in rounds of three pages a host, and another one over its cache: what the second finds there, and what it asks for again."""
    cache = f"{folder(spark)}/inkstone/fetched-{uuid.uuid4().hex}"
    fetch_all(_wanted(spark, d), cache, 3, transport=_transport(), rules=_RULES, clock=CountedClock)
    again = fetch_all(_wanted(spark, d), cache, 1000, transport=_transport(), rules=_RULES, clock=CountedClock)
    return again.select("host", "key", "outcome", F.length("html").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (polite_fetch, fetch_resumed)}

_CRAWL = r"""p as (select page_id, url, lower(split_part(url, '/', 3)) as host, coalesce(try_cast(regexp_extract(url, '/(\d+)', 1) as bigint), 0) as n, {cached} as cached, length(html) as size from pages),
k as (select *, length(host) % 5 as robots, n % 50 = 7 as forbidden, n % 50 <> 7 and n % 10 = 3 as missing, n % 50 <> 7 and n % 10 <> 3 and n % 40 = 11 as gone, n % 50 <> 7 and n % 10 = 5 as flaky from p where not cached),
s as (select *, robots = 0 and starts_with(substr(url, strpos(url, host) + length(host)), '/fr/') as barred, case when gone then 35 when flaky then 5 else 0 end as extra from k),
o as (select *, row_number() over w as turn, robots = 3 or count(*) filter (barred or forbidden or gone) over (partition by host order by page_id rows between unbounded preceding and 1 preceding) > 0 as over,
  coalesce(sum(extra) over (partition by host order by page_id rows between unbounded preceding and 1 preceding), 0) as pauses from s window w as (partition by host order by page_id)),
f as (select *, over or barred as unasked, case when over or barred or forbidden or gone then 'stopped' when missing then 'missing' when n % 20 = 9 then 'too-large' else 'fetched' end as outcome from o)"""
ORACLE_SQL = {
    "polite_fetch": f"""with {_CRAWL.format(cached="page_id % 7 = 0")}
      select host, cast(page_id as varchar) as key, outcome, cast(case when unasked then null when forbidden then 403 when missing then 404 when gone then 503 else 200 end as integer) as status,
        cast(case when unasked then 0 when gone then 4 when flaky then 2 else 1 end as integer) as attempts, case when not unasked then cast(1.5 * turn + pauses as double) end as at, case when outcome = 'fetched' then n + 1 end as n_chars from f
      union all select host, cast(page_id as varchar), 'cached', null, 0, null, size from p where cached""",
    # a page that was fetched is cached; of the others a host's first asks anew, unless the host had ended before it
    "fetch_resumed": f"""with {_CRAWL.format(cached="false")}, g as (select f.*, row_number() over (partition by host, outcome = 'fetched' order by page_id) as nth from f)
      select host, cast(page_id as varchar) as key, case when outcome = 'fetched' then 'cached' else outcome end as outcome, case when outcome = 'fetched' then n + 1 end as n_chars from g""",
}

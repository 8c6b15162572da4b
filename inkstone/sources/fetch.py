"""Polite fetching of pages: cached ones first, the others host by host with spacing, robots rules, retries and stops.

Hosts are dealt to tasks. A task takes its hosts' pages in turns, so that it asks one host while another's pause runs, and no host is ever asked from two
tasks. The transport is passed in, as is the clock; `fetch_all` works in rounds whose results are stored, so a lost executor costs a host one round's
requests at most.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.plans.kept import dropped, folder, kept

#: Least spacing of requests, spacing, retries, first and longest pause before a retry, the largest page, codes that end a host's crawl.
LEAST_DELAY, DELAY, RETRIES, FIRST_PAUSE, LONGEST_PAUSE, MOST_BYTES, FORBIDDEN = 1.0, 1.5, 3, 5.0, 120.0, 5_000_000, (401, 403)
#: Pages of a host in a round that follows shorter ones.
LONGEST_ROUND = 500
AGENT = "inkstone"
#: (status, content type, body) of a URL; a transport may raise OSError for what is no answer at all.
Transport = Callable[[str], tuple[int, str, bytes]]
LOG = "host string, key string, url string, outcome string, status int, attempts int, at double, why string, html string"


def over_http(url: str, timeout: int = 30) -> tuple[int, str, bytes]:
    """A GET request."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "ko,en;q=0.5"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read(MOST_BYTES + 1)
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", "") if e.headers else "", b""


class RealClock:
    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class CountedClock:
    """Time that passes by sleeping only, from 0 on: for plans and tests."""

    def __init__(self):
        self.seconds = 0.0

    def now(self) -> float:
        return self.seconds

    def sleep(self, seconds: float) -> None:
        self.seconds += seconds


@dataclass(frozen=True)
class Rules:
    """deadline: seconds after a host's first request beyond which no new page of it is asked for in a run."""

    delay: float = DELAY
    retries: int = RETRIES
    most_bytes: int = MOST_BYTES
    deadline: float | None = None

    def __post_init__(self) -> None:
        if self.delay < LEAST_DELAY:
            raise ValueError(f"delay must be at least {LEAST_DELAY} s")


class Host:
    """One host's crawl: its robots rules, when it may be asked again, and whether it ended."""

    def __init__(self, transport: Transport, rules: Rules, clock):
        self.transport, self.rules, self.clock = transport, rules, clock
        self.free = self.began = self.robots = None
        self.checked, self.stopped = False, ""

    def _ask(self, url: str) -> tuple[int, bytes]:
        if self.free is not None and self.free > self.clock.now():
            self.clock.sleep(self.free - self.clock.now())
        self.began = self.clock.now() if self.began is None else self.began
        try:
            status, _, body = self.transport(url)
            return status, body
        except OSError:
            return 0, b""
        finally:
            self.free = self.clock.now() + self.rules.delay

    def _check(self, url: str) -> None:
        """Robots rules, once: those of a file with directives hold, a forbidden or unreachable file ends the crawl, anything else allows all."""
        from urllib.robotparser import RobotFileParser

        self.checked = True
        status, body = self._ask("/".join(url.split("/", 3)[:3]) + "/robots.txt")
        said = body.decode("utf-8", "replace")
        if status in FORBIDDEN or status == 0:
            self.stopped = f"robots.txt: HTTP {status}" if status else "robots.txt: no answer"
        elif status == 200 and re.search(r"(?im)^\s*user-agent\s*:", said):
            self.robots = RobotFileParser()
            self.robots.parse(said.splitlines())

    def page(self, url: str) -> tuple[str, int | None, int, float | None, str, str | None]:
        """outcome (fetched, missing, too-large, stopped, deferred), last status, attempts, time of the first, why, page."""
        if not self.checked and not self.stopped:
            self._check(url)
        if self.robots is not None and not self.stopped and not self.robots.can_fetch(AGENT, url):
            self.stopped = "robots.txt disallows it"
        if self.stopped:
            return "stopped", None, 0, None, self.stopped, None
        if self.rules.deadline is not None and self.began is not None and self.clock.now() - self.began > self.rules.deadline:
            return "deferred", None, 0, None, "deadline", None
        pause, at, status, attempts = max(self.rules.delay, FIRST_PAUSE), None, 0, 0
        for attempts in range(1, self.rules.retries + 2):
            status, body = self._ask(url)
            at = self.clock.now() if at is None else at
            if status == 200 and body:
                if len(body) > self.rules.most_bytes:
                    return "too-large", status, attempts, at, f"over {self.rules.most_bytes} bytes", None
                return "fetched", status, attempts, at, "", body.decode("utf-8", "replace")
            if status == 404:
                return "missing", status, attempts, at, "HTTP 404", None
            if status in FORBIDDEN:
                break
            if attempts <= self.rules.retries:
                self.clock.sleep(pause)
                pause = min(2 * pause, LONGEST_PAUSE)
        self.stopped = f"HTTP {status}" if status else "no answer"
        return "stopped", status, attempts, at, self.stopped, None


def _fetcher(transport: Transport, rules: Rules, clock: Callable, flush: int = 8_000_000):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hosts: dict[str, Host] = {}
        names = ["host", "key", "url", "outcome", "status", "attempts", "at", "why", "html"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
        out, size = [], 0
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for host, key, url in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "url"))):
                if host not in hosts:
                    hosts[host] = Host(transport, rules, clock())
                row = (host, key, url, *hosts[host].page(url))
                out.append(row)
                size += len(row[-1] or "") + 200
                if size > flush:
                    yield made(out)
                    out, size = [], 0
        if out:
            yield made(out)

    return run


def _listed(wanted: DataFrame) -> DataFrame:
    """Pages (key, url[, pos]) with keys as text; their order is pos, or else key as it is given."""
    return wanted.select(F.col("key").cast("string").alias("key"), "url", F.col("pos" if "pos" in wanted.columns else "key").alias("pos"))


def _with_turns(wanted: DataFrame) -> DataFrame:
    """Pages with host and turn, their place among the host's pages."""
    rows = wanted.select("key", "url", "pos", F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("host"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("pos", "key")))


def fetched(wanted: DataFrame, cache: DataFrame | None, transport: Transport = over_http, rules: Rules = Rules(), clock: Callable = RealClock, offline: bool = False, tasks: int | None = None) -> DataFrame:
    """A row of LOG for each wanted page (key, url[, pos]): from the cache (key, html) where it has one, else asked for, in order of pos within its host.

    outcome: cached, fetched, missing (404), too-large, stopped (host forbids, robots rules disallow, or no answer after all retries; then for all further pages of
    the host, too), deferred (deadline), not-cached (offline), no-host (the URL names none). at: seconds of the host's clock when the page was first asked for.
    A host's pages go to one task in turn, since that is what spacing asks for; several hosts share a task. The result asks again whenever it is computed again:
    store it.
    """
    have = cache.select(F.col("key").cast("string").alias("key"), F.col("html").alias("_html")) if cache is not None else None
    wanted = _listed(wanted)
    rows = wanted if have is None else wanted.join(have.select("key"), "key", "left_anti")
    if offline:
        out = _unasked(rows, "not-cached")
    else:
        turns = _with_turns(rows.filter("try_parse_url(url, 'HOST') is not null")).repartition(tasks or wanted.sparkSession.sparkContext.defaultParallelism, "host").sortWithinPartitions("turn", "host")
        out = turns.select("host", "key", "url").mapInArrow(_fetcher(transport, rules, clock), LOG).unionByName(_nowhere(rows))
    if have is not None:
        out = out.unionByName(_unasked(wanted.join(have, "key"), "cached", F.col("_html")))
    return out


def _unasked(pages: DataFrame, outcome: str, html: Column | None = None) -> DataFrame:
    """Rows of LOG for pages that no host is asked for."""
    host = F.lower(F.expr("try_parse_url(url, 'HOST')"))
    return pages.select(host.alias("host"), F.col("key").cast("string").alias("key"), "url", F.lit(outcome).alias("outcome"), F.lit(None).cast("int").alias("status"),
                        F.lit(0).alias("attempts"), F.lit(None).cast("double").alias("at"), F.lit("").alias("why"), (F.lit(None) if html is None else html).cast("string").alias("html"))


def _nowhere(pages: DataFrame) -> DataFrame:
    return _unasked(pages.filter("try_parse_url(url, 'HOST') is null"), "no-host")


def _upto(k: int, per_round: int) -> int:
    """The last turn of round k: rounds double from per_round pages a host to LONGEST_ROUND."""
    upto, size = 0, per_round
    for _ in range(k + 1):
        upto, size = upto + size, max(size, min(2 * size, LONGEST_ROUND))
    return upto


def fetch_all(wanted: DataFrame, cache: str, per_round: int = 500, **options) -> DataFrame:
    """The log of a whole crawl into the cache folder (Parquet by round), which a later crawl takes up where this one ended.

    Every round asks for the next pages of each host that hasn't ended, per_round of them in the first one, then twice as many as before up to LONGEST_ROUND (or
    per_round, if that is more); its log is stored before the next one begins. So a host's first answers are stored soon, and a host of n pages takes about
    n / LONGEST_ROUND rounds, however small the first is.
    """
    spark = wanted.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    stored = spark.read.schema(LOG).parquet(cache).filter("outcome = 'fetched'").select("key", "html") if there else None
    todo = kept(_listed(wanted), "wanted")
    fresh = todo if stored is None else todo.join(stored.select("key"), "key", "left_anti")
    turns = left = kept(_with_turns(fresh.filter("try_parse_url(url, 'HOST') is not null")), "turns")
    path = f"{folder(spark)}/inkstone/fetch-log-{uuid.uuid4().hex}"
    _nowhere(fresh).write.parquet(path)
    k, last = 0, left.agg(F.max("turn")).first()[0] or 0
    while last:
        upto = _upto(k, per_round)
        log = kept(fetched(left.filter(F.col("turn") <= upto).select("key", "url", "pos"), None, **options), "fetch-round")
        log.filter("outcome = 'fetched'").write.mode("append").parquet(cache)
        log.write.mode("append").parquet(path)
        k += 1
        if last <= upto:
            dropped(log)
            break
        # only what is left travels on: rounds read neither the logs nor the pages of earlier ones
        ended = log.filter("outcome in ('stopped', 'deferred')").select("host").distinct()
        rest = kept(left.filter(F.col("turn") > upto).join(ended, "host", "left_anti").select(left.columns), "turns")
        last = rest.agg(F.max("turn")).first()[0] or 0
        dropped(log)
        if left is not turns:
            dropped(left)
        left = rest
    logs = spark.read.schema(LOG).parquet(path)
    ended = logs.filter("outcome in ('stopped', 'deferred')").groupBy("host").agg(F.min("outcome").alias("outcome"), F.min("why").alias("why"))
    none = lambda t: F.lit(None).cast(t)
    unasked = turns.join(logs.select("key"), "key", "left_anti").join(ended, "host").select("host", "key", "url", "outcome", none("int").alias("status"), F.lit(0).alias("attempts"), none("double").alias("at"), "why", none("string").alias("html"))
    out = logs.unionByName(unasked)
    if stored is not None:
        out = out.unionByName(_unasked(todo.join(stored, "key"), "cached", F.col("html")))
    return out

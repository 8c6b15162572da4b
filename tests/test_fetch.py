"""Polite fetching with a transport that notes what it is asked, and a clock that only counts."""

import pytest

from inkstone.sources.fetch import AGENT, CountedClock, Host, Rules, fetch_all, fetched


def crawl(answers, urls, **rules):
    clock, asked = CountedClock(), []

    def transport(url):
        asked.append((clock.now(), url))
        got = answers.get(url, (200, "", b"page"))
        got = got.pop(0) if isinstance(got, list) else got
        if got is None:
            raise OSError("no route")
        return got

    host = Host(transport, Rules(**rules), clock)
    return [host.page(u)[:3] for u in urls], asked


def test_spacing_and_order():
    out, asked = crawl({}, ["https://h/a", "https://h/b"], delay=2.0)
    assert [o[0] for o in out] == ["fetched"] * 2 and asked == [(0.0, "https://h/robots.txt"), (2.0, "https://h/a"), (4.0, "https://h/b")]
    with pytest.raises(ValueError):
        Rules(delay=0.5)


def test_retries_double_their_pauses_and_end_the_host():
    out, asked = crawl({"https://h/a": [None, (500, "", b""), (200, "", b"x")], "https://h/b": (503, "", b"")}, ["https://h/a", "https://h/b", "https://h/c"])
    assert out == [("fetched", 200, 3), ("stopped", 503, 4), ("stopped", None, 0)]
    assert [t for t, _ in asked] == [0, 1.5, 6.5, 16.5, 18, 23, 33, 53]


def test_robots_rules():
    rules = f"User-agent: {AGENT}\nDisallow: /no\n".encode()
    assert [o[0] for o in crawl({"https://h/robots.txt": (200, "", rules)}, ["https://h/yes", "https://h/no/1", "https://h/yes"])[0]] == ["fetched", "stopped", "stopped"]
    for answer, outcome in (((404, "", b""), "fetched"), ((500, "", b""), "fetched"), ((200, "text/html", b"<p>"), "fetched"), ((401, "", b""), "stopped"), ((403, "", b""), "stopped"), (None, "stopped")):
        assert crawl({"https://h/robots.txt": answer}, ["https://h/a"])[0][0][0] == outcome


def test_pages_that_cannot_be_had():
    answers = {"https://h/a": (404, "", b""), "https://h/b": (200, "", b"x" * 11), "https://h/c": (401, "", b"")}
    assert crawl(answers, ["https://h/a", "https://h/b", "https://h/c", "https://h/d"], most_bytes=10)[0] == [("missing", 404, 1), ("too-large", 200, 1), ("stopped", 401, 1), ("stopped", None, 0)]
    assert [o[0] for o in crawl({}, [f"https://h/{i}" for i in range(5)], deadline=3.1)[0]] == ["fetched"] * 3 + ["deferred"] * 2


def test_tables_of_pages(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.x/{i}") for i in range(12)] + [(20, "no address"), (21, None)]
    wanted, cache = spark.createDataFrame(rows, "key long, url string"), spark.createDataFrame([(4, "kept"), (99, "other")], "key long, html string")
    answer = lambda url: (404, "", b"") if url.endswith("/7") else (200, "", url.encode())
    got = {r.key: r for r in fetched(wanted, cache, answer, clock=CountedClock, tasks=2).collect()}
    assert len(got) == 14 and (got["4"].outcome, got["4"].html) == ("cached", "kept") and {got["20"].outcome, got["21"].outcome} == {"no-host"}
    assert got["7"].outcome == "missing" and got["8"].html == "https://h2.x/8" and got["10"].at == 4.5  # after robots.txt, 1 and 7
    assert {r.outcome for r in fetched(wanted, cache, answer, offline=True).collect()} == {"cached", "not-cached"}
    first = fetch_all(wanted.filter("key < 12"), f"{tmp_path}/cache", 2, transport=answer, clock=CountedClock)
    assert first.groupBy("outcome").count().collect() and first.count() == 12
    again = {r.key: r.outcome for r in fetch_all(wanted.filter("key < 12"), f"{tmp_path}/cache", transport=answer, clock=CountedClock).collect()}
    assert again.pop("7") == "missing" and set(again.values()) == {"cached"}
    none = spark.createDataFrame([], "key long, url string")
    assert fetched(none, None, answer, clock=CountedClock).count() == 0 and fetch_all(none, f"{tmp_path}/none", transport=answer).count() == 0


def test_queries_take_pages_of_any_number(spark, tmp_path):
    from inkstone.fetch_queries import fetch_resumed, polite_fetch

    rows = [(1, "https://hh.example/2000"), (2, "https://hh.example/150001"), (3, "https://hh.example/2009"), (4, "https://hh.example/9")]
    spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {"1": 2001, "2": 150002, "3": "too-large", "4": "too-large"}
    for query in (polite_fetch, fetch_resumed):
        assert {r.key: r.n_chars or r.outcome for r in query(spark, str(tmp_path)).collect()} == want


def test_rounds_grow_and_hosts_end(spark, tmp_path, monkeypatch):
    """A host of many pages takes few rounds however short the first is; a host that ended is not asked again."""
    from inkstone.sources import fetch

    rounds = []
    one = fetch.fetched
    monkeypatch.setattr(fetch, "fetched", lambda wanted, *a, **b: rounds.append(wanted.count()) or one(wanted, *a, **b))
    rows = [(i, f"https://long.x/{i}") for i in range(700)] + [(1000 + i, f"https://ends.x/{i}") for i in range(40)] + [(2000, "nowhere")]
    answer = lambda url: (403, "", b"") if url == "https://ends.x/4" else (200, "", url.encode())
    got = fetch.fetch_all(spark.createDataFrame(rows, "key long, url string"), f"{tmp_path}/cache", 3, transport=answer, clock=CountedClock)
    assert rounds == [6, 12, 12, 24, 48, 96, 192, 319]
    want = {str(k): "no-host" if k == 2000 else "stopped" if 1004 <= k < 1040 else "fetched" for k, _ in rows}
    assert got.count() == 741 and {r.key: r.outcome for r in got.select("key", "outcome").collect()} == want
    assert fetch._upto(9, 3) == 765 + 2 * 500 and fetch._upto(1, 1000) == 2000


def test_command_line(spark, tmp_path, capsys):
    from inkstone.__main__ import main

    spark.createDataFrame([(1, "https://h/1"), (2, "https://h/2")], "key long, url string").write.parquet(f"{tmp_path}/wanted")
    spark.createDataFrame([("h", "1", "https://h/1", "fetched", 200, 1, 1.5, "", "page")], "host string, key string, url string, outcome string, status int, attempts int, at double, why string, html string").write.parquet(f"{tmp_path}/cache")
    assert main(["fetch", f"{tmp_path}/wanted", "--cache", f"{tmp_path}/cache", "--offline"], spark) == {"cached": 1, "not-cached": 1}
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "halls and scholars"}\n{"id": "2", "text": "gauges"}')
    assert main(["append", f"{tmp_path}/a.jsonl", "--out", f"{tmp_path}/index"], spark)["appended"] == 2
    assert main(["merge", f"{tmp_path}/index"], spark)["articles"] == 2
    assert not main(["ask", f"{tmp_path}/index", "Which gauges?"], spark)["abstained"]

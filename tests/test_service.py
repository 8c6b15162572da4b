import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from inkstone.__main__ import main
from inkstone.chronicle_queries import echo
from inkstone.plans.index import Index
from inkstone.plans.models import Command, Endpoint, instructions, reasons, rewritten_by
from inkstone.service import Service, handler
from inkstone.sources.chronicle import article_pages, crawl_cache, sample_plan

ROWS = [{"id": "a-1", "title": "The hall", "date": "1420-05-12", "text": "Hall of scholars. The hall taught young scholars to read."}, {"id": "a-2", "title": "Letters", "date": "1446-09-29", "text": "A new script of letters was made."}]
PAGE = '<div class="detail-view"><div class="title-head"><p class="date">세종실록 8권, 세종 2년 5월 3일 갑자 1/2기사 / 1421년</p><h3>T</h3></div><div class="view-item left"><div class="view-text"><p class="paragraph">A <sup>1</sup>b</p></div></div></div>'


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("service")
    (home / "c.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    (home / "e.json").write_text(json.dumps({"script": {"aliases": ["new script"], "year": 1446, "month": 9, "details": ["letters"]}}))
    assert main(["build", str(home / "c.jsonl"), "--out", str(home / "i")], spark)["articles"] == 2
    return home


def test_ask(spark, built, capsys):
    got = main(["ask", str(built / "i"), "the new script", "--events", str(built / "e.json")], spark)
    assert not got["abstained"] and got["citations"][0]["id"] == "a-2" and got["trace"]["date_filter"]["source"] == "regenerated"
    command = """python -c 'import json,sys; print(json.dumps({"query": "hall", "answer": json.load(sys.stdin)["system_prompt"][:3] + " [a-1]"}))'"""
    got = main(["ask", str(built / "i"), "scholars", "--regenerator", "command", "--generator", "command", "--model-command", command], spark)
    assert got["trace"]["rewritten_query"] == "hall" and got["citations"] == ["a-1"] and got["unknown_citations"] == []


def test_service(spark, built):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Service(spark, Index.load(spark, str(built / "i")))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/"

    def post(**body):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + "ask", json.dumps(body).encode()), timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert json.load(urllib.request.urlopen(url + "corpus", timeout=60))["articles"] == 2
    assert post(query="")[0] == post(query="x", token_budget=1)[0] == post(query="x", rewrite="magic")[0] == post(query="x", generation="endpoint")[0] == 400
    status, got = post(query="How did the hall teach scholars?")
    assert status == 200 and got["citations"][0]["id"] == "a-1"
    server.shutdown()


def test_models(spark):
    assert reasons("x/o1") and not reasons("x/gpt") and reasons("gpt", "reasoning")
    for wrong in (lambda: reasons("x", "odd"), lambda: instructions("odd", "generation")):
        with pytest.raises(ValueError):
            wrong()
    q = spark.createDataFrame([("a", "the hall")], "qid string, original string")
    assert rewritten_by(Endpoint("https://model.invalid", "m", transport=echo), q).first().rewritten.startswith("INSUFFICIENT")
    assert rewritten_by(Command("cat /dev/null"), q).first().rewritten == "the hall"


def test_pages(spark):
    pages = spark.createDataFrame([("kda_10205003_001", PAGE), ("kda_10205003_002", "<p>x</p>"), ("odd", PAGE), ("kda_10205003_004", None)], "id string, html string")
    good, bad = article_pages(pages, "https://archive.invalid/", hanja=True)
    row = good.first()
    assert (row.text, row.date, row.volume, row.hanja_text) == ("A b", "1420-05-03", "세종실록 8권", "") and len(row.parse_warnings) == 1
    assert {r.id: r.error for r in bad.collect()} == {"kda_10205003_002": "no article block", "odd": "not an article id of the chronicle", "kda_10205003_004": "no article block"}
    index = spark.createDataFrame([("search('kda_102050', '3', '3')",)], "html string")
    days = spark.createDataFrame([("kda_102050", "".join(f"searchView('kda_10205003_00{i}')" for i in (1, 2, 3)))], "month_id string, html string")
    stored = spark.createDataFrame([], "id string")
    plan = sample_plan(max_articles=2)
    good, bad, summary = crawl_cache(index, days, pages, stored, "https://archive.invalid", **plan)
    told = {"months": 1, "skipped": 0, "written": 1, "failed": 2, "stopped": False, "month_ids": ["kda_102050"]}
    assert [r.id for r in good.collect()] == ["kda_10205003_001"] and summary.first().asDict() == told
    good, bad, summary = crawl_cache(index, days, pages, good.select("id"), "https://archive.invalid")
    assert summary.first().asDict() == told | {"skipped": 1, "written": 0}
    for wrong in ({"years": {1, 2}}, {"max_articles": 101}, {"delay": 1.0}):
        with pytest.raises(ValueError):
            sample_plan(**wrong)


def test_crawl_caps_months_and_repeated_pages(spark):
    """A failure uses up no place; a month without its page is a failure; several pages of one id make one article; a full cap stops."""
    ids = [f"kda_1020500{d}_001" for d in range(1, 7)]
    index = spark.createDataFrame([("search('kda_102050', '6', '3') search('kda_102060', '1', '3')",)], "html string")
    days = spark.createDataFrame([("kda_102050", "".join(f"searchView('{i}')" for i in ids))] * 2, "month_id string, html string")
    pages = spark.createDataFrame([(ids[0], "<p>x</p>"), *[(i, PAGE) for i in ids[1:]], (ids[1], PAGE)], "id string, html string")
    none = spark.createDataFrame([], "id string")
    good, bad, summary = crawl_cache(index, days, pages, none, "https://archive.invalid", max_articles=2)
    assert sorted(r.id for r in good.collect()) == ids[1:3]
    assert {r.id: r.error for r in bad.collect()} == {ids[0]: "no article block", "kda_102060": "month page not in the cache"}
    assert summary.first().asDict() == {"months": 2, "skipped": 0, "written": 2, "failed": 2, "stopped": True, "month_ids": ["kda_102050", "kda_102060"]}
    good, _, summary = crawl_cache(index, days, pages, spark.createDataFrame([(ids[1],), (ids[2],)], "id string"), "https://archive.invalid", max_total=3)
    assert [r.id for r in good.collect()] == [ids[3]] and summary.first().stopped


def test_import_of_pages(spark):
    from inkstone.sources.imports import import_pages

    rows = [("a", "https://h/x", "1420-05-29", "<title>T</title><main><p>" + "word " * 20 + "</p></main>", "", "v1"), ("b", "http://h/x", "1420-05-29", "", "", ""), ("c", "https://h/x", "1420-13-29", "", "", ""), (" ", "https://h/x", "1420-05-29", "", "", ""),
            ("d", "https://h/x", "1420-05-29", "x" * 2_000_001, "", ""), ("e", "https://h/x", "1420-05-29", "<p>short</p>", "", ""),
            ("f", "https://archive.invalid/id/kda_10205003_001", "1420-05-03", PAGE, "Given", ""), ("g", "https://archive.invalid/id/kda_10205003_002", "1420-05-03", PAGE.replace("A <sup>1</sup>b", ""), "", "")]
    good, bad = import_pages(spark.createDataFrame(rows, "id string, url string, date string, html string, title string, volume string"), "https://archive.invalid/")
    got = {r.id: r for r in good.collect()}
    assert set(got) == {"a", "f"} and (got["a"].title, got["a"].volume, got["a"].calendar) == ("T", "v1", "")
    assert (got["f"].title, got["f"].text, got["f"].calendar, got["f"].volume) == ("Given", "A b", "lunar", "세종실록 8권")
    assert {r.id: r.error for r in bad.collect()} == {"b": "source URL must use HTTPS", "c": "date must be ISO", " ": "article ID is required", "d": "page is too large", "e": "too little readable text", "g": "empty translation"}


def test_ingestion_stores_each_record_once(spark, tmp_path):
    from inkstone.streaming.ingest import ingest

    source = tmp_path / "in"
    source.mkdir()
    run = lambda checkpoint: ingest(spark, str(source), str(tmp_path / "corpus"), str(tmp_path / checkpoint)).awaitTermination()
    stored = lambda: sorted(r.id for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "corpus")).collect())
    (source / "1.json").write_text('{"id": "a", "text": "x"}\n{"id": "b", "text": "y"}\n{"id": "a", "text": "x"}')
    run("c1")
    (source / "2.json").write_text('{"id": "b", "text": "y"}\n{"id": "c", "text": "z"}')
    run("c1")
    assert stored() == ["a", "b", "c"]
    run("c2")  # a fresh checkpoint meets all files and the corpus
    assert stored() == ["a", "b", "c"]


def test_ingestion_in_batches_equals_one_run_and_reads_its_buckets(spark, tmp_path):
    from inkstone.streaming.ingest import BUCKETS, ids_of, ingest, stored_among

    rows = [{"id": f"r{i:03}", "text": f"text {i}"} for i in range(90)]
    held = lambda corpus: sorted(r.id for r in spark.read.parquet(corpus).select("id").collect())
    for name, parts in (("once", [rows]), ("thrice", [rows[:30] + rows[:3], rows[20:60], rows[10:]])):
        (tmp_path / name / "in").mkdir(parents=True)
        for k, part in enumerate(parts):
            (tmp_path / name / "in" / f"{k}.jsonl").write_text("\n".join(map(json.dumps, part)))
            ingest(spark, f"{tmp_path}/{name}/in", f"{tmp_path}/{name}/corpus", f"{tmp_path}/{name}/check", most=70).awaitTermination()
    assert held(f"{tmp_path}/once/corpus") == held(f"{tmp_path}/thrice/corpus") == [r["id"] for r in rows[:70]]
    corpus = f"{tmp_path}/thrice/corpus"
    some = stored_among(spark, corpus, [3, 5], 99)
    assert "bucket" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    ids = spark.read.parquet(ids_of(corpus))
    assert some.count() == ids.filter("bucket in (3, 5)").count() < ids.count() == 70 and ids.agg({"bucket": "max"}).first()[0] < BUCKETS


def test_vectors(spark):
    import base64

    import numpy as np

    from inkstone.plans.index import build, decoded, encoded
    from inkstone.plans.retrieve import retrieve

    x = np.array([[1, 0], [0.6, 0.8], [0, 1]], "<f4")
    got = decoded(spark.createDataFrame([("m", base64.b64encode(x.tobytes()).decode(), 2), ("empty", "", 2)], "key string, vectors_b64 string, dim int")).orderBy("pos").collect()
    assert np.allclose([r.vector for r in got], x) and {r.key for r in got} == {"m"}
    a = spark.createDataFrame([("a", "hall", "", 1420, 1, 1), ("b", "rain", "", 1430, 1, 1)], "id string, text string, title string, year int, month int, day int").selectExpr("*", "'' as calendar", "false as leap_month", "'' as source_url", "'' as date_original")
    kinds = lambda texts: [[2.0 * ("hall" in t), 1.0 * ("rain" in t)] for t in texts]
    index = build(encoded(a, kinds), backend="dense")
    q = spark.createDataFrame([("q1", "stones"), ("q2", "what in 1430")], "qid string, original string")
    v = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 0.5])], "qid string, vector array<double>")
    assert sorted((r.qid, r.id, r.similarity) for r in retrieve(index, q, vectors=v).evidence.collect()) == [("q1", "a", 1.0), ("q2", "b", 0.5)]


def test_choice_of_counter(spark, tmp_path):
    from inkstone.functions.tokens import counter

    assert counter("auto")[1] == counter("chars", "x")[1] == "conservative-char-v1"
    for wrong in (("tiktoken", None), ("odd", None)):
        with pytest.raises(ValueError):
            counter(*wrong)


def test_counter(spark, tmp_path):
    import base64

    from pyspark.sql import functions as F

    from inkstone.functions.tokens import ranks_cost

    words = [bytes([i]) for i in range(256)] + [b"ab"]
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    rows = spark.createDataFrame([(1, "abab c"), (2, ""), (3, None)], "k int, t string").select("k", ranks_cost(str(tmp_path / "r"))(F.col("t")).alias("n"))
    assert {r.k: r.n for r in rows.collect()} == {1: 4, 2: 1, 3: 1}

"""The whole way by command line: build, ask a good question, one about nothing, one with a wrong date; then serve the same index."""

import json
import threading
import urllib.request
from http.server import ThreadingHTTPServer

from inkstone.__main__ import main
from inkstone.functions import tokens
from inkstone.plans.index import Index
from inkstone.service import Service, handler

ROWS = [{"id": "h-1", "title": "The hall", "date": "1420-03-16", "text": "The king opened a hall for scholars. Young scholars read there by night."},
        {"id": "h-2", "title": "New letters", "date": "1446-09-29", "text": "Twenty-eight letters were made. The letters follow the sounds of speech."}]


def test_build_ask_serve(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    at = str(tmp_path / "index")
    assert main(["build", str(tmp_path / "c.jsonl"), "--out", at], spark)["articles"] == 2
    good = main(["ask", at, "Where did the scholars read?", "--out", str(tmp_path / "answer.json")], spark)
    assert not good["abstained"] and "[h-1]" in good["answer"] and json.loads((tmp_path / "answer.json").read_text())["answer"] == good["answer"]
    assert main(["ask", at, "Who flew the paper airship?"], spark)["abstain_reason"] == "no-evidence"
    wrong = main(["ask", at, "Which letters were made in 1431?"], spark)
    assert wrong["abstain_reason"] == "date-conflict" and "1446-09-29" in wrong["answer"]
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Service(spark, Index.load(spark, at))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/ask", json.dumps({"query": "Where did the scholars read?"}).encode())
        assert json.loads(urllib.request.urlopen(request).read())["answer"] == good["answer"]
    finally:
        server.shutdown()


def test_counts_by_ranks_are_the_encoder_s(spark):
    import base64

    import pytest
    import tiktoken
    from pyspark.sql import functions as F

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"It's {i} halls;  and\tscholars' 집현전 \n\n" * (i % 7) for i in range(600)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    spark.conf.set(tokens.SETTING, path)
    try:
        cost, label = tokens.counter("auto")
    finally:
        spark.conf.unset(tokens.SETTING)
    got = {r.k: r.n for r in rows.select("k", cost(F.col("t")).alias("n")).collect()}
    assert label == "tiktoken-ranks" and got == {k: max(1, len(whole.encode_ordinary(t or ""))) for k, t in enumerate(texts)}

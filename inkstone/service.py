"""The HTTP service: corpus figures and answers to posted questions, each a one-row plan over tables that stay loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans import answer
from inkstone.plans.index import Index
from inkstone.plans.models import Command, Endpoint, answered_by, rewritten_by
from inkstone.plans.retrieve import BUDGET, Retrieved, retrieve
from inkstone.plans.rewrite import EVENTS, rewritten

#: Bounds of a request.
MOST_BYTES, MOST_CHARACTERS, BUDGETS, REWRITES, GENERATIONS = 100_000, 1000, (50, 16000), ("rule", "none", "endpoint"), ("extractive", "endpoint")


class BadRequest(ValueError):
    """A request that the service does not take."""


def checked(body: bytes, has_model: bool = False) -> dict:
    """Fields of a request's body, or BadRequest."""
    if not 1 <= len(body) <= MOST_BYTES:
        raise BadRequest("invalid request size")
    try:
        said = json.loads(body)
        query, budget = str(said.get("query", "")).strip(), int(said.get("token_budget", BUDGET))
    except (ValueError, TypeError, AttributeError) as e:
        raise BadRequest(f"request must be a JSON object: {e}") from e
    if not 1 <= len(query) <= MOST_CHARACTERS:
        raise BadRequest(f"query must contain 1 to {MOST_CHARACTERS} characters")
    if not BUDGETS[0] <= budget <= BUDGETS[1]:
        raise BadRequest("token budget must be {} to {}".format(*BUDGETS))
    request = {"query": query, "token_budget": budget, "rewrite": said.get("rewrite", "rule"), "generation": said.get("generation", "extractive")}
    if request["rewrite"] not in REWRITES or request["generation"] not in GENERATIONS:
        raise BadRequest("unsupported rewrite or generation mode")
    if "endpoint" in (request["rewrite"], request["generation"]) and not has_model:
        raise BadRequest("no model is configured")
    return request


def verdicts(bodies: DataFrame, has_model: bool = False) -> DataFrame:
    """Requests (…, body) as a service would take them, with `error`: why not, empty if it does."""

    def why(body: str | None) -> str:
        try:
            checked((body or "").encode(), has_model)
        except BadRequest as e:
            return str(e)
        return ""

    @F.pandas_udf("string")
    def error(values: pd.Series) -> pd.Series:
        return values.map(why)

    return bodies.withColumn("error", error("body"))


@dataclass
class Service:
    spark: SparkSession
    index: Index
    events: DataFrame | None = None
    model: Endpoint | Command | None = None
    suggested: str = ""
    _sources: list = field(default_factory=list)

    def corpus(self, most_sources: int = 1000) -> dict:
        """Number of articles, backend, and the first sources by id."""
        a = self.index.articles
        shown = a.select("id", "title", F.col("source_url").alias("url")).orderBy("id").limit(most_sources)
        return {"articles": a.count(), "backend": self.index.backend, "sources": [r.asDict() for r in shown.collect()], "suggested_query": self.suggested}

    def checked(self, body: bytes) -> dict:
        """The request's fields, or BadRequest."""
        return checked(body, self.model is not None)

    def questions(self, query: str, budget: int, rewrite: str) -> DataFrame:
        q = self.spark.createDataFrame([("q", query)], "qid string, original string")
        if rewrite == "endpoint":
            q = rewritten_by(self.model, q)
        elif rewrite == "rule" and self.events is not None:
            q = rewritten(q, self.events)
        return q.withColumn("token_budget", F.lit(budget))

    def ask(self, request: dict, min_similarity: float | None = None, counter: tuple | None = None) -> dict:
        """Answer, citations, evidence and trace of one question."""
        q = self.questions(request["query"], request["token_budget"], request["rewrite"])
        found: Retrieved = retrieve(self.index, q, min_similarity=min_similarity, **({"counter": counter[0], "counter_label": counter[1]} if counter else {}))
        try:
            rows = answered_by(self.model, found, self.index.articles) if request["generation"] == "endpoint" else answer.answers(found, self.index.articles)
            out = rows.first().asDict(recursive=True)
            out["trace"] = found.trace.first().asDict(recursive=True) | {"evidence": [r.asDict() for r in found.evidence.orderBy("rank").collect()]}
            return out
        finally:
            found.release()


def events_table(spark: SparkSession, path: str) -> DataFrame:
    """The alias table of a JSON file {name: {year, month, day, aliases, details}}, in the file's order."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rows = []
    for pos, (name, e) in enumerate(json.loads(text).items()):
        number = [int(e[k]) if e.get(k) else None for k in ("year", "month", "day")]
        rows.append((pos, name, *number, [str(x) for x in e.get("aliases", [])], [str(x) for x in e.get("details", [])]))
    return spark.createDataFrame(rows, EVENTS)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """Routes: GET / (what there is), GET /api/corpus, POST /api/ask. Bad requests give 400, failures 502."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, value: dict, status: int = 200) -> None:
            data = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/":
                self._reply({"service": "inkstone", "routes": ["GET /api/corpus", "POST /api/ask"], "suggested_query": service.suggested})
            elif self.path == "/api/corpus":
                self._reply(service.corpus())
            else:
                self.send_error(404)

        def do_POST(self) -> None:
            if self.path != "/api/ask":
                self.send_error(404)
                return
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = self.rfile.read(size) if 1 <= size <= MOST_BYTES else b""
                self._reply(service.ask(service.checked(body)))
            except BadRequest as e:
                self._reply({"error": str(e)}, 400)
            except Exception as e:  # the reply must tell of any failure
                self._reply({"error": f"query failed: {e}"}, 502)

        def log_message(self, *args) -> None:
            pass

    return Handler

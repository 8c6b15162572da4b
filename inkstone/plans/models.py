"""Language models from outside: instructions, chat payloads, endpoint and command adapters over tables of questions.

The transport of an endpoint is a function that is passed in, so plans can be tested without a network; it must be picklable.
"""

from __future__ import annotations

import json
import os
import re
import shlex
import subprocess
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.plans.answer import MARKER, checked, grounding_prompts
from inkstone.plans.retrieve import Retrieved

STYLES = ("auto", "standard", "reasoning")
#: Seconds that a rewriting and an answer may take.
REWRITE_SECONDS, ANSWER_SECONDS = 60, 300

_RULES = (
    f"Use only the sources in the message and cite them as [id] after each statement. If they hold no record of what is asked, or give another date for it, begin with '{MARKER}' and say why, with the date "
    "that the records give. Dates follow the lunar calendar of the records. Invent no facts, dates or ids."
)
_SEARCH = "If the question has no date, append 'approximate date: YYYY' (or YYYY-MM, YYYY-MM-DD) where it is well established; keep a date that it has. Add nothing that you don't know. Return one line."
#: Instructions by profile: the written one for readers, the spoken one for an embodied agent.
PROFILES = {
    "journal": {
        "generation": f"Answer in the question's language under two headings, 'Objective facts:' and 'Contextual analysis:'. {_RULES}",
        "regeneration": f"Turn the question into a detailed search query over dated records: add names, terms and institutions of what it mentions. {_SEARCH}",
    },
    "ismar": {
        "generation": f"Answer aloud, in a few short sentences without lists or tables, under 'Objective facts:' and 'Contextual analysis:'. {_RULES}",
        "regeneration": f"Turn the spoken question into a clear search query over dated records. {_SEARCH}",
    },
}


def instructions(profile: str, task: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {sorted(PROFILES)}")
    return PROFILES[profile][task]


def reasons(model: str, style: str = "auto") -> bool:
    """Whether a model takes payloads of the reasoning kind; "auto" tells by the last part of its name, an o before a digit."""
    if style not in STYLES:
        raise ValueError(f"chat style must be one of {STYLES}")
    return style == "reasoning" if style != "auto" else re.match(r"o\d", model.split("/")[-1].lower()) is not None


def chat_payload(model: str, system: str, user: Column, style: str = "auto", most: int | None = None) -> Column:
    """JSON body of a chat completion for each row's text. Reasoning models take a developer message, no temperature and another name of the limit."""
    thinking = reasons(model, style)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    fields = [F.lit(model).alias("model"), F.array(message("developer" if thinking else "system", F.lit(system)), message("user", user)).alias("messages")]
    if not thinking:
        fields.append(F.lit(0).alias("temperature"))
    if most:
        fields.append(F.lit(most).alias("max_completion_tokens" if thinking else "max_tokens"))
    return F.to_json(F.struct(*fields))


def post(url: str, body: str, headers: dict[str, str], seconds: int) -> str:
    """The transport of production: an HTTP POST."""
    with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers), timeout=seconds) as reply:
        return reply.read().decode()


@dataclass(frozen=True)
class Endpoint:
    """A chat endpoint; key_name is the environment variable, on the executors, that holds the key."""

    base_url: str
    model: str
    key_name: str = ""
    profile: str = "journal"
    style: str = "auto"
    most: int | None = None
    transport: Callable[[str, str, dict[str, str], int], str] = post

    def complete(self, rows: DataFrame, task: str, text: str, seconds: int) -> DataFrame:
        """rows (qid, <text>) with column `output`; one request a row, as many at once as there are tasks."""
        url, key, send = self.base_url.rstrip("/") + "/chat/completions", self.key_name, self.transport

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            headers = {"Content-Type": "application/json"}
            if key and os.environ.get(key):
                headers["Authorization"] = f"Bearer {os.environ[key]}"
            for batch in batches:
                replies = [json.loads(send(url, body, headers, seconds)) for body in batch.column("body").to_pylist()]
                said = [(r["choices"][0]["message"]["content"] or "").strip() for r in replies]
                yield pa.RecordBatch.from_pydict({"qid": batch.column("qid"), "output": pa.array(said, pa.string())})

        body = chat_payload(self.model, instructions(self.profile, task), F.col(text), self.style, self.most)
        return rows.select("qid", body.alias("body")).mapInArrow(run, "qid string, output string")

    def describe(self) -> dict[str, str]:
        return {"generation": "endpoint-unverified", "prompt_profile": self.profile, "chat_style": "reasoning" if reasons(self.model, self.style) else "standard"}


@dataclass(frozen=True)
class Command:
    """A program on every executor that reads JSON from standard input and prints text, or JSON with the answer in one of `fields`."""

    command: str
    profile: str = "journal"

    def complete(self, rows: DataFrame, task: str, text: str, seconds: int) -> DataFrame:
        words = shlex.split(self.command)
        fields = ("query",) if task == "regeneration" else ("answer", "text")
        name = "query" if task == "regeneration" else "prompt"

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                said = []
                for body in batch.column("body").to_pylist():
                    printed = subprocess.run(words, input=body, text=True, capture_output=True, check=True, timeout=seconds).stdout
                    try:
                        parsed = json.loads(printed)
                    except json.JSONDecodeError:
                        parsed = None
                    known = [parsed[f] for f in fields if f in parsed] if isinstance(parsed, dict) else []
                    said.append(str(known[0] if known else printed if parsed is None or name == "query" else "").strip())
                yield pa.RecordBatch.from_pydict({"qid": batch.column("qid"), "output": pa.array(said, pa.string())})

        extra = [F.col(c) for c in ("query", "evidence") if c in rows.columns and c != name]
        body = F.to_json(F.struct(F.lit(instructions(self.profile, task)).alias("system_prompt"), F.col(text).alias(name), F.lit(self.profile).alias("profile"), *extra))
        return rows.select("qid", body.alias("body")).mapInArrow(run, "qid string, output string")

    def describe(self) -> dict[str, str]:
        return {"generation": "command-unverified", "prompt_profile": self.profile}


def rewritten_by(model: Endpoint | Command, questions: DataFrame) -> DataFrame:
    """questions (qid, original) with column rewritten; where a model returns nothing, the question stays as it is."""
    out = model.complete(questions.select("qid", "original"), "regeneration", "original", REWRITE_SECONDS)
    return questions.join(out, "qid", "left").withColumn("rewritten", F.coalesce(F.nullif("output", F.lit("")), "original")).drop("output")


def answered_by(model: Endpoint | Command, found: Retrieved, articles: DataFrame) -> DataFrame:
    """A model's answers from the evidence, with known and unknown citations, analysis and abstention; nothing verifies the text itself."""
    asked = grounding_prompts(found, articles).join(found.trace.select("qid", F.col("original_query").alias("query")), "qid")
    record = F.struct("rank", "id", "similarity", "rerank_score", "estimated_tokens", "outside_date_filter")
    asked = asked.join(found.evidence.groupBy("qid").agg(F.array_sort(F.collect_list(record)).alias("evidence")), "qid", "left")
    out = model.complete(asked, "generation", "prompt", ANSWER_SECONDS).withColumnRenamed("output", "text")
    rows = checked(out, found.evidence)
    return rows.select("*", *[F.lit(v).alias(k) for k, v in model.describe().items()])

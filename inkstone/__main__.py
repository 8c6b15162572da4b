"""Command line: python -m inkstone build | append | merge | import-html | fetch | crawl | ask | serve (also by spark-submit)."""

from __future__ import annotations

import argparse
import json
from http.server import ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstone.functions import tokens
from inkstone.plans import index as indexes
from inkstone.plans.models import PROFILES, STYLES, Command, Endpoint
from inkstone.plans.retrieve import BUDGET
from inkstone.plans import store
from inkstone.service import Service, events_table, handler
from inkstone.sources.articles import append_jsonl, expand_years, read_csv, read_jsonl
from inkstone.sources.chronicle import crawl_cache, sample_plan
from inkstone.sources.fetch import DELAY, LOG, Rules, fetch_all, fetched
from inkstone.sources.imports import import_pages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstone")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a corpus of JSON lines or CSV")
    b.add_argument("corpus")
    b.add_argument("--out", required=True)
    b = sub.add_parser("append", help="add the new articles of a corpus to an index; they are found after the next merge")
    b.add_argument("corpus")
    b.add_argument("--out", required=True)
    b = sub.add_parser("merge", help="make appended articles part of the index")
    b.add_argument("index")
    f = sub.add_parser("fetch", help="pages of a table (key, url) into a cache folder, politely; resumes where it ended")
    f.add_argument("wanted", help="Parquet")
    f.add_argument("--cache", required=True)
    f.add_argument("--delay", type=float, default=DELAY)
    f.add_argument("--offline", action="store_true", help="only say which pages the cache holds")
    f.add_argument("--log", help="also write the log of outcomes to this folder")
    i = sub.add_parser("import-html", help="append readable articles of a table of saved pages (id, url, date, html) to JSON lines")
    i.add_argument("pages", help="Parquet")
    i.add_argument("--out", required=True)
    i.add_argument("--chronicle-url", help="pages below this address are read as a chronicle's")
    c = sub.add_parser("crawl", help="articles of cached chronicle pages; resumes where the corpus ends")
    c.add_argument("--cache", required=True, help="Parquet folders index, days and pages")
    c.add_argument("--out", required=True)
    c.add_argument("--base-url", required=True)
    c.add_argument("--sample", action="store_true")
    c.add_argument("--years")
    c.add_argument("--month", type=int)
    c.add_argument("--leap", action="store_true")
    c.add_argument("--max-articles", type=int)
    c.add_argument("--include-hanja", action="store_true")
    for name in ("ask", "serve"):
        a = sub.add_parser(name)
        a.add_argument("index")
        if name == "ask":
            a.add_argument("query")
            a.add_argument("--token-budget", type=int, default=BUDGET)
            a.add_argument("--min-similarity", type=float)
            a.add_argument("--tokenizer", choices=tokens.NAMES, default="auto", help="how evidence is counted: by a rank file, by characters, or by the rank file if one is given")
            a.add_argument("--ranks", help="rank file of a byte-level tokenizer")
            a.add_argument("--out", help="also write the answer to this JSON file")
            a.add_argument("--regenerator", choices=["rule", "none", "endpoint", "command"], default="rule")
            a.add_argument("--generator", choices=["extractive", "endpoint", "command"], default="extractive")
            a.add_argument("--model-command")
        else:
            a.add_argument("--host", default="127.0.0.1")
            a.add_argument("--port", type=int, default=8765)
            a.add_argument("--question", default="")
        a.add_argument("--events")
        a.add_argument("--base-url", default="")
        a.add_argument("--model", default="")
        a.add_argument("--key-name", default="", help="environment variable that holds the endpoint's key")
        a.add_argument("--profile", choices=sorted(PROFILES), default="journal")
        a.add_argument("--chat-style", choices=STYLES, default="auto")
        a.add_argument("--max-output-tokens", type=int)
    return p


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def crawl(spark: SparkSession, args: argparse.Namespace) -> dict:
    years = {r.year for r in expand_years(spark.createDataFrame([(args.years,)], "spec string")).collect()} if args.years else None
    plan = {"years": years, "month": args.month, "leap": args.leap, "max_articles": args.max_articles}
    if args.sample:
        plan = sample_plan(**plan)
    stored = spark.read.json(args.out, schema="id string") if _exists(spark, args.out) else spark.createDataFrame([], "id string")
    read = lambda name: spark.read.parquet(f"{args.cache}/{name}")
    good, failures, summary = crawl_cache(read("index"), read("days"), read("pages"), stored, args.base_url, hanja=args.include_hanja, **plan)
    told = summary.first().asDict()
    failures.write.mode("overwrite").json(f"{args.cache}/failures")
    append_jsonl(good, args.out)
    return told


def fetch(spark: SparkSession, args: argparse.Namespace) -> dict:
    wanted, rules = spark.read.parquet(args.wanted), Rules(delay=args.delay)
    if args.offline:
        cache = spark.read.schema(LOG).parquet(args.cache).select("key", "html") if _exists(spark, args.cache) else None
        log = fetched(wanted, cache, offline=True)
    else:
        log = fetch_all(wanted, args.cache, rules=rules)
    if args.log:
        log.drop("html").write.mode("overwrite").parquet(args.log)
    return {r.outcome: r["count"] for r in log.groupBy("outcome").count().collect()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("inkstone").getOrCreate()
    if args.command == "build":
        rows = (read_csv if args.corpus.lower().endswith(".csv") else read_jsonl)(spark, args.corpus)
        indexes.build(rows).save(args.out)
        told = {"articles": rows.count(), "backend": "tfidf", "out": args.out}
    elif args.command == "append":
        rows = (read_csv if args.corpus.lower().endswith(".csv") else read_jsonl)(spark, args.corpus)
        told = {"appended": store.append(rows, args.out), "out": args.out}
    elif args.command == "merge":
        told = {"articles": store.merge(spark, args.index).articles.count(), "index": args.index}
    elif args.command == "fetch":
        told = fetch(spark, args)
    elif args.command == "import-html":
        good, bad = import_pages(spark.read.parquet(args.pages), args.chronicle_url)
        append_jsonl(good, args.out)
        told = {"imported": good.count(), "rejected": [r.asDict() for r in bad.orderBy("id").limit(100).collect()], "out": args.out}
    elif args.command == "crawl":
        told = crawl(spark, args)
    else:
        service = Service(spark, indexes.Index.load(spark, args.index), events_table(spark, args.events) if args.events else None)
        if args.base_url and args.model:
            service.model = Endpoint(args.base_url, args.model, args.key_name, args.profile, args.chat_style, args.max_output_tokens)
        if args.command == "serve":
            service.suggested = args.question
            ThreadingHTTPServer((args.host, args.port), handler(service)).serve_forever()
            return None
        modes = {args.regenerator, args.generator}
        if "command" in modes:
            if not args.model_command or "endpoint" in modes:
                raise SystemExit("command modes need --model-command, and cannot be mixed with endpoint modes")
            service.model = Command(args.model_command, args.profile)
        elif "endpoint" in modes and service.model is None:
            raise SystemExit("endpoint modes need --base-url and --model")
        outside = lambda mode: "endpoint" if mode == "command" else mode
        told = service.ask({"query": args.query, "token_budget": args.token_budget, "rewrite": outside(args.regenerator), "generation": outside(args.generator)},
                           min_similarity=args.min_similarity, counter=tokens.counter(args.tokenizer, args.ranks))
    shown = json.dumps(told, ensure_ascii=False, indent=2, default=str)
    if getattr(args, "command", "") == "ask" and args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(shown)
    print(shown)
    return told


if __name__ == "__main__":
    main()

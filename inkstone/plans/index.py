"""The explainable TF-IDF index: postings, inverse document frequencies and title terms as tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.functions.text import HANGUL, LATIN, RUNS, STOPWORDS, bigrams, date_label, legacy_tokenize, token_cost, tokenize
from inkstone.plans.kept import dropped, freed, kept, kept_rounds

TOKENIZERS = {"korean-char-bigram-v1": tokenize, "legacy-word": legacy_tokenize}


def term_rows(rows: DataFrame, text: Column, tokenizer: str = "korean-char-bigram-v1") -> DataFrame:
    """A row for each token of a text, with the other columns: what the tokenizers give, but with stop words dropped by a filter over exploded runs."""
    others = rows.columns
    if tokenizer != "korean-char-bigram-v1":
        return rows.select(*others, F.explode(TOKENIZERS[tokenizer](text)).alias("term"))
    runs = rows.select(*others, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), F.lit(0))).alias("_run"))
    latin, low = F.col("_run") < "\u0080", F.lower("_run")
    runs = runs.filter(~latin | ((F.length("_run") > 1) & ~low.isin(*STOPWORDS)))
    return runs.select(*others, F.explode(F.when(latin, F.array(low)).otherwise(bigrams(F.col("_run")))).alias("term"))


_RUN, _WORD, _STOP = re.compile(RUNS), re.compile(f"[{LATIN}{HANGUL}]+"), frozenset(STOPWORDS)


def counted(text: str, tokenizer: str = "korean-char-bigram-v1") -> Counter:
    """How often a text holds each of its tokens, by the rules of the tokenizers; runs are counted first, then cut."""
    out: Counter = Counter()
    if tokenizer == "legacy-word":
        for word, n in Counter(_WORD.findall(text)).items():
            if len(word) > 1:
                out[word.lower()] += n
        return out
    for run, n in Counter(_RUN.findall(text)).items():
        if run < "\u0080":
            low = run.lower()
            if len(run) > 1 and low not in _STOP:
                out[low] += n
        else:
            for k in range(max(1, len(run) - 1)):
                out[run[k : k + 2]] += n
    return out


def _counted(batches: Iterator, tokenizer: str) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def rows(batch, at, counts):
        nth = np.repeat(np.array(at, np.int64), [len(c) for c in counts])
        terms = pa.array([t for c in counts for t in c], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(nth)), terms, pa.array([n for c in counts for n in c.values()], pa.int64())], ["id", "term", "tf"])

    for batch in batches:
        at, counts, size = [], [], 0
        for i, said in enumerate(batch.column("_said")):
            at.append(i)
            counts.append(counted(said.as_py(), tokenizer))
            size += len(counts[-1])
            if size > 200_000:
                yield rows(batch, at, counts)
                at, counts, size = [], [], 0
        if at:
            yield rows(batch, at, counts)


def term_counts(articles: DataFrame, tokenizer: str = "korean-char-bigram-v1") -> DataFrame:
    """id, term, tf over title and text.

    An article is counted where it is, without a shuffle of its words; only where rows share an id are counts added up.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    kind = articles.schema["id"].dataType.simpleString()
    found = articles.select("id", text.alias("_said")).mapInArrow(partial(_counted, tokenizer=tokenizer), f"id {kind}, term string, tf long")
    if articles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return found
    return found.groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def inverse_frequencies(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """term, df, idf; the number of articles includes those without tokens."""
    n = articles.agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def idf_of(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


#: A term that holds more than one of so many postings is common; there are at most so many common terms, which are sent to all tasks.
COMMON = 200_000
#: Postings of a term and a kind of articles that are one slice, give or take.
SLICE = 100_000
#: Kinds of articles halve their largest weight every KINDS steps.
KINDS = 2
POSTINGS = ["id", "term", "weight", "kind", "slice"]


def with_frequencies(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """counts (id, term, tf) with df and idf. Common terms meet theirs where they are, so no key of the shuffle holds more than a small share of the rows."""
    total = idf.agg(F.sum("df")).first()[0] or 0
    common = idf.filter(F.col("df") * COMMON > total).select("term", "df", "idf")
    met = counts.join(F.broadcast(common), "term", "left")
    rare = met.filter("df is null").select("id", "term", "tf").join(idf.select("term", "df", "idf"), "term")
    return met.filter("df is not null").select("id", "term", "tf", "df", "idf").unionByName(rare.select("id", "term", "tf", "df", "idf"))


def weigh(counts: DataFrame, idf: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """id, term, weight, kind, slice. weight: tf * idf to six places, divided by the article's norm, to six places again.

    kind says how large the article's largest weight is; all postings of one term and kind have a bound in common (directory). Terms of many articles are cut
    into slices by a hash of the article, so that (term, kind, slice) is a key of about slice_rows rows at most.
    """
    raw = with_frequencies(counts, idf).select("id", "term", slices_of(F.col("df"), slice_rows).alias("slices"), F.round(F.col("tf") * F.col("idf"), 6).alias("w"))
    own = Window.partitionBy("id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))
    raw = raw.select("*", F.when(norm == 0, 1.0).otherwise(norm).alias("norm"), F.max("w").over(own).alias("top"))
    weight = lambda w: F.round(F.col(w) / F.col("norm"), 6)
    most = weight("top")  # the largest weight, as rounding keeps the order
    kind = F.when(most > 0, F.greatest(F.lit(0), F.floor(-KINDS * F.log2(most)))).otherwise(0).cast("int")
    return raw.select("id", "term", weight("w").alias("weight"), kind.alias("kind"), _slice(F.col("id"), F.col("slices")).alias("slice"))


#: Postings are weighed in rounds of about so many, ROUNDS at most, by a hash of the article, so that shuffle files take a bounded share of the index's own size.
ROUND_ROWS, ROUNDS = 2_000_000, 8


def weighed_rounds(counts: DataFrame, idf: DataFrame, slice_rows: int = SLICE) -> Iterator[DataFrame]:
    """The rows of weigh, in rounds that each hold whole articles."""
    total = idf.agg(F.sum("df")).first()[0] or 0
    rounds = min(ROUNDS, 1 + total // ROUND_ROWS)
    for k in range(rounds):
        yield weigh(counts if rounds == 1 else counts.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k), idf, slice_rows)


def slices_of(df: Column, slice_rows: int = SLICE) -> Column:
    return F.ceil(df / slice_rows).cast("int")


def _slice(id_: Column, slices: Column) -> Column:
    return F.pmod(F.xxhash64(id_), slices).cast("int")


def directory(postings: DataFrame, idf: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """term, kind, n, most, slices: how many postings a term has among the articles of a kind, the largest of their weights, and their slices."""
    parts = postings.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"))
    return parts.join(idf.select("term", slices_of(F.col("df"), slice_rows).alias("slices")), "term")


def headers(articles: DataFrame, tokenizer: str = "korean-char-bigram-v1", counter: Callable[[Column], Column] = token_cost) -> DataFrame:
    """What ranking and packing need of an article, without its text: id, year, month, day, cost, date (its label), title, title_tokens."""
    said = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    label = date_label(F.col("year"), F.col("month"), F.col("day"), F.col("calendar"), F.col("leap_month"))
    return articles.select("id", "year", "month", "day", counter(said).alias("cost"), label.alias("date"), "title", F.array_distinct(TOKENIZERS[tokenizer](F.col("title"))).alias("title_tokens"))


@dataclass
class Index:
    """Tables of an index; dense indexes have articles with a column `vector` instead of idf, postings and parts."""

    articles: DataFrame
    idf: DataFrame | None
    postings: DataFrame | None
    title_terms: DataFrame
    tokenizer: str = "korean-char-bigram-v1"
    backend: str = "tfidf"
    parts: DataFrame | None = None
    heads: DataFrame | None = None

    def tokens(self, text: Column) -> Column:
        return TOKENIZERS[self.tokenizer](text)

    def tables(self) -> dict[str, DataFrame]:
        found = {"articles": self.articles, "title_terms": self.title_terms, "idf": self.idf, "postings": self.postings, "parts": self.parts, "heads": self.heads}
        return {name: df for name, df in found.items() if df is not None}

    def save(self, path: str) -> None:
        """The index as the store's newest generation; who reads meanwhile sees the one before it."""
        from inkstone.plans.store import save

        save(self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        from inkstone.plans.store import load

        return load(spark, path)


def encoded(articles: DataFrame, encoder: Callable[[list[str]], object]) -> DataFrame:
    """Articles with column `vector`: what the encoder (a function from texts to rows of numbers) gives for title and text, brought to length one.

    The encoder travels to the executors; a model that it loads should be kept in a variable of its module.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in articles.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            said = [f"{t or ''}\n{x or ''}" for t, x in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist())]
            rows = np.asarray(encoder(said), np.float32).reshape(len(said), -1) if said else np.zeros((0, 1), np.float32)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = rows / np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    return articles.mapInArrow(run, f"{schema}, vector array<float>")


def decoded(matrices: DataFrame) -> DataFrame:
    """(key, pos, vector) of stored matrices (key, vectors_b64, dim): rows of little-endian 32-bit floats, as base64 text."""

    def run(batches: Iterator) -> Iterator:
        import base64

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key, text, dim in zip(*(batch.column(c).to_pylist() for c in ("key", "vectors_b64", "dim"))):
                rows = np.frombuffer(base64.b64decode(text or ""), "<f4").reshape(-1, dim)
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(rows), pa.string()), "pos": pa.array(np.arange(len(rows))), "vector": pa.array(list(rows), pa.list_(pa.float32()))})

    return matrices.select(F.col("key").cast("string").alias("key"), "vectors_b64", "dim").mapInArrow(run, "key string, pos long, vector array<float>")


def build(articles: DataFrame, tokenizer: str = "korean-char-bigram-v1", backend: str = "tfidf") -> Index:
    """Index over articles (id, text, title, …). backend "dense" expects a column vector of array<float>."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer must be one of {sorted(TOKENIZERS)}")
    if backend not in ("tfidf", "dense"):
        raise ValueError("backend must be tfidf or dense")
    titles = articles.select("id", F.explode(F.array_distinct(TOKENIZERS[tokenizer](F.col("title")))).alias("term"))
    if backend == "dense":
        if "vector" not in articles.columns:
            raise ValueError("a dense index needs articles with a vector")
        return Index(articles, None, None, titles, tokenizer, backend, None, kept(headers(articles, tokenizer), "heads"))
    # counts are read twice, so they are written once
    counts = kept(term_counts(articles, tokenizer), "term-counts")
    index = of_counts(articles, counts, titles, tokenizer)
    dropped(counts)
    return index


def of_counts(articles: DataFrame, counts: DataFrame, titles: DataFrame, tokenizer: str, idf: DataFrame | None = None, heads: DataFrame | None = None) -> Index:
    """The index of articles whose term counts are at hand."""
    spark = articles.sparkSession
    idf = kept(inverse_frequencies(counts, articles), "idf") if idf is None else idf
    freed(spark)
    postings = kept_rounds(spark, weighed_rounds(counts, idf), "postings")
    parts = kept(directory(postings, idf), "parts")
    freed(spark)
    return Index(articles, idf, postings, titles, tokenizer, "tfidf", parts, kept(headers(articles, tokenizer), "heads") if heads is None else heads)

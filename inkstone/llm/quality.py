"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, keep, slices, words_of

SYMBOLS = "#*$%&|<>"
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _repeat_words(words: list[bytes]) -> int:
    """Word positions that lie in a 3-word window whose words occur twice or more in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    windows, at, times = np.unique(pairs[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    if len(windows) == len(at):
        return 0
    again = times[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[j : j + len(again)] |= again
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            if line.strip(" \t\n\x0b\x0c\r"):
                lines += 1
                duplicates += 1
        else:
            seen.add(line)
            lines += bool(line.strip(" \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, _repeat_words(words), lines


def measure_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in slices(batches, "text"):
        rows = list(map(_measure, batch.column("text").to_pylist()))
        columns = {k: pa.array(x, pa.int64()) for k, x in zip(names, zip(*rows))}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns, "lang": batch.column("lang"), "source": batch.column("source")})


def measure(docs: DataFrame) -> DataFrame:
    """One row of counts per document; null or empty text counts nothing."""
    frame = docs.select("doc_id", "text", "lang", "source")
    return frame.mapInArrow(measure_batches, f"{FEATURES}, lang string, source string")


#: metric -> (SQL expression, least spread, whether it is judged on both sides of the median)
METRICS = {
    "word_length": ("word_chars / n_words", 0.15, True),
    "symbol_share": ("n_symbols / n_words", 0.1, False),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.2, False),
    "repeat_share": ("n_repeat_words / n_words", 0.1, False),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: Quantiles (in thousandths) between which a gap is looked for, and how many times larger the upper one must be.
LADDER, GAP = (800, 850, 900, 950, 975, 990), 3
#: Documents that the wider sketch counts for, in parts of a document.
WEIGHT, PARTS = 100, 10_000
_ZEROS = -(2**31)


def sketch(features: DataFrame, growth: float = 1.01) -> DataFrame:
    """Mergeable quantile sketches: counts in geometric buckets, one sketch per language, source and metric.

    Two sketches merge by adding counts, so partial sums combine on the map side, the
    result does not depend on the order of rows, and a quantile is off by half a
    bucket (0.5 %) at most. Bucket -2147483648 holds the zeros.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("x")) for m, (e, _, _) in METRICS.items()])
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.log(F.col("m.x")) / float(np.log(growth))).cast("int")).otherwise(F.lit(_ZEROS))
    rows = features.filter(f"not ({BASE_FAILED})").select("lang", "source", F.explode(values).alias("m"))
    return rows.select("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _shrunk(sketches: DataFrame, by: list[str], wider: DataFrame, on: list[str]) -> DataFrame:
    """Each group's counts, plus the wider group's scaled to WEIGHT documents; integers in parts of a document, so that sums are exact."""
    total = wider.groupBy(*on, "metric").agg(F.sum("n").alias("all"))
    w, t, g = wider.alias("w"), total.alias("t"), sketches.select(*by, "metric").distinct().alias("g")
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in [*on, "metric"]]
    prior = w.join(t, _all(same("w", "t"))).select(*[f"w.{c}" for c in on], "w.metric", "bucket", F.expr(f"({WEIGHT * PARTS} * n) div all").alias("n")).alias("w")
    prior = g.join(prior, _all(same("g", "w"))).select(*[F.col(f"g.{c}") for c in by], "g.metric", "bucket", "n")
    own = sketches.select(*by, "metric", "bucket", (F.col("n") * PARTS).alias("n"))
    return own.unionByName(prior).groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def thresholds(sketches: DataFrame, reach: float = 8.0, growth: float = 1.01) -> DataFrame:
    """Lower and upper limits per language and source, from the sketches' quantiles.

    Sketches merge upwards: a language's sketch gets the whole corpus's, scaled to WEIGHT documents, and a source's gets that of its language, so
    small groups lean on the wider ones and large ones speak for themselves, without a size at which the rule changes.

    Word length: median -+ reach * max(median - 10 % quantile, least spread); the spread is taken below the median, where junk does not reach.
    Shares: up the ladder of upper quantiles, the first gap, a step to GAP times the value or more (both moved up by the least spread), parts
    junk from text, and the limit is the middle of the gap on a logarithmic scale. Without a gap it lies as far above the 99 % quantile as that lies above the median.
    """
    every = sketches.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    langs = _shrunk(sketches.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["lang"], every, [])
    merged = _shrunk(sketches, ["lang", "source"], langs, ["lang"])
    by = Window.partitionBy("lang", "source", "metric")
    run = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    value = F.when(F.col("bucket") == _ZEROS, F.lit(0.0)).otherwise(2 * F.pow(F.lit(growth), F.col("bucket").cast("double")) / (1 + growth))
    quantile = lambda q: F.min(F.when(F.col("upto") * 1000 >= q * F.col("all"), value)).alias(f"q{q}")
    q = run.groupBy("lang", "source", "metric").agg(*map(quantile, (100, 500, *LADDER)))
    least = F.create_map(*[F.lit(x) for m, (_, s, _) in METRICS.items() for x in (m, s)])[F.col("metric")]
    both = F.create_map(*[F.lit(x) for m, (_, _, b) in METRICS.items() for x in (m, b)])[F.col("metric")]
    reach_of = reach * F.greatest(F.col("q500") - F.col("q100"), least)
    top = F.col(f"q{LADDER[-1]}")
    share = top + F.greatest(top - F.col("q500"), least)
    for low, high in reversed(list(zip(LADDER, LADDER[1:]))):
        x, y = F.col(f"q{low}") + least, F.col(f"q{high}") + least
        share = F.when(y >= GAP * x, F.sqrt(x * y) - least).otherwise(share)
    q = q.select("lang", "source", "metric", F.when(both, F.col("q500") + reach_of).otherwise(share).alias("hi"), F.when(both, F.col("q500") - reach_of).otherwise(F.lit(-1.0)).alias("lo"))
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("lo", "hi")])


def judge(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Joined filtering: every document against the limits of its language and source."""
    f, t = features.alias("f"), limits.alias("t")
    on = F.col("f.lang").eqNullSafe(F.col("t.lang")) & F.col("f.source").eqNullSafe(F.col("t.source"))
    inside = F.lit(True)
    for m, (e, _, _) in METRICS.items():
        inside = inside & F.expr(e).between(F.col(f"t.{m}_lo"), F.col(f"t.{m}_hi"))
    failed = F.expr(BASE_FAILED)
    return f.join(t, on, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def quality_rules(docs: DataFrame, reach: float = 8.0) -> DataFrame:
    """Verdict on every document of (doc_id, text, lang, source); other columns are ignored.

    Null or empty texts have no words and fail the base rule. Null languages and sources
    form groups of their own. Repeated rows each get a verdict. An empty table gives no rows.
    """
    features = keep(measure(docs), "quality")
    return judge(features, thresholds(sketch(features), reach))


def keep_good(docs: DataFrame, reach: float = 8.0) -> DataFrame:
    """The documents that pass, with all their columns; every row by its own text, also where it has no id or shares one.

    Verdicts meet their rows by a 64-bit hash of all they were made from, so repeated rows share one.
    """
    key = F.xxhash64("doc_id", "text", "lang", "source")
    verdict = quality_rules(docs.select(key.alias("doc_id"), "text", "lang", "source"), reach)
    gone = verdict.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, key == gone["_gone"], "left_anti")


_STACKED = " union all ".join(f"select lang, source, '{m}' as metric, {e} as x from f where not failed" for m, (e, _, _) in METRICS.items())
_LEAST = " ".join(f"when '{m}' then {s}" for m, (_, s, _) in METRICS.items())
_TWO_SIDED = ", ".join(f"'{m}'" for m, (_, _, b) in METRICS.items() if b)
_LIMITS = ", ".join(f"max(case when metric = '{m}' then {c} end) as {m}_{c}" for m in METRICS for c in ("lo", "hi"))
_LADDER = ", ".join(f"min(case when upto * 1000 >= {q} * total then val end) as q{q}" for q in (100, 500, *LADDER))
_GAPS = " ".join(f"when q{y} + least >= {GAP} * (q{x} + least) then sqrt((q{x} + least) * (q{y} + least)) - least" for x, y in zip(LADDER, LADDER[1:]))
_INSIDE = " and ".join(f"{e} between {m}_lo and {m}_hi" for m, (e, _, _) in METRICS.items())
#: The same as SQL.
ORACLE = f"""with d as (select row_number() over () as row, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') as w from documents),
p as (select row, generate_subscripts(w, 1) as i, unnest(w) as x from d), g as (select row, i, x, lead(x, 1) over o as y, lead(x, 2) over o as z from p window o as (partition by row order by i)),
again as (select row, i from g where z is not null qualify count(*) over (partition by row, x, y, z) > 1), cover as (select row, count(distinct i + j) as n from again, range(3) k(j) group by row),
l as (select row, unnest(string_split(text, chr(10))) as line from d), ln as (select row, count(*) as n, count(distinct line) as u from l where regexp_matches(line, '{WORD_PATTERN}') group by row),
m as (select row, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols, coalesce(ln.n - ln.u, 0) as n_dup_lines, coalesce(ln.n, 0) as n_lines, coalesce(cover.n, 0) as n_repeat_words
  from d left join cover using (row) left join ln using (row)),
f as (select *, {BASE_FAILED} as failed from m), x as ({_STACKED}),
b as (select lang, source, metric, case when x > 0 then cast(ceil(ln(x) / ln(1.01)) as bigint) else {_ZEROS} end as bucket, count(*) as n from x group by all),
e as (select metric, bucket, sum(n) as n, sum(sum(n)) over (partition by metric) as total from b group by metric, bucket),
lb as (select lang, metric, bucket, sum(n) as n from b group by all),
lw as (select lang, metric, bucket, n * {PARTS} as n from lb union all select g.lang, e.metric, e.bucket, ({WEIGHT * PARTS} * e.n) // e.total from (select distinct lang, metric from lb) g join e using (metric)),
lm as (select lang, metric, bucket, sum(n) as n, sum(sum(n)) over (partition by lang, metric) as total from lw group by lang, metric, bucket),
gw as (select lang, source, metric, bucket, n * {PARTS} as n from b union all
  select g.lang, g.source, m.metric, m.bucket, ({WEIGHT * PARTS} * m.n) // m.total from (select distinct lang, source, metric from b) g join lm m on g.lang is not distinct from m.lang and g.metric = m.metric),
v as (select lang, source, metric, bucket, sum(n) as n from gw group by all),
s as (select *, case when bucket = {_ZEROS} then 0.0 else 2 * pow(1.01, bucket) / 2.01 end as val, sum(n) over (partition by lang, source, metric order by bucket) as upto, sum(n) over (partition by lang, source, metric) as total from v),
q as (select lang, source, metric, case metric {_LEAST} end as least, {_LADDER} from s group by all),
h as (select lang, source, metric, case when metric in ({_TWO_SIDED}) then q500 + 8 * greatest(q500 - q100, least) else case {_GAPS} else q990 + greatest(q990 - q500, least) end end as hi,
  case when metric in ({_TWO_SIDED}) then q500 - 8 * greatest(q500 - q100, least) else -1.0 end as lo from q),
t as (select lang, source, {_LIMITS} from h group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, case when failed then false else coalesce({_INSIDE}, true) end as kept
from f left join t on f.lang is not distinct from t.lang and f.source is not distinct from t.source"""

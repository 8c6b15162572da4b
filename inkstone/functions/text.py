"""Scalar text functions as Columns: tokens, costs, sentences, labels, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Script classes, stop words and question words of the retrieval vocabulary.
HANGUL, HANJA, LATIN = "가-힣", "㐀-䶿一-鿿豈-﫿", "0-9A-Za-z"
STOPWORDS = (
    "a an the of and or in on at to for from by with as is are was were be been being it its this that these those what which who whom whose when "
    "where why how did does do done me tell about please describe explain there their they them he she his her i you we us our your can could would "
    "should will related approximate approximately date"
).split()
QUESTION_WORDS = STOPWORDS + (
    "happened happen event events record records occurred occur anything something day year month historical context details during dated circa ca "
    "since until till before after around between 무엇 무슨 어떤 일 일이 일은 있었나 있었나요 있었는가 있었는지 있었니 일어났나 일어났나요 일어난 알려줘 "
    "알려주세요 기록 기록은 날 그날 당시 때 에 에서 에는 의 은 는 이 가 을 를 와 과 도 로 으로"
).split()
RUNS = f"[{HANGUL}]+|[{HANJA}]+|[{LATIN}]+"


def _listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a single character stands alone."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))


def tokenize(text: Column) -> Column:
    """Lexical tokens in order: lower-cased Latin words of two letters or more that are no stop words, and bigrams of Hangul or Hanja runs."""
    stop = _listed(STOPWORDS)

    def of_run(run: Column) -> Column:
        low = F.lower(run)
        latin = F.when((F.length(run) > 1) & ~F.array_contains(stop, low), F.array(low)).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(run.rlike(f"^[{LATIN}]"), latin).otherwise(bigrams(run))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), F.lit(0)), of_run))


def legacy_tokenize(text: Column) -> Column:
    """Whole words over Latin letters, digits and Hangul, lower-cased, of two characters or more."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LATIN}{HANGUL}]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)


def token_cost(text: Column) -> Column:
    """Upper-leaning token estimate: a Hangul syllable is one, a Hanja two, three other visible characters one; at least one."""
    text = F.coalesce(text, F.lit(""))
    hangul, hanja = F.regexp_count(text, F.lit(f"[{HANGUL}]")), F.regexp_count(text, F.lit(f"[{HANJA}]"))
    other = F.length(F.regexp_replace(text, r"(?U)\s", "")) - hangul - hanja
    return F.greatest(F.lit(1), hangul + 2 * hanja + F.ceil(F.greatest(F.lit(0), other) / 3)).cast("long")


def words_asked(dateless: Column) -> Column:
    """Topical words of a question whose date expressions are already blanked: no question words, no bare numbers, no single letters."""
    words = F.transform(F.regexp_extract_all(dateless, F.lit(f"[{LATIN}]+|[{HANGUL}{HANJA}]+"), F.lit(0)), F.lower)
    asked = _listed(QUESTION_WORDS)
    return F.filter(words, lambda w: ~F.array_contains(asked, w) & ~w.rlike("^[0-9]+$") & ((F.length(w) > 1) | w.rlike(f"^[{HANGUL}{HANJA}]")))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends followed by white space, or line ends; trimmed, empty ones included since they count as places."""
    return F.transform(F.split(text, r"(?U)(?<=[.!?。])\s+|\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def _two(part: Column) -> Column:
    return F.when(F.length(part.cast("string")) < 2, F.lpad(part.cast("string"), 2, "0")).otherwise(part.cast("string"))


def joined_date(year: Column, month: Column, day: Column) -> Column:
    """The known parts, two digits at least, by hyphen; unknown parts are skipped."""
    return F.concat_ws("-", _two(year), _two(month), _two(day))


def date_label(year: Column, month: Column, day: Column, calendar: Column, leap: Column) -> Column:
    date = joined_date(year, month, day)
    lunar = F.when(F.coalesce(leap, F.lit(False)), F.lit(" (lunar leap month)")).otherwise(F.lit(" (lunar)"))
    return F.when(date == "", F.lit("date unknown")).otherwise(F.concat(date, F.when(calendar == "lunar", lunar).otherwise(F.lit(""))))


def citation_label(id_: Column, label: Column, title: Column) -> Column:
    return F.trim(F.concat(F.lit("["), id_, F.lit("] "), label, F.lit(" "), F.coalesce(title, F.lit(""))))


def cited_ids(text: Column) -> Column:
    """Identifiers inside square brackets, several by comma or semicolon, in order."""
    groups = F.regexp_extract_all(text, F.lit(r"(?U)\[([^\[\]\s]+(?:\s*[,;]\s*[^\[\]\s]+)*)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.split(g, r"(?U)\s*[,;]\s*")))


def analysis_section(text: Column) -> Column:
    """What follows the heading of the analysis, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(text, r"(?is)contextual analysis\s*:?\s*\n?(.*)", 1))


def abstains(text: Column) -> Column:
    return F.startswith(F.upper(F.trim(text)), F.lit("INSUFFICIENT EVIDENCE"))


def safe_key(key: Column) -> Column:
    """File name of a cached page."""
    return F.regexp_replace(key, "[^A-Za-z0-9_.=-]", "_")


def reign_year(n: Column) -> Column:
    """Calendar year of a reign year 0 to 32, else null."""
    return F.when(n.between(0, 32), n + 1418)

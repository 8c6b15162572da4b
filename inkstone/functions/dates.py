"""Dates in free text: exact, partial, range and regnal expressions, as native expressions.

A rule is a shape: components (a year, a reign year, a month name, …) with the words and marks between them. Shapes compile to patterns whose
groups are the components, and what a match means follows from the kinds of its components alone. Matches become an array of spans, and a
text's date is picked from that array by ordering structs; no row leaves the JVM. A bare number is never a date, so every shape asks
for some context around the year.

Functions take the name of a string column, since a shape reads it many times. They are meant for short strings (questions, titles, date fields).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first year of the reign and its last, the years that can be dates, and how far apart the ends of a range may be.
FIRST_YEAR, LAST_REIGN, WIDEST_RANGE = 1418, 32, 100
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
YEAR = r"1[3-8]\d\d|190\d|1910"
#: What each kind of component looks like.
KINDS = {
    "year": YEAR,
    "last": YEAR,
    "reign": r"\d{1,2}",
    "last_reign": r"\d{1,2}",
    "accession": "즉위",
    "named_accession": r"accession\s+year\s+of\s+(?:king\s+)?sejong|(?:king\s+)?sejong(?:\x27s)?\s+accession\s+year",
    "name": "(?:" + "|".join("jan(?:uary)? feb(?:ruary)? mar(?:ch)? apr(?:il)? may june? july? aug(?:ust)? sept?(?:ember)? oct(?:ober)? nov(?:ember)? dec(?:ember)?".split()) + r")(?=\.?(?![a-z]))",
    "to_name": "(?:" + "|".join("jan(?:uary)? feb(?:ruary)? mar(?:ch)? apr(?:il)? may june? july? aug(?:ust)? sept?(?:ember)? oct(?:ober)? nov(?:ember)? dec(?:ember)?".split()) + r")(?=\.?(?![a-z]))",
    "month": "1[0-2]|0?[1-9]",
    "any_month": r"\d{1,2}",
    "day": r"3[01]|[12]\d|0?[1-9]",
    "any_day": r"\d{1,2}",
    "to_day": r"3[01]|[12]\d|0?[1-9]",
    "leap": "윤",
    "mark": "[-/.]",
    "lead": "",  # words before a year that are no part of the date
}
#: Parts that shapes have in common.
PARTS = {
    "king": r"(?:king\s+)?sejong",
    "ko_king": r"세종 (?:대왕 )?",
    "dash": "[-–—~]",
    "th": "(?:st|nd|rd|th)?",
    "fresh": r"(?<!\d)",
    "done": r"(?!\d)",
    "of": r"\s+(?:of\s+)?",
    "days": r"<day>{th}{done}(?: (?:[-–—]|to) <to_day>{th}{done})?",
    "end": r"(?= (?:$|[?.!,;:)]|and\b|to\b|ad\b|ce\b|년))",
}


@dataclass(frozen=True)
class Shape:
    """Name, components by <kind> among fixed text (a blank: optional white space), and whether letters' case counts."""

    name: str
    text: str
    exact: bool = False


#: The rules' names and shapes, in order of precedence.
SHAPES = (
    Shape("reign-ko-range", r"{ko_king}(?:<accession>년|<reign> 년) (?:부터|[-–~]) <last_reign> 년", True),
    Shape("reign-ko", r"{ko_king}(?:<accession> 년|<reign> 년)(?: <leap>? <any_month> 월(?: <any_day> 일)?)?", True),
    Shape("reign-en-ordinal", r"\b(?:the\s+)?<reign>{th}\s+(?:regnal\s+)?year\s+of\s+{king}"),
    Shape("reign-en-accession", r"\b<named_accession>"),
    Shape("reign-en", r"\b{king}(?:\x27s)?\s+(?:reign\s+)?(?:year\s+)?<reign>{th}(?:\s+year)?{done}"),
    Shape("year-range-words", r"<lead:\b(?:between|from)\s+><year> 년? (?:and|to|until|through|{dash}) <last>{done}"),
    Shape("year-range-ko", r"{fresh}<year> 년? (?:부터|{dash}) <last> 년", True),
    Shape("year-range", r"{fresh}<year> (?:{dash}|\bto\b) <last>{done}"),
    Shape("iso", r"{fresh}<year><mark><month>{done}(?:\k<mark><day>{done})?", True),
    Shape("korean", r"{fresh}<year> 년(?: <leap>? <month> 월(?: <day> 일)?)?", True),
    Shape("en-month-range", r"\b<name>\.? (?:{dash}|to|until|through|and) <to_name>\.?,?{of}<year>{done}"),
    Shape("en-mdy", r"\b<name>\.?\s+{days},?{of}<year>{done}"),
    Shape("en-dmy", r"\b(?:the\s+)?{days}{of}<name>\.?,?\s+<year>{done}"),
    Shape("en-my", r"\b<name>\.?,?{of}<year>{done}"),
    Shape("ad", r"{fresh}<year> (?:AD\b|A\.D\.|CE\b)", True),
    Shape("year-strong", r"<lead:(?:\b(?:in|during|year|dated|date|circa|ca\.|c\.) :?\s+|\( )><year>{done}"),
    Shape("year-weak", r"<lead:\b(?:of|by|around|since|until|till|before|after|from|on)\s+><year>{done}{end}"),
)
_COMPONENT = re.compile(r"(?<!\\k)<(\w+)(?::((?:[^<>])+))?>")


def compiled(shape: Shape) -> tuple[str, dict[str, int]]:
    """A shape's pattern, and the number of each component's group."""
    text = shape.text
    while (full := re.sub(r"\{(\w+)\}(?<!\d\})", lambda m: PARTS.get(m[1], m[0]), text)) != text:
        text = full
    groups: dict[str, int] = {}

    def component(m: re.Match[str]) -> str:
        groups[m[1]] = len(groups) + 1
        return f"({m[2] or KINDS[m[1]]})"

    pattern = _COMPONENT.sub(component, text.replace(" ", r"\s*"))
    pattern = re.sub(r"\\k<(\w+)>", lambda m: rf"\{groups[m[1]]}", pattern)
    return ("(?U)" if shape.exact else "(?U)(?i)") + pattern, groups


_ANY = r"(?U)(?i)\d|즉위|accession"
_SPAN = "array<struct<start:int,shorter:int,rule:int,nth:int,year:int,month:int,day:int,year_end:int,leap_month:boolean,lead:int>>"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _meaning(shape: Shape, groups: dict[str, int], pattern: str) -> dict[str, str]:
    """SQL of year, month, day, year_end and leap_month of a match m, by the kinds of the shape's components."""
    said = lambda kind: f"regexp_extract(m, {_raw(pattern)}, {groups[kind]})"
    number = lambda kind: f"try_cast({said(kind)} as int)"
    reign = lambda kind: f"if({number(kind)} <= {LAST_REIGN}, {FIRST_YEAR} + {number(kind)}, null)"
    none, out = "cast(null as int)", {}
    if "year" in groups:
        year = number("year")
    elif "named_accession" in groups:
        year = str(FIRST_YEAR)
    else:
        year = f"if({said('accession')} <> '', {FIRST_YEAR}, {reign('reign')})" if "accession" in groups else reign("reign")
    out["year"], out["year_end"], out["leap_month"] = year, none, f"{said('leap')} <> ''" if "leap" in groups else "false"
    if "last_reign" in groups or "last" in groups:
        last = reign("last_reign") if "last_reign" in groups else number("last")
        fits = f"{last} <> {year}" if "last_reign" in groups else f"abs({last} - {year}) <= {WIDEST_RANGE}"
        out["year"], out["year_end"] = f"if({fits}, least({year}, {last}), null)", f"if({fits} and {last} <> {year}, greatest({year}, {last}), null)"
    if "name" in groups and "to_name" not in groups:
        month = f"(locate(substring(lower({said('name')}), 1, 3), '{''.join(MONTHS)}') + 2) div 3"
        out["month"] = f"cast({month} as int)"
    else:
        out["month"] = next((number(k) for k in ("month", "any_month") if k in groups), none)
    out["day"] = next((number(k) for k in ("day", "any_day") if k in groups), none)
    if "to_day" in groups:
        out["day"] = f"if({said('to_day')} = '', {out['day']}, null)"
    if "any_month" in groups:  # an impossible month or day leaves the year
        fits = f"(coalesce({out['month']}, 1) between 1 and 12 and coalesce({out['day']}, 1) between 1 and 30)"
        out |= {k: f"if({fits}, {out[k]}, null)" for k in ("month", "day")} | {"leap_month": f"({out['leap_month']} and {fits})"}
    return out


def _spans_of(nth: int, shape: Shape, text: str) -> str:
    """SQL array of a shape's matches that spell a date, ordered by what makes one the first of a text: start, length, precedence, place."""
    pattern, groups = compiled(shape)
    found, lead = f"regexp_extract_all({text}, {_raw(pattern)}, 0)", f"length(regexp_extract(m, {_raw(pattern)}, {groups['lead']}))" if "lead" in groups else "0"
    # pieces between the matches and the matches themselves make up the text
    upto = lambda parts, n: f"aggregate(slice({parts}, 1, {n}), 0, (n, x) -> n + length(x))"
    start = f"{upto(f'split({text}, {_raw(pattern)})', 'i + 1')} + {upto(found, 'i')} + {lead}"
    m = _meaning(shape, groups, pattern)
    fields = {"start": start, "shorter": f"{lead} - length(m)", "rule": str(nth), "nth": "i", **{k: m[k] for k in ("year", "month", "day", "year_end", "leap_month")}, "lead": lead}
    struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return f"if({text} rlike {_raw(_needed(shape))}, cast(filter(transform({found}, (m, i) -> {struct}), s -> s.year is not null) as {_SPAN}), cast(array() as {_SPAN}))"


def _needed(shape: Shape) -> str:
    """A short pattern without which a text can't match a shape."""
    if "{ko_king}" in shape.text:
        return "세종"
    if "{king}" in shape.text or "named_accession" in shape.text:
        return "(?i)sejong"
    return "(?i)" + KINDS["name"] if "<name>" in shape.text else YEAR


def spans_sql(text: str) -> str:
    """SQL array of all dates that any rule finds in a column; those of different rules may overlap."""
    text = f"coalesce({text}, '')"
    arrays = ", ".join(_spans_of(i + 1, s, text) for i, s in enumerate(SHAPES))
    return f"if({text} rlike {_raw(_ANY)}, flatten(array({arrays})), cast(array() as {_SPAN}))"


#: A span after all others, of no date, and the rules' names by number from it on.
_NONE = f"cast(array(named_struct('start', {2**31 - 1}, 'shorter', 0, 'rule', 0, 'nth', 0, 'year', null, 'month', null, 'day', null, 'year_end', null, 'leap_month', false, 'lead', 0)) as {_SPAN})"
_NAMES = "array(" + ", ".join(f"'{name}'" for name in ("", *(s.name for s in SHAPES))) + ")"
_MONTHS_APART = next(i + 1 for i, s in enumerate(SHAPES) if s.name == "en-month-range")
SPEC = "struct<year: int, month: int, day: int, year_end: int, leap_month: boolean, rule: string, text: string>"


def _spec_sql(text: str) -> str:
    """SQL struct of a column's date: the first span; unless that is a range, one apart from it that tells more of the same date."""
    apart = "(s.start - s.shorter <= f.start or s.start >= f.start - f.shorter)"
    same = "s.year = f.year and s.year_end is null and (f.month is null or s.month = f.month)"
    known = "struct(s.month is not null as m, s.day is not null as d, s = f as f, -s.rule as r, -s.nth as n, s as span)"
    best = f"if(f.year_end is not null or f.rule = {_MONTHS_APART}, f, array_max(transform(filter(a, s -> s = f or {apart} and {same}), s -> {known})).span)"
    picked = f"element_at(transform(array(concat({spans_sql(text)}, {_NONE})), a -> element_at(transform(array(array_min(a)), f -> {best}), 1)), 1)"
    said = f"substring(coalesce({text}, ''), p.start - p.lead + 1, p.lead - p.shorter)"
    out = f"named_struct('year', p.year, 'month', p.month, 'day', p.day, 'year_end', p.year_end, 'leap_month', p.leap_month, 'rule', element_at({_NAMES}, p.rule + 1), 'text', if(p.rule = 0, '', {said}))"
    return f"element_at(transform(array({picked}), p -> {out}), 1)"


def date_spec(text: str) -> Column:
    """Struct of the first date in a column of short texts; year is null where there is none."""
    return F.expr(_spec_sql(text))


def record_date(value: str) -> Column:
    """Struct of a date field's date: like date_spec, but a year alone will do. The column must be trimmed."""
    bare = f"named_struct('year', cast({value} as int), 'month', cast(null as int), 'day', cast(null as int), 'year_end', cast(null as int), 'leap_month', false, 'rule', 'bare-year-field', 'text', {value})"
    return F.expr(f"if({value} rlike {_raw(f'(?U)^(?:{YEAR})$')}, {bare}, {_spec_sql(value)})")


def without_dates(text: str) -> Column:
    """Text with date expressions blanked, character for character; null as empty."""
    blanked = "concat(substring(t, 1, s.start), repeat(' ', -s.shorter), substring(t, s.start - s.shorter + 1))"
    return F.expr(f"aggregate({spans_sql(text)}, coalesce({text}, ''), (t, s) -> {blanked})")


#: Words that can be part of a date, beside those with a digit; of Korean words those that hold one of the syllables.
_WORDS = "of the between from and to until through till in during year dated date circa ca c by around since before after on king sejong s reign regnal accession a d ad ce st nd rd th".split()
_SYLLABLES = "세종|대왕|즉위|년|월|일|부터|윤"
_PASSAGE = rf"(?i)(?:(?<!\w)(?:\w*\d\w*|(?:{'|'.join(MONTHS)})[a-z]*|{'|'.join(_WORDS)}|\w*(?:{_SYLLABLES})\w*)(?!\w)|[^\w]+)++(?:\w+)?"
_SEGMENTS = "place bigint, segment string"


def _segmented(key: str, text: str):
    """Stretches of texts in which a date may stand: words that dates are made of, and the word after them, which tells whether a year is one."""

    def run(batches):
        import re

        import pyarrow as pa

        find, anchor = re.compile(_PASSAGE).finditer, re.compile(r"\d|즉위|(?i:accession)").search
        for batch in batches:
            rows, places, segments = [], [], []
            for i, said in enumerate(batch.column(text).to_pylist()):
                for m in find(said or ""):
                    if anchor(m[0]):
                        rows.append(i)
                        places.append(m.start())
                        segments.append(m[0])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(segments, pa.string())], [key, "place", "segment"])

    return run


def date_mentions(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, start, said, year, month, day, year_end, leap_month, rule: every date of long texts, by one scan of each.

    A scan cuts out the few stretches made of words that dates are made of, and only these are read by the shapes. Of dates that overlap the one counts that begins
    first, then the longer, then the rule that comes first. start: characters before it. Null and empty texts have none.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, text).filter(F.col(text).rlike(_ANY))
    segments = rows.mapInArrow(_segmented(key, text), f"`{key}` {kind}, {_SEGMENTS}")
    apart = "if(s.start < coalesce(try_element_at(kept, -1).start - try_element_at(kept, -1).shorter, 0), kept, array_append(kept, s))"
    chosen = f"aggregate(array_sort({spans_sql('segment')}), cast(array() as {_SPAN}), (kept, s) -> {apart})"
    found = segments.select(key, "place", "segment", F.explode(F.expr(chosen)).alias("s"))
    said = F.expr("substring(segment, s.start + 1, -s.shorter)")
    return found.select(key, (F.col("place") + F.col("s.start")).alias("start"), said.alias("said"), *[f"s.{c}" for c in ("year", "month", "day", "year_end", "leap_month")], F.expr(f"element_at({_NAMES}, s.rule + 1)").alias("rule"))

import pytest
from pyspark.sql import functions as F

from inkstone.functions.dates import date_spec, record_date, spans_sql, without_dates

CASES = {
    "What was the educational policy on May 12, 1420?": (1420, 5, 12, None), "12 May 1420": (1420, 5, 12, None), "the 12th of May, 1420": (1420, 5, 12, None), "Sept. 3rd, 1446": (1446, 9, 3, None),
    "in October of 1446": (1446, 10, None, None), "1420 AD": (1420, None, None, None), "approximate date: 1446": (1446, None, None, None), "1652년 기록": (1652, None, None, None), "1799-12-30 record": (1799, 12, 30, None),
    "1420/5/12": (1420, 5, 12, None), "1420년 5월 12일 경연": (1420, 5, 12, None), "1420-05": (1420, 5, None, None), "1420년 13월": (1420, None, None, None), "세종 2년 5월 12일에 무슨 일이 있었나?": (1420, 5, 12, None),
    "세종 즉위년 8월 10일": (1418, 8, 10, None), "세종대왕 10년": (1428, None, None, None), "in the 28th year of King Sejong": (1446, None, None, None), "Sejong year 2": (1420, None, None, None),
    "Sejong's accession year": (1418, None, None, None), "between 1420 and 1425": (1420, None, None, 1425), "1420–1425": (1420, None, None, 1425), "1420년부터 1425년까지": (1420, None, None, 1425),
    "세종 2년부터 5년까지": (1420, None, None, 1423), "May 12-14, 1420": (1420, 5, None, None), "from May to June 1420": (1420, None, None, None), "the policies of 1420?": (1420, None, None, None),
    "세종 28년 9월": (1446, 9, None, None), "세종 2년 13월": (1420, None, None, None), "세종 5년~2년": (1420, None, None, 1423), "세종 2년부터 2년": (1420, None, None, None), "the 2nd regnal year of sejong": (1420, None, None, None),
    "accession year of King Sejong": (1418, None, None, None), "King Sejong's reign year 12th": (1430, None, None, None), "from 1443 to 1446": (1443, None, None, 1446), "between 1425 and 1420": (1420, None, None, 1425),
    "between 1420 and 1420": (1420, None, None, None), "from 1400 to 1600": (1400, None, None, None), "1420 to 1425": (1420, None, None, 1425), "1420.5.12": (1420, 5, 12, None), "1420-5/12": (1420, 5, None, None), "1420-13": (None, None, None, None),
    "1420년 윤5월": (1420, 5, None, None), "from the 3rd to 5th of May, 1420": (1420, 5, None, None), "3 to 5 May 1420": (1420, 5, None, None), "May 1420": (1420, 5, None, None), "1420 A.D.": (1420, None, None, None), "1420 ad": (None, None, None, None),
    "circa 1420": (1420, None, None, None), "(1420)": (1420, None, None, None), "records by 1420.": (1420, None, None, None), "of 1420 soldiers": (None, None, None, None),
    "In 1420, on May 12, 1420": (1420, 5, 12, None), "May 1420, that is 1420-06-03": (1420, 5, None, None), "in 1420 and 1446-09-29": (1420, None, None, None), "mayor 1420": (None, None, None, None),
}



NONE = ["1420 3 officials", "How did 1500 soldiers defend the northern border?", "An army of 1500 soldiers marched", "28 letters", "세종 40년", "", None]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(t,) for t in [*CASES, *NONE, "세종 2년 윤1월 3일", "hall in 1420, then", "between 1420 and 1425 x"]]
    out = spark.createDataFrame(rows, "t string").select("t", date_spec("t").alias("s"), without_dates("t").alias("b"), F.expr(spans_sql("t")).alias("all"))
    return {r.t: r for r in out.collect()}


@pytest.mark.parametrize("said", CASES)
def test_dates(parsed, said):
    s = parsed[said].s
    assert (s.year, s.month, s.day, s.year_end) == CASES[said]


@pytest.mark.parametrize("said", NONE)
def test_no_dates(parsed, said):
    assert parsed[said].s.year is None and parsed[said].s.rule == "" and parsed[said].all == []


def test_spans_and_blanks(parsed):
    assert parsed["세종 2년 윤1월 3일"].s.leap_month and not parsed["세종 2년 13월"].s.leap_month
    assert parsed["hall in 1420, then"].b == "hall in     , then" and parsed[None].b == ""
    # words of context are told but are no part of the date
    assert parsed["hall in 1420, then"].s.text == "in 1420" and parsed["between 1420 and 1425 x"].b == "between               x"


def test_fields(spark):
    got = {r.t: r.s for r in spark.createDataFrame([("1420",), ("1420-05-29",), ("1299",), ("",), (None,)], "t string").select("t", record_date("t").alias("s")).collect()}
    assert (got["1420"].year, got["1420"].rule) == (1420, "bare-year-field") and got["1420-05-29"].day == 29 and got["1299"].year is got[""].year is got[None].year is None


def test_dates_of_long_texts_are_those_of_the_shapes(spark, parsed):
    """All cases in one text, parted by other words: the scan must find what the shapes find in the whole text."""
    import random

    from inkstone.functions.dates import date_mentions

    draw = random.Random(3)
    cases = [t for t in [*CASES, *NONE] if t]
    texts = [" ".join(x for t in draw.sample(cases, 12) for x in (t, draw.choice(["halls were", "mayor; x1", "soldiers.", "있었던", "é", "zebra -"]))) for _ in range(12)]
    rows = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "id int, text string")
    whole = {r.id: r.s for r in rows.select("id", F.expr(spans_sql("text")).alias("s")).collect()}
    want = []
    for i, spans in whole.items():
        upto = 0
        for s in sorted(spans, key=lambda s: (s.start, s.shorter, s.rule)):
            if s.start >= upto:
                want.append((i, s.start, s.year, s.month, s.day, s.year_end))
                upto = s.start - s.shorter
    got = date_mentions(rows).collect()
    assert sorted(map(str, want)) == sorted(str((r.id, r.start, r.year, r.month, r.day, r.year_end)) for r in got) and len(want) > 80
    assert all(texts[r.id][r.start : r.start + len(r.said)] == r.said for r in got)

"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch

#: The most line numbers that are broadcast, and the most lines of one segment key that are compared without a second.
MOST_BROADCAST, CROWD = 500_000, 64


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: every \\n-separated line that holds a word."""
    exploded = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.filter(F.col("line").rlike(WORD_PATTERN))


def _shared_start(x: Column, y: Column, most: Column) -> Column:
    """Length of a common start of two strings, `most` at most: found by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(14, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substring(x, n + 1, s) == F.substring(y, n + 1, s)), n + s).otherwise(n))


def trimmed(rows: DataFrame, x: str, y: str, most: int) -> DataFrame:
    """Rows with the common start and end of two strings left out but for `most` + 1 characters, which the band needs; their distance is the same."""
    room = F.greatest(F.lit(0), F.least(F.length(x), F.length(y)) - most - 1)
    cut = rows.withColumn("_n", _shared_start(F.col(x), F.col(y), room))
    cut = cut.withColumns({c: F.substring(c, F.col("_n") + 1, F.length(c)) for c in (x, y)})
    room = F.greatest(F.lit(0), F.least(F.length(x), F.length(y)) - most - 1)
    cut = cut.withColumn("_n", _shared_start(F.reverse(x), F.reverse(y), room))
    return cut.withColumns({c: F.substring(c, F.lit(1), F.length(c) - F.col("_n")) for c in (x, y)}).drop("_n")


def banded_distance(x: Column, y: Column, most: int) -> Column:
    """Edit distance of two strings of `most` characters or more, exact up to `most`; beyond that, some number above.

    Bit-parallel: one column of the dynamic-programming band is two bit vectors of 2 * most + 1 bits that move down the
    main diagonal with each character, so a step costs a few integer operations whatever the strings' length.
    """
    mask, top = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    lit = lambda v: F.lit(v).cast("long")
    # a lambda variable keeps the split texts from being cut anew at every step
    held = F.array(F.struct(F.split(x, "").alias("p"), F.split(y, "").alias("t"), F.length(x).alias("m"), F.length(y).alias("n")))
    return F.element_at(F.transform(held, lambda z: _band(z["p"], z["t"], z["m"], z["n"], most, mask, top, lit)), 1)


def _band(p: Column, t: Column, m: Column, n: Column, most: int, mask: int, top: int, lit) -> Column:
    start = F.struct(lit(mask ^ ((1 << most) - 1)).alias("vp"), lit(0).alias("vn"), lit(most).alias("dist"))

    def step(s: Column, i: Column) -> Column:
        here = F.get(t, i)
        eq = lit(0)
        for d in range(-most, most + 1):
            same = F.coalesce(F.get(p, i + d) == here, F.lit(False)) & (i + d >= 0) & (i + d < m)
            eq = eq.bitwiseOR(F.when(same, lit(1 << (d + most))).otherwise(lit(0)))
        vp, vn = s["vp"], s["vn"]
        flip = lambda v: v.bitwiseXOR(lit(mask))
        diagonal = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(lit(mask))
        return F.struct(diagonal.alias("d"), eq.alias("eq"), vn.bitwiseOR(flip(diagonal.bitwiseOR(vp))).alias("hp"), diagonal.bitwiseAND(vp).alias("hn"), s["dist"].alias("dist"))

    def finish(s: Column, i: Column) -> Column:
        right = F.shiftright(s["d"], 1)
        vp = s["hn"].bitwiseOR(right.bitwiseOR(s["hp"]).bitwiseXOR(lit(mask)).bitwiseAND(lit(mask)))
        down = F.when(s["d"].bitwiseAND(lit(top)) == 0, lit(1)).otherwise(lit(0))
        # once the band's lower edge has passed the last row, that row is followed along the columns
        row = F.element_at(F.array(*[lit(1 << b) for b in range(2 * most + 1)]), F.greatest(F.lit(1), m - 1 - i + most + 1))
        along = F.when(s["hp"].bitwiseAND(row) != 0, lit(1)).when(s["hn"].bitwiseAND(row) != 0, lit(-1)).otherwise(lit(0))
        dist = s["dist"] + F.when(i + most < m, down).otherwise(along)
        return F.struct(vp.alias("vp"), right.bitwiseAND(s["hp"]).alias("vn"), dist.alias("dist"))

    def both(s: Column, i: Column) -> Column:
        # cells of the band differ by one from row to row, so beyond three times `most` at its edge no cell leads back
        return F.when(s["dist"] > 3 * most, s).otherwise(F.element_at(F.transform(F.array(step(s, i)), lambda z: finish(z, i)), 1))

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, both, lambda s: s["dist"])


#: Characters whose counts are compared before two lines are paired.
COUNTED = "etaoinshrdlu0123"


def counts_of(line: Column) -> Column:
    """How often each counted character occurs."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def counts_allow(x: str, y: str, most: int) -> Column:
    """An edit changes two counts by one at most, so counts that differ by more than twice the edits rule a pair out."""
    apart = [F.abs(F.col(f"{x}.counts")[i] - F.col(f"{y}.counts")[i]) for i in range(len(COUNTED))]
    return sum(apart[1:], apart[0]) <= 2 * most


def segment_keys(line: Column, length: Column, most: int, within: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Keys under which a line is filed, and those under which it looks for lines of its own length or up to `most` shorter.

    A line of length l is cut into most + 1 even segments; a line within `most` edits of it holds one of them
    unchanged, at most so far from its place that the edits before and after it fit (multi-match-aware windows).
    A key is a hash of segment number, length of the filed line and the segment's text (and of `within`, the key that the lines share already); start and size
    say where the segment lies in the line.
    """
    parts = most + 1

    def at(i: int, of: Column) -> Column:
        start = F.lit(0)
        for k in range(i):
            start = start + F.floor((of + k) / parts).cast("int")
        return start

    def key(i: int, of: Column, start: Column) -> Column:
        size = F.floor((of + i) / parts).cast("int")
        named = [F.lit(i), of, F.substring(line, start + 1, size)] + ([] if within is None else [within])
        return F.struct(F.xxhash64(*named).alias("key"), start.cast("int").alias("start"), size.alias("size"))

    filed = [key(i, length, at(i, length)) for i in range(parts)]
    sought = []
    for less in range(parts):
        of = length - less
        for i in range(parts):
            low, high = max(-i, less - (most - i)), min(i, less + (most - i))
            sought += [key(i, of, at(i, of) + d) for d in range(low, high + 1) if less or d]
    return filed, sought


def _entries(rows: DataFrame, columns: list[str], line: str, most: int, within: str | None = None) -> DataFrame:
    """A row for each key of a line (column `line`), with whether the line is filed or looked for under it, as far as another row has the key too."""
    filed, sought = segment_keys(F.col(line), F.length(line), most, None if within is None else F.col(within))
    entry = lambda k, f: F.struct(k["key"].alias("key"), k["start"].alias("start"), k["size"].alias("size"), F.lit(f).alias("filed"))
    out = rows.select(*columns, F.explode(F.array(*[entry(k, True) for k in filed], *[entry(k, False) for k in sought])).alias("e")).select(*columns, "e.*")
    met = Window.partitionBy("key")
    return out.withColumn("n", F.count(F.lit(1)).over(met)).withColumn("f", F.count_if("filed").over(met)).filter("n > 1 and f > 0").drop("f")


def duplicate_lines(docs: DataFrame, most_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """(doc_id, line_no, near) of every line of (doc_id, text) that repeats an earlier one.

    Lines are ordered by doc_id and line number. A line goes if an earlier line is equal to it, or (near = true) if it is the
    first of its text, has least_chars characters or more and is within most_edits edits of an earlier such line.

    1. Equal lines meet first, by 96 bits of hashes; each distinct text goes on once, from its first place, so a line
       that a third of the corpus repeats is one row.
    2. Distinct lines are filed and sought under segment keys (segment_keys); the join's partner must differ and be at most
       most_edits longer or shorter, which the keys imply.
    3. Only rows whose key another row shares go on, with counts of characters that rule most pairs out inside the join. A key that many lines share is split: what is
       left of two such lines beside the segment is within the same edits, so it shares a segment again. Each line is
       compared with the first line of its key; those that go are not compared again, the others with all earlier lines of the key.
    4. Pairs are verified on the texts, less their common start and end, by a banded bit-parallel edit distance, once Spark's own has thrown
       most out; the later line of a pair goes.

    Lines without a word are never judged. Null or empty texts have no lines; rows without doc_id take no part.
    Rows that share a doc_id are one document: their lines of the same number and text count once in reports, though equal rows may come twice here. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    docs = docs.select("doc_id", "text")
    lines = lines_of(docs).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.hash("line"))
    places = keep(lines.select("doc_id", "line_no", "h1", "h2"), "lines")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    repeated = places.join(first, ["h1", "h2"]).filter("doc_id <> first.doc_id or line_no <> first.line_no").select("doc_id", "line_no", F.lit(False).alias("near"))

    texts = lines.filter(F.length("line") >= least_chars).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("m")).select("m.*")
    rows = keep(_entries(texts, ["doc_id", "line_no"], "line", most_edits), "segments")  # only rows whose key another row has too
    wanted = rows.select("doc_id", "line_no").distinct()
    needed = wanted.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("line_no").alias("ls"))
    if wanted.count() <= MOST_BROADCAST:  # some 16 MB of numbers; beyond that the texts are shuffled to them
        needed = F.broadcast(needed)
    found = docs.join(needed, docs["doc_id"] == needed["d"]).select("doc_id", "ls", F.split("text", "\n").alias("all")).select("doc_id", F.explode("ls").alias("line_no"), "all")
    found = keep(found.select("doc_id", "line_no", F.get("all", F.col("line_no")).alias("line")).filter("line is not null").distinct(), "line-texts")
    # lines that share a crowded key share a second segment of what is left of them beside the first
    rare, crowded = rows.filter(F.col("n") <= CROWD), rows.filter(F.col("n") > CROWD)
    left = crowded.join(found, ["doc_id", "line_no"]).withColumn("rest", F.concat(F.substring("line", F.lit(1), F.col("start")), F.substring("line", F.col("start") + F.col("size") + 1, F.length("line"))))
    both = left.select("doc_id", "line_no", F.col("key").alias("first_key"), "rest")
    second = _entries(both, ["doc_id", "line_no"], "rest", most_edits, "first_key")
    rows = rare.select("key", "filed", "doc_id", "line_no").unionByName(second.select("key", "filed", "doc_id", "line_no"))
    # the keys under which a line is filed: of those that two lines share, they meet under the smallest alone
    own = rows.filter("filed").groupBy("doc_id", "line_no").agg(F.collect_set("key").alias("own"))
    rows = rows.join(own, ["doc_id", "line_no"], "left").join(found.select("doc_id", "line_no", counts_of(F.col("line")).alias("counts")), ["doc_id", "line_no"])
    rows = keep(rows.select("key", "filed", F.struct("doc_id", "line_no").alias("id"), "counts", "own"), "candidates")

    def later_of(pairs: DataFrame) -> DataFrame:
        """The later lines of the pairs (a, b) that are within most_edits edits."""
        a = found.select(F.struct("doc_id", "line_no").alias("a"), F.col("line").alias("x"))
        b = found.select(F.struct("doc_id", "line_no").alias("b"), F.col("line").alias("y"))
        both = pairs.distinct().join(a, "a").join(b, "b").filter(F.abs(F.length("x") - F.length("y")) <= most_edits)
        # a cheap banded check first: the bit-parallel one costs some 5 microseconds a character as a higher-order function
        both = both.filter(F.levenshtein("x", "y", most_edits) >= 0)
        near = trimmed(both, "x", "y", most_edits).filter(banded_distance(F.col("x"), F.col("y"), most_edits) <= most_edits)
        return keep(near.select(F.col("b").alias("id")).distinct(), "near")

    first = rows.groupBy("key").agg(F.min(F.struct("id", "counts")).alias("m")).select(F.col("key").alias("k"), "m.*").alias("x")
    y = rows.alias("y")
    met = first.join(y, (F.col("x.k") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & counts_allow("x", "y", most_edits))
    gone = later_of(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    x, y = rows.alias("x"), rows.join(gone, "id", "left_anti").alias("y")
    sought = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.filed") | F.col("y.filed"))
    shared = F.array_min(F.array_intersect("x.own", "y.own"))
    once = F.when(shared.isNull(), F.lit(True)).otherwise((F.col("x.key") == shared) & F.col("x.filed") & F.col("y.filed"))
    rest = later_of(x.join(y, sought & counts_allow("x", "y", most_edits) & once).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    near = gone.unionByName(rest).distinct().select("id.doc_id", "id.line_no", F.lit(True).alias("near"))
    return scratch.result(repeated.unionByName(near), "duplicate-lines")


def line_report(docs: DataFrame, most_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_lines (with a word), n_equal and n_near dropped lines, dropped (their numbers, by comma)."""
    gone = duplicate_lines(docs, most_edits, least_chars).groupBy("doc_id").agg(
        F.size(F.collect_set(F.when(~F.col("near"), F.col("line_no")))).alias("n_equal"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("n_near"), F.array_join(F.array_sort(F.collect_set("line_no")), ",").alias("dropped"))
    worded = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD_PATTERN))).cast("long")
    counted = docs.select("doc_id", worded.alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", zero("n_equal"), zero("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame, most_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """docs with all their columns, the text rid of lines that repeat an earlier one; no row goes, n_chars follows if there.

    Rows without doc_id and null texts stay as they are; of rows that share a doc_id each loses the lines found for any. An empty table gives no rows.
    """
    gone = duplicate_lines(docs, most_edits, least_chars).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("line_no").alias("_gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["_doc"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)

"""Import of saved HTML pages as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.sources.articles import LEAST_READABLE, readable_pages
from inkstone.sources.chronicle import article_pages

#: The largest page, in bytes, and the mark of a chronicle's article block.
MOST_BYTES, BLOCK_MARK = 2_000_000, 'class="detail-view"'
_ID = r"kda_1\d{7}_\d{3}"


def import_pages(pages: DataFrame, chronicle_url: str | None = None, cut_off: bool = True) -> tuple[DataFrame, DataFrame]:
    """Articles and rejects (id, error) of saved pages (id, url, date, html, title?, volume?): https only, ISO date, an id, a bounded size, at least 50 characters of text.

    The given title goes before the page's own. Pages below chronicle_url that hold an article block are read as the chronicle's (article_pages); their
    text may be short. cut_off: see readable.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in pages.columns else F.lit("")
    p = pages.select("id", "url", "date", "html", given("title").alias("given_title"), given("volume").alias("volume"))
    ours = F.lit(False) if chronicle_url is None else F.startswith(F.lower("url"), F.lit(chronicle_url.lower())) & F.contains("html", F.lit(BLOCK_MARK)) & (F.regexp_extract("url", _ID, 0) != "")
    p = p.withColumns({"chronicle": F.coalesce(ours, F.lit(False)), "page_id": F.regexp_extract("url", _ID, 0)})
    early = (
        F.when(~F.coalesce(F.startswith(F.lower("url"), F.lit("https://")), F.lit(False)), "source URL must use HTTPS")
        .when(F.expr("try_to_date(date, 'yyyy-MM-dd')").isNull(), "date must be ISO")
        .when(F.trim(F.coalesce("id", F.lit(""))) == "", "article ID is required")
        .when(F.octet_length("html") > MOST_BYTES, "page is too large")
    )
    p = p.withColumn("error", early)
    open_ = p.filter("error is null")
    read = readable_pages(open_.filter("not chronicle"), cut_off)
    read = read.withColumn("error", F.when(F.length("text") < LEAST_READABLE, "too little readable text"))
    none = F.lit(None)
    plain = read.filter("error is null").select(
        "id", "date", F.coalesce(F.nullif("given_title", F.lit("")), "page_title").alias("title"), "text", F.col("url").alias("source_url"), "volume", F.lit("user-selected-html").alias("import_method"),
        F.lit("").alias("calendar"), F.lit(False).alias("leap_month"), F.lit("").alias("date_original"), none.cast("array<string>").alias("notes"), none.cast("array<string>").alias("categories"))
    rows = open_.filter("chronicle")
    good, bad = article_pages(rows.select(F.col("page_id").alias("id"), "html"), chronicle_url or "")
    told = good.select(F.col("id").alias("page_id"), F.col("title").alias("own_title"), "text", F.col("volume").alias("own_volume"), "calendar", "leap_month", "date_original", "notes", "categories").dropDuplicates(["page_id"])
    chronicle = rows.join(told, "page_id").select(
        "id", "date", F.coalesce(F.nullif("given_title", F.lit("")), "own_title").alias("title"), "text", F.col("url").alias("source_url"), F.coalesce(F.nullif("volume", F.lit("")), "own_volume").alias("volume"),
        F.lit("chronicle-html").alias("import_method"), "calendar", "leap_month", "date_original", "notes", "categories")
    failed = rows.join(bad.select(F.col("id").alias("page_id"), F.col("error").alias("why")).dropDuplicates(["page_id"]), "page_id").select("id", F.col("why").alias("error"))
    rejects = p.filter("error is not null").select("id", "error").unionByName(read.filter("error is not null").select("id", "error")).unionByName(failed)
    return plain.unionByName(chronicle), rejects

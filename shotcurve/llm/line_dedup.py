"""Line dedup by site-relative frequency.

Pages are grouped by host. The share of a host's pages that hold a line tells
boilerplate from content; lines above the ratio are dropped from all its pages.
A page counts a line once, and counts are combined where the pages lie, so
neither a host with a third of all pages nor a line on all of them is gathered
anywhere. What a host drops is a short list: shares above `ratio` can belong to
no more than 1 / ratio times the lines of an average page.

Lines of html are what stands between block-level tags, script, style and
comments removed. Lines are compared by a 128-bit hash.

Defined results: null or empty html has no lines; pages without a host are left
as they are; a line on fewer than `min_pages` pages of its host stays; order and
repeats of kept lines stay; repeated rows count as pages of their own; other
columns are carried along.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve.scratch import stored

RATIO = 0.3
MIN_PAGES = 3
# What is removed, and which tags end a line
REMOVED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK_TAG = (r"(?i)</?(?:html|head|body|title|article|section|header|footer|nav|aside|main|div|p|ul|ol|li|"
             r"table|tr|td|th|h[1-6]|br|hr|pre|blockquote|form)(?:[ /][^>]*)?>")
OTHER_TAG = r"<[^>]*>"


def html_lines(html) -> Column:
    """The lines of a page, trimmed, empty ones left out."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), REMOVED, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), OTHER_TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\r"))), lambda line: line != "")


def host_of(url) -> Column:
    """What stands between the first "://" and the next /, ? or #; null if empty."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^.*?://([^/?#]*)", 1))
    return F.nullif(host, F.lit(""))


def _hashed(line) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, dropped: hashes of its boilerplate lines) from (host, lines)."""
    pages = pages.filter(F.col("host").isNotNull())
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    line = F.explode(F.array_distinct(F.transform("lines", _hashed))).alias("line")
    counts = pages.select("host", line).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.filter(F.col("n") >= min_pages).join(totals, "host")
        .filter(F.col("n") / F.col("pages") > ratio)
        .groupBy("host").agg(F.collect_list("line").alias("dropped")))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the rows' columns in `row`, and host, n_lines, n_dropped, text
    (kept lines)."""
    rows = stored(pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "html"]).alias("row"),
        host_of("url").alias("host"), html_lines("html").alias("lines")), "page-lines")
    dropped = stored(boilerplate(rows.select("host", "lines"), ratio, min_pages), "boilerplate")
    none = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    kept = rows.join(dropped, "host", "left").withColumn("dropped", F.coalesce("dropped", none)).withColumn(
        "kept", F.when(F.size("dropped") == 0, F.col("lines")).otherwise(F.filter(
            "lines", lambda line: ~F.array_contains(F.col("dropped"), _hashed(line)))))
    return kept.select(
        "row", "host", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"))

"""Site-relative line frequency, in DataFrame functions only.

A page's lines are its text between block-level tags.  Pages are grouped by
host; a line's ratio is the share of the host's pages that contain it.  Lines
above a boilerplate ratio go.

For a host with p pages of m lines on average, at most m / ratio lines are above
the ratio, so a host's list of them is small even where the host is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

RATIO = 0.3
MIN_PAGES = 1  # hosts with fewer pages keep all lines; a line of a single page always stays
BROADCAST_LINES = 1_000_000

# fixed values: content that is never shown, and tags that end a line
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
_TAG = r"<[^>]*>"
_BLANK = r"[\x20\x09-\x0D]+"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; null or none: the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines_of(html: Column) -> Column:
    """Trimmed lines of a page's text, in order, without empty ones; null html has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[\x0A\x0D]+", " "), _BREAK, "\n")
    text = F.regexp_replace(text, _TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, _BLANK, " "))), lambda x: x != "")


def host_boilerplate(lines: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): hashes of the lines above ``ratio`` of the pages of hosts with ``min_pages`` at least.

    ``lines(host, lines)`` has a row per page; tasks count what they have read
    before anything is shuffled.
    """
    pages = lines.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    seen = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    seen = seen.where("n > 1")
    return seen.join(pages, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("common"))


def drop_boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_kept, text) for each row of ``pages(page_id, url, html)``.

    text joins the kept lines by line feeds.  Null urls share the empty host; a
    null or empty page has no lines; a host with fewer than ``min_pages`` pages
    keeps all; a line repeated within a page counts once and is kept or dropped
    at each place; repeated rows count as pages.  Lines are compared as 64-bit
    hashes.  Further columns are ignored.
    """
    lines = materialise(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")))
    common = materialise(host_boilerplate(lines.select("host", "lines"), ratio, min_pages))
    if (common.agg(F.sum(F.size("common"))).first()[0] or 0) <= BROADCAST_LINES:
        common = F.broadcast(common)  # else pages meet their host's list in a shuffle join, which splits large hosts
    # the page's own share of the host's list first, by a hash set, so that each line is looked up in no more than that
    own = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.col("common"))
    both = lines.join(common, "host", "left").withColumn("own", own)
    kept = F.when(F.col("own").isNull() | (F.size("own") == 0), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("own"), F.xxhash64(x))))
    both = both.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return both.select("page_id", "host", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", "\n").alias("text"))

"""Removal of boilerplate lines, by how common a line is on its own site.

Pages are grouped by host. For every line of a host, the pages that hold it are
divided by all pages of the host; a line over ``max_ratio`` that stands on at
least ``min_pages`` pages is boilerplate there and is dropped from all of them.
Lines are what ``\\n`` separates, compared as they are; empty lines are layout
and never dropped. DataFrame functions only.

Lines travel as 128-bit digests, once per page and line, and are summed where
they are read before any shuffle. A host's boilerplate lines are few (each page
holds at most its own lines, so there are at most lines per page / max_ratio),
but hosts are not, so that table is joined, not broadcast by hand; it is written
first so that a line on a third of all pages can be split among tasks.

Edge cases: a null text stays null and counts as a page of its host; a null host
is a host of its own; repeated rows count as pages each; an empty table gives an
empty result; all columns are kept, only the text changes, whatever other
columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import column, free_names, saved

MAX_RATIO = 0.05
MIN_PAGES = 5


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_shares(pages: DataFrame, host: str, text: str) -> DataFrame:
    """(host, line digest, pages): on how many pages of its host each non-empty line stands, and the host's page total."""
    rows = pages.select(column(pages, host).alias("host"), column(pages, text).cast("string").alias("text"))
    digests = F.transform(F.array_distinct(_lines(F.col("text"))), lambda x: F.when(x != "", _digest(x)))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = (rows.select("host", F.explode(digests).alias("line")).where("line IS NOT NULL")
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).select(counts["host"], "line", "pages", "host_pages")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line): digests of the lines to drop."""
    return line_shares(pages, host, text).where((F.col("pages") > max_ratio * F.col("host_pages")) & (F.col("pages") >= min_pages)).select("host", "line")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text.

    ``counts``: names of two columns to append, the page's lines and the lines dropped;
    columns of ``pages`` that have these names are replaced.
    """
    bad = saved(boilerplate(pages, host, text, max_ratio, min_pages))
    # A page is known by host and text: equal pages lose the same lines.
    own = pages.select(column(pages, host).alias("host_"), column(pages, text).cast("string").alias("text_"))
    held = (own.where("text_ IS NOT NULL")
            # The page's digest is taken once, below the line rows.
            .select("host_", F.unhex(F.sha2("text_", 256)).alias("page_"), F.transform(F.array_distinct(_lines(F.col("text_"))), lambda x: F.when(x != "", _digest(x))).alias("lines_"))
            .select("host_", "page_", F.explode("lines_").alias("line_")).where("line_ IS NOT NULL"))
    h, p, b = free_names(pages, "host_", "page_", "bad_")
    hits = (held.join(bad, held["host_"].eqNullSafe(bad["host"]) & (held["line_"] == bad["line"]))
            .groupBy(F.col("host_").alias(h), F.col("page_").alias(p)).agg(F.collect_set("line_").alias(b)))
    page = F.unhex(F.sha2(column(pages, text).cast("string"), 256))
    both = pages.join(hits, column(pages, host).eqNullSafe(hits[h]) & (page == hits[p]), "left")
    own_text = column(pages, text).cast("string")
    lines, found = _lines(own_text), hits[b]
    kept = F.when(found.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(found, _digest(x))))
    new = F.when(found.isNull(), own_text).otherwise(F.array_join(kept, "\n"))
    taken = {c.lower() for c in counts or ()}
    out = [new.alias(c) if c == text else column(pages, c) for c in pages.columns if c.lower() not in taken]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
                F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias(counts[1])]
    return both.select(*out)


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without port (null if there is none)."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))

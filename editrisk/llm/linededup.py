"""Line deduplication by site-relative frequency.

Documents are grouped by host.  The pages of a host that hold a line, over all
pages of the host, is the line's ratio; lines above the boilerplate ratio (and on
at least ``min_pages`` pages, so that small sites are left alone) are dropped.

Counting moves one (host, 128-bit line digest) row per distinct line of a document,
summed before the shuffle.  A host has at most lines-per-page / ratio boilerplate
lines, so they are one array per host; documents are joined to it by a
broadcast when its measured size allows, else by a shuffle join on the host, and
their lines are filtered in place: texts are not taken apart and regrouped.

With ``copies`` every document is a page.  Then a text that makes up more than the
ratio of its host (on ``min_pages`` rows at least) has all its lines above it, and every
copy becomes empty.  With ``copies=False`` the pages are the host's distinct texts (all
null texts are one): a copied document is no boilerplate.  Their line digests move once
more, one array per distinct (host, text).  Copies that differ in any character are
pages of their own in both.

Defined results: null text stays null; an empty text and blank lines are never
counted nor dropped; a text whose lines all go becomes empty and its row stays; null
host is a host of its own; repeated rows are pages of their own (but see ``copies``).
Lines end at ``\\n`` only.  Internal columns start with ``__``; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editrisk.llm.common import broadcast_if_small, discard, store

#: Digests of all hosts together that may be broadcast.
MAX_BROADCAST_LINES = 500_000


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def boilerplate_lines(docs: DataFrame, ratio: float, min_pages: int, text_col: str,
                      host_col: str) -> DataFrame:
    """One row per host that has boilerplate: ``__host, __lines`` (digests)."""
    seen = _line_digests(F.col(text_col))
    return _above(docs.select(F.col(host_col).alias("__host"), seen.alias("__seen")), ratio, min_pages)


def distinct_pages(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``__host, __seen`` (line digests) of every distinct text of a host; stored."""
    pages = docs.select(F.col(host_col).alias("__host"), _digest(F.col(text_col)).alias("__text"),
                        _line_digests(F.col(text_col)).alias("__seen"))
    return store(pages.dropDuplicates(["__host", "__text"]).drop("__text"), "pages")


def _line_digests(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_distinct(F.transform(F.filter(lines, lambda x: ~_blank(x)), _digest))


def _above(docs: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    pages = (docs.select("__host", F.explode("__seen").alias("__line"))
             .groupBy("__host", "__line").agg(F.count("*").alias("__pages"))
             .where(F.col("__pages") >= min_pages))
    totals = docs.groupBy(F.col("__host").alias("__h")).agg(F.count("*").alias("__total"))
    bad = (pages.join(totals, F.col("__host").eqNullSafe(F.col("__h")))
           .where(F.col("__pages") > F.lit(float(ratio)) * F.col("__total")))
    return bad.groupBy("__host").agg(F.collect_set("__line").alias("__lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 5, text_col: str = "text",
                     host_col: str = "source", counts: bool = False, copies: bool = True) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of the text; with ``counts`` also
    ``n_lines`` and ``n_dropped`` (both 0 for null text); without ``copies`` a host's
    equal texts are one page."""
    if copies:
        sites = store(boilerplate_lines(docs, ratio, min_pages, text_col, host_col), "boilerplate")
    else:
        pages = distinct_pages(docs, text_col, host_col)
        sites = store(_above(pages, ratio, min_pages), "boilerplate")
        discard(pages)
    n = sites.agg(F.coalesce(F.sum(F.size("__lines")), F.lit(0))).first()[0]
    if n <= MAX_BROADCAST_LINES:
        sites = broadcast_if_small(sites, 64)
    joined = docs.join(sites, docs[host_col].eqNullSafe(sites["__host"]), "left")
    text = docs[text_col]
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__lines"), _digest(x)))
    cut = joined.withColumn("__kept", F.when(text.isNotNull() & F.col("__lines").isNotNull(), kept))
    new = F.when(F.col("__kept").isNull(), text).otherwise(F.array_join("__kept", "\n"))
    out = [new.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        n_lines = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("long")
        gone = F.coalesce(F.when(F.col("__kept").isNotNull(), F.size(lines) - F.size("__kept")), F.lit(0))
        out += [n_lines.alias("n_lines"), gone.cast("long").alias("n_dropped")]
    return cut.select(*out)

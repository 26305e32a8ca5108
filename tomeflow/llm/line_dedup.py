"""Line dedup by site-relative frequency: lines on a larger share of a host's pages than a boilerplate ratio are dropped.

Native only. Pages holding a line are counted once each (lines are made distinct inside the row), summed map-side and
divided by the host's page total. A host can have at most (mean lines per page) / ratio boilerplate lines, so they fit in
one array per host, and each page is cleaned in its row: texts are never shuffled unless that table is too large to send.

Defined cases: a null host is a site of its own; a null text stays null and counts as a page without lines; blank lines
are kept and never counted; lines are compared exactly, blanks at their ends included (by a 64-bit hash); equal rows each
count as a page; a page all of whose lines go keeps an empty text; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage

# A line is boilerplate above this share of the host's pages, if at least so many pages of the host hold it.
BOILERPLATE_RATIO = 0.1
LEAST_PAGES = 5
BROADCAST_BYTES = 16 << 20
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _counted(line: Column) -> Column:
    """Blank lines are not counted."""
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != ""


def _site(host: Column) -> Column:
    return F.concat(F.when(host.isNull(), "n").otherwise("h"), F.coalesce(host.cast("string"), F.lit("")))


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, lines): per site the hashes of its boilerplate lines."""
    raw = pages.select(_site(F.col(host)).alias("site"), F.col(text).cast("string").alias("t"))
    totals = raw.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), _counted), lambda x: F.xxhash64(x)))
    counts = raw.select("site", F.explode(hashes).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    return counts.join(totals, "site").where(F.col("n") > ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("lines"))


def dedup_lines(pages: DataFrame, host: str, text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``text`` freed of boilerplate lines, and ``n_lines`` and ``n_dropped`` (replaced if there)."""
    found = boilerplate(pages, host, text, ratio, least_pages)
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], _site(F.col(host)).alias("_site"))
    rules = found.select(F.col("site").alias("_site"), F.col("lines").alias("_bad"))
    # Written once: its size decides the join and its rows feed it.
    rules = cut_lineage(rules)
    size = rules.agg(F.sum(F.size("_bad") * 8 + F.length("_site") + 64).alias("b")).first()["b"] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(rules), "_site", "left")
    else:
        # A hot site is spread over salts; its one row of rules is repeated.
        salt = F.pmod(F.xxhash64(text), F.lit(SALTS))
        repeated = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = rows.withColumn("_salt", salt).join(repeated, ["_site", "_salt"], "left").drop("_salt")
    lines = _lines(F.col(text).cast("string"))
    clean = F.when(F.col("_bad").isNull(), F.col(text).cast("string")).otherwise(
        F.array_join(F.filter(lines, lambda x: ~(_counted(x) & F.array_contains("_bad", F.xxhash64(x)))), "\n"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, _counted)))
    left = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.filter(_lines(F.col("_clean")), _counted)))
    named = joined.withColumn("_clean", clean)
    return named.select(*[F.col("_clean").alias(c) if c == text else F.col(f"`{c}`") for c in kept],
                        n_lines.cast("long").alias("n_lines"), (n_lines - left).cast("long").alias("n_dropped"))



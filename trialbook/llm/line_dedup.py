"""Boilerplate lines of a site: lines on more than a given share of its pages.

A page is a different text of the host: exact copies count once, so that a page that is
merely copied often does not lose its own lines. Lines are counted by (host, line hash) with
partial sums before the shuffle; counts over all rows bound those over different texts from
above, and only lines that pass that bound are counted exactly. What is dropped per host is a
short list (at most the mean number of lines of its pages divided by the ratio), which is
measured before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.session import pin

RATIO = 0.05
MIN_PAGES = 5


def _hash(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line, pages, host_pages) for each line hash over the ratio; blank lines never are."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    per_host = rows.select("host", _hash(F.col("text")).alias("page")).groupBy("host")
    totals = per_host.agg(F.count_distinct("page").alias("host_pages"))
    kept = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: F.trim(x) != "")
    lines = rows.select("host", _hash(F.col("text")).alias("page"), F.explode(kept).alias("line"))
    counts = lines.groupBy("host", _hash(F.col("line")).alias("line")).agg(F.count("*").alias("n"))
    often = attach(counts.where(F.col("n") >= min_pages), totals, ["host"], "inner", null_safe=True)
    often = pin(often.where(F.col("n") / F.col("host_pages") > ratio).select("host", "line", "host_pages"))
    seen = lines.select("host", _hash(F.col("line")).alias("line"), "page")
    exact = attach(seen, often, ["host", "line"], "inner", null_safe=True)
    found = exact.groupBy("host", "line", "host_pages").agg(F.count_distinct("page").alias("pages"))
    return found.where((F.col("pages") >= min_pages) & (F.col("pages") / F.col("host_pages") > ratio))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``docs`` with ``text`` less its host's boilerplate lines; new columns n_lines, n_dropped.

    Null text stays null with 0 lines; an empty text is one blank line. Rows of a null host
    form a host of their own. Repeated rows stay repeated; other columns are untouched, whatever
    their names, but columns called n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    found = boilerplate(docs, host, text, ratio, min_pages)
    lists = found.groupBy("host").agg(F.collect_list("line").alias("drop"))
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    rows = docs.select(row, F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    marked = attach(rows, lists, ["host"], null_safe=True)
    stay = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("drop"), _hash(x)))
    marked = marked.withColumn("stay", F.when(F.col("drop").isNotNull(), stay))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    left = F.when(F.col("stay").isNotNull(), F.size("stay")).otherwise(n)
    changed = F.when(F.col("stay").isNotNull() & (left < n), F.array_join("stay", "\n")).otherwise(F.col("text"))
    out = marked.select("row", n.cast("long").alias("n"), (n - left).cast("long").alias("dropped"), changed.alias("changed"))
    kept = [F.col("changed").alias(c) if c == text else F.col("row")[c].alias(c) for c in own]
    return out.select(*kept, F.col("n").alias("n_lines"), F.col("dropped").alias("n_dropped"))

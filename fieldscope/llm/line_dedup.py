"""Boilerplate lines by their frequency on their own site, by DataFrame functions alone.

A line is compared without surrounding white space, by its MD5. Of each host, the number of pages that hold a line is divided by the
number of its pages; lines whose share exceeds the ratio, on at least `least_pages` pages, are dropped wherever they stand on that host.
The least is 2, so that a page is not its own boilerplate. Counting partially aggregates before its shuffle, so neither a large host nor a
very common line meets in one task. A host has fewer boilerplate lines than its mean number of lines a page divided by the ratio. The lists
of these are broadcast only if their counted lines are few; otherwise those of the largest hosts are, and other pages join theirs by a shuffle.

Defined results: null text stays null and its page counts for the host; blank lines (of white space alone) are kept and never counted; a
line repeated on a page counts once; null hosts form a host of their own; a page of boilerplate alone becomes the empty text; rows that
repeat are pages of their own; an empty table gives no rows; columns of pages may have any names but those of the two counts, which take the
place of columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import durable, lookup

RATIO, LEAST_PAGES, BROADCAST_ROWS = 0.05, 2, 20_000
#: Fixed value: the white space around a line.
WHITE = " \t\v\f\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _key(line: Column) -> Column:
    return F.md5(_trimmed(line).cast("binary"))


def host_key(host: Column) -> Column:
    """A text for each host, and one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host (as host_key gives it), line (MD5), pages, host_pages of every boilerplate line."""
    rows = pages.select(host_key(F.col(host_col)).alias("host"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: _trimmed(x) != ""), _key))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") >= least_pages).join(hosts, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: tuple[str, str] = ("__lines", "__dropped")
) -> DataFrame:
    """pages with the text cleaned, and the numbers of lines and of dropped lines under the names in `counts`."""
    found = durable(boilerplate(pages, host_col, text_col, ratio, least_pages))
    lists = found.groupBy("host").agg(F.collect_set("line").alias("drop"))
    # All columns of pages are kept in one, so that none clashes with those of the work.
    rows = pages.select(host_key(F.col(host_col)).alias("host"), F.struct("*").alias("page"))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        hosts = durable(rows.groupBy("host").agg(F.count("*").alias("held")).join(lists, "host", "left"))
        joined = lookup(rows, hosts, "host", "held", hosts.agg(F.sum("held")).first()[0], 500)
    drop = F.coalesce("drop", F.array().cast("array<string>"))
    split = joined.select("page", drop.alias("drop"), F.split(F.col("page")[text_col], "\n", -1).alias("lines"))
    stays = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _key(x)) | (_trimmed(x) == ""))
    kept = split.withColumn("kept", F.when(F.size("drop") == 0, F.col("lines")).otherwise(stays))
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long"), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long")
    columns = [c for c in pages.columns if c not in counts]
    return kept.select(*(F.array_join("kept", "\n").alias(c) if c == text_col else F.col("page")[c].alias(c) for c in columns), *(x.alias(c) for x, c in zip(n, counts, strict=True)))

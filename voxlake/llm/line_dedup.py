"""Site-relative line frequency: lines on more than a share of a host's pages are boilerplate and go.

Everything runs as DataFrame expressions. Lines meet as (host, 64-bit hash) counts, one per page and line and summed
before the shuffle; texts never move. Boilerplate is bounded per host by its lines per page over the ratio, and comes
back to the pages as one array of hashes per host.

A null host is a host of its own. A null text has no lines and stays null; lines of blanks are neither counted nor
dropped. A line counts once per page however often it repeats there, and every repeat goes. Hosts under
`min_host_pages` pages, and lines on fewer than `min_pages`, are left alone. An empty table gives no rows. Columns
`n_lines` and `n_dropped` are replaced; all others come back as they were, whatever their names.

Each row is a page. With `copies_once`, rows of one host with the same text (by a 64-bit hash; null texts too) are one
page together, in lines and totals alike: a text that is copied often doesn't make boilerplate of its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import stored_bytes, written

RATIO = 0.05
MIN_PAGES = 3
MIN_HOST_PAGES = 10
#: Boilerplate tables up to this size are sent to all executors; larger ones meet the pages in a shuffled join.
BROADCAST_BYTES = 4 << 20


def _host(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("-"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_host_pages: int = MIN_HOST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host key, hashes): the boilerplate lines of each host."""
    hashes = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    keyed = pages.select(_host(host).alias("_host"), F.xxhash64(text).alias("_text"), hashes.alias("_hashes"))
    if copies_once:
        keyed = keyed.groupBy("_host", "_text").agg(F.first("_hashes").alias("_hashes"))
    seen = keyed.select("_host", F.explode("_hashes").alias("_line"))
    counts = seen.groupBy("_host", "_line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = keyed.groupBy("_host").agg(F.count("*").alias("total")).where(F.col("total") >= min_host_pages)
    often = counts.join(totals, "_host").where(F.col("pages") > F.col("total") * F.lit(ratio))
    return often.groupBy("_host").agg(F.sort_array(F.collect_set("_line")).alias("_common"))


def dedup_lines(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_host_pages: int = MIN_HOST_PAGES, copies_once: bool = False) -> DataFrame:
    """`pages` with `text` without boilerplate, and n_lines and n_dropped, lines before and dropped."""
    common = written(boilerplate(pages, host, text, ratio, min_pages, min_host_pages, copies_once), "boilerplate")
    if stored_bytes(common) <= BROADCAST_BYTES:
        common = F.broadcast(common)
    kept = F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_common", F.xxhash64(x))))
    names = [c for c in pages.columns if c not in (text, "n_lines", "n_dropped")]
    rest = F.struct(*[F.col(f"`{c}`") for c in names])  # in a struct, names of columns can't clash with those used here
    out = pages.select(_host(host).alias("_host"), _lines(text).alias("_lines"), rest.alias("_rest")).join(common, "_host", "left").withColumn("_kept", kept)
    return out.select(
        *[F.col(f"_rest.`{c}`") for c in names],
        F.array_join("_kept", "\n").alias(text),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )

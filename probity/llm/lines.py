"""Line dedup by site-relative frequency: drop lines that a large share of a host's pages contain.

For each host, the pages that contain a line are divided by all pages of the host; lines over the
ratio are boilerplate there and are dropped from its pages. The ratio alone decides; ``min_pages`` only keeps
what doesn't repeat: a line of one page, or of a page and one copy of it, which near-dedup handles. (Without it a host
of under 20 pages would lose every line, as one page is over 5 % there.) The site is the column ``host_col``: for
``documents`` it is source, the only site that table names, as it has no address; ``host_of`` gives the host of an address.

Counting shuffles only host and line digest, summed before the shuffle, so a line that a third of all
pages holds arrives as one row from each task. A host's boilerplate lines are at most its mean lines
per page divided by the ratio, so its list is small; the lists are written and then joined, where
Spark broadcasts them only if their written size is under its threshold, and otherwise shuffles and
splits the hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialize

RATIO = 0.05
#: A pair of equal pages isn't boilerplate; from three pages on the ratio decides, on a host of any size.
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r"))))


def host_of(url: Column) -> Column:
    """The lower-case host of an address, without its port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def boilerplate_lines(df: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """One row for each host that has boilerplate: _host, _lines (array of line digests)."""
    pages = df.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) > 0), _key))
    lines = pages.where(F.col("_text").isNotNull()).select("_host", F.explode(keys).alias("_key"))
    counts = lines.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    over = counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host"))).where(F.col("_n") > F.lit(float(ratio)) * F.col("_pages"))
    return over.groupBy("c._host").agg(F.collect_list("_key").alias("_lines"))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def drop_boilerplate(
    df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col``; adds _n_lines, _n_dropped (with further underscores at
    their ends while ``df`` has columns of those names, which stay as they are).

    Lines are parts between line feeds, compared without spaces, tabs and carriage returns at their
    ends; blank lines are never boilerplate. Every row stays, with the text that is left (maybe empty).
    A null host is a host of its own; a null text stays null with no lines; repeated rows count as pages
    each; an empty table gives an empty result.
    """
    tag = "__pb"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    host, lines, left = f"{tag}host", f"{tag}lines", f"{tag}left"
    bad = boilerplate_lines(df, host_col, text_col, ratio, min_pages)
    bad = materialize(bad.select(F.col("_host").alias(host), F.col("_lines").alias(lines)), "lines")
    joined = df.join(bad, F.col(host_col).eqNullSafe(F.col(host)), "left")
    every = F.split(F.col(text_col), "\n")
    kept = F.filter(every, lambda x: ~F.array_contains(F.col(lines), _key(x)))
    marked = joined.withColumn(left, F.when(F.col(lines).isNull(), every).otherwise(kept))
    n = F.size(every)
    n_lines, n_dropped = (_free(c, df.columns) for c in ("_n_lines", "_n_dropped"))
    out = marked.withColumns({
        n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"),
        n_dropped: F.when(F.col(text_col).isNull(), 0).otherwise(n - F.size(left)).cast("long"),
        text_col: F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")),
    })
    return out.drop(host, lines, left)

"""Sample and source checks: duplicates, per-source tables, label significance, recurring passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.stats import binomial_tail
from probity.sources.storage import few, materialize

#: Least rate of flags that a baseline may state.
BASELINE_FLOOR = 0.01
#: A source is concentrated below this probability and from this share on.
P_CONCENTRATED, SHARE_CONCENTRATED = 1e-3, 0.1


def duplicate_groups(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """content_hash, n, first_id of every content that more than one row has. Only digests are shuffled."""
    hashed = df.select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_links(df: DataFrame, id_col: str, *contents: Column) -> DataFrame:
    """Links (a, b) from each row to the first row of equal content, for each content given: a star, not all pairs."""
    out = None
    for content in contents:
        hashed = df.select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("h")).where(F.col("h").isNotNull())
        firsts = hashed.groupBy("h").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        links = hashed.join(firsts, "h").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
        out = links if out is None else out.union(links)
    return out.distinct()


def source_table(df: DataFrame, source: str, flags: dict[str, Column]) -> DataFrame:
    """source, n, one count for each flag, and anomaly_rate: flags over rows, at most 1, three places.

    A row that several flags hit counts in each, as in the rate.
    """
    out = df.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias(name) for name, c in flags.items()]
    )
    total = sum((F.col(name) for name in flags), F.lit(0))
    return out.withColumn("anomaly_rate", F.round(F.least(F.lit(1.0), total / F.col("n")), 3))


def source_significance(df: DataFrame, source: str, flag: Column, floor: float = BASELINE_FLOOR) -> DataFrame:
    """Per source: n, k flagged, the corpus's baseline rate, exact tail probability, concentrated flag and severity."""
    known = df.where(flag.isNotNull()).select(F.col(source).alias("source"), flag.cast("int").alias("hit"))
    per = known.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    base = per.agg(F.greatest(F.lit(floor), F.sum("k") / F.sum("n")).alias("baseline"))
    tested = per.join(F.broadcast(base)).withColumn("p_value", binomial_tail("k", "n", "baseline"))
    rate = F.col("k") / F.col("n")
    concentrated = (F.col("p_value") < P_CONCENTRATED) & (rate >= SHARE_CONCENTRATED)
    severity = F.when(~concentrated, "INFO").when((rate >= 0.3) & (F.col("p_value") < 1e-6), "HIGH").otherwise("MEDIUM")
    return tested.select("source", "n", "k", F.round("baseline", 9).alias("baseline"), F.round("p_value", 9).alias("p_value"), concentrated.alias("concentrated"), severity.alias("severity"))


def top_share(df: DataFrame, flag: Column, source: str, id_col: str) -> DataFrame:
    """The source with most flagged rows (first met on a tie), its share of the flagged and of its own rows."""
    marked = df.select(F.col(source).alias("source"), F.coalesce(flag, F.lit(False)).alias("hit"), F.col(id_col).alias("id"))
    per = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"), F.sum(F.col("hit").cast("int")).alias("n_flagged"), F.min(F.when(F.col("hit"), F.col("id"))).alias("first"))
    best = per.agg(
        F.sum("n_flagged").alias("total_flagged"),
        F.max_by(F.struct("source", "n_flagged", "n_source"), F.struct("n_flagged", (-F.col("first")).alias("f"))).alias("b"),
    )
    return best.select("b.source", "b.n_flagged", "b.n_source", "total_flagged", F.round(F.col("b.n_flagged") / F.col("total_flagged"), 9).alias("share"), F.round(F.col("b.n_flagged") / F.col("b.n_source"), 9).alias("concentration"))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; on a tie the one met first in ``order``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("f"))).alias("mode"), F.max("_n").alias("votes"))


def largest_groups(groups: DataFrame, members: DataFrame, top: int = 8, each: int = 12) -> DataFrame:
    """The largest groups with their first members: a report of bounded size."""
    best = groups.orderBy(F.col("n").desc(), "first_id").limit(top)
    w = Window.partitionBy("content_hash").orderBy("id")
    return members.join(F.broadcast(best), "content_hash").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each)


def passages(df: DataFrame, words: int = 8) -> DataFrame:
    """``df`` (text and more columns) without its text, once for each sequence of ``words`` words at a multiple of ``words``: with position, passage (digest).

    Digests are made before the rows are multiplied: a row of each position with all words would be quadratic in a text's length.
    """
    split = df.withColumn("w", F.split(F.lower("text"), r"\s+")).drop("text")
    last = (F.size("w") / words).cast("int") - 1
    digest = lambda i: F.md5(F.array_join(F.slice("w", i * words + 1, words), " "))
    spots = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("position"), digest(i).alias("passage")))
    # Not a filter on the words, which would be split once more for it.
    spots = F.when(last >= 0, spots)
    return split.select(*[c for c in df.columns if c != "text"], F.inline(spots))


def recurring_passages(df: DataFrame, id_col: str, text: str, source: str, words: int = 8, least: int = 8) -> DataFrame:
    """Same words at the same place in many rows: position, passage digest, members, top source and its share.

    The text analogue of a stamped patch: sequences of ``words`` words at every multiple of ``words``.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    # Only rows of repeated ids can hold a passage twice for one id; all others are summed before the shuffle.
    again = few(materialize(docs.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id"), "again"))
    cut = lambda how: passages(docs.join(again, "id", how), words)
    once = cut("left_anti").unionByName(cut("left_semi").distinct())
    per = once.groupBy("position", "passage", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = per.groupBy("position", "passage").agg(F.sum("n").alias("members"), F.max_by("source", F.struct("n", (-F.col("first")).alias("f"))).alias("top_source"), F.max("n").alias("top_n"))
    return out.where(F.col("members") >= least).withColumn("top_share", F.round(F.col("top_n") / F.col("members"), 9)).drop("top_n")

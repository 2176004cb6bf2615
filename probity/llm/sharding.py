"""Proportional stratified interleaving: shards that all have the corpus's mixture of sources.

Rows get a seeded pseudo-random order within their stratum; the rank r of n rows there becomes the
fraction (2r - 1) / 2n. Sorted by that fraction, every stretch of the result holds each stratum in
proportion, so equal cuts give shards of equal mixture.

No stratum is ranked in one task: a stratum's rows go to hash bins, more of them the more rows there are, whose counts
give each bin's first rank. The places of the fractions come from a sort over all partitions; equal fractions, as those of very many
small strata, are parted by stratum and hash, so no task gets them all. Texts are never shuffled, only their size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import materialize, with_ranks

#: Law that the shards keep: counts of rows are at most one apart.
LAW = "rows"
#: Rows of a hash bin, about, that a task sorts at a time.
BIN_ROWS = 65_536


def stratified_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    stratum_col: str = "source",
    carry: tuple[str, ...] = (),
    shards: int = 16,
    seed: int = 17,
) -> DataFrame:
    """Deal the rows of ``df`` into ``shards``; returns id, stratum, ``carry``, shard int, slot long.

    ``slot`` counts from 0 without gaps in every shard. A null stratum is a stratum of its own; rows of a
    null id are ranked by the seed and the carried columns, so many of them share no bin; repeated ids and rows are each
    dealt, ties go by the carried columns. Rows of equal texts are dealt as any others: a group may be far larger than a
    shard, so it is spread, like its source, over all shards. Fewer rows than shards leave the last shards empty, an empty table gives no rows. Other
    columns of ``df``, whatever their names, are not read.
    """
    named = df.select(
        F.col(id_col).alias("_id"),
        F.col(stratum_col).cast("string").alias("_stratum"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    ties = [f"_c{i}" for i in range(len(carry))]
    keyed = named.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.concat_ws(":", F.lit("null"), *[F.col(c).cast("string") for c in ties])))))
    digits, rows = 3, df.count()
    while 16**digits * BIN_ROWS < rows:
        digits += 1
    keyed = keyed.withColumn("_bin", F.substring("_h", 1, digits))
    # Rank within the stratum: rows in lower bins, plus the place within the bin.
    counts = keyed.groupBy("_stratum", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_stratum")
    offsets = counts.select(
        F.col("_stratum").alias("_s2"),
        F.col("_bin").alias("_b2"),
        (F.sum("_n").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by).alias("_total"),
    )
    within = Window.partitionBy("_stratum", "_bin").orderBy("_h", "_id", *ties)
    ranked = keyed.withColumn("_r", F.row_number().over(within)).join(
        offsets, F.col("_stratum").eqNullSafe(F.col("_s2")) & (F.col("_bin") == F.col("_b2"))
    )
    fraction = (F.lit(2.0) * (F.col("_before") + F.col("_r")) - F.lit(1.0)) / (F.lit(2.0) * F.col("_total"))
    placed = ranked.select("_id", "_stratum", "_h", *ties, fraction.alias("_f"))
    placed = materialize(placed, "fractions")
    whole = placed.count()
    # A row without an id is parted from its like by the carried columns; beyond those, equal rows are alike.
    spot = with_ranks(placed, [F.col("_f")], [F.col("_stratum"), F.col("_h"), F.col("_id"), *[F.col(c) for c in ties]])
    position = (F.col("rank") - 1).cast("long")
    k = F.expr(f"cast(({shards} * (rank - 1)) div {max(whole, 1)} as int)")
    # Shard k holds the positions from ceil(k * all / shards).
    first = F.expr(f"(cast(_shard as bigint) * {whole} + {shards - 1}) div {shards}")
    return spot.withColumn("_shard", k).select(
        F.col("_id").alias(id_col),
        F.col("_stratum").alias(stratum_col),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_shard").alias("shard"),
        (position - first).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """``stratified_shards`` of documents by source, with each text's size and checksum.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 is its unsigned CRC-32 (null: 0). Of a very long text only
    these two numbers are moved.
    """
    slim = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    dealt = stratified_shards(slim, "doc_id", "source", ("size", "text_crc32"), shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")

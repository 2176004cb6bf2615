"""Importance resampling towards a target: documents whose words are likelier in the target than in the corpus are drawn more often.

1. Words and runs of up to ``n`` words are features; each goes to the bucket that its CRC-32 gives. The bucket list of every row is
   written once, so texts are parsed once.
2. The lists are exploded and counted by bucket, summed before the shuffle: each task sends at most ``buckets`` rows.
3. A bucket's gain is a thousand times the logarithm of how much likelier it is in the target, with one count added to each bucket. The gain table
   has exactly ``buckets`` rows, a parameter, and is broadcast.
4. The lists are exploded again, meet the gains and are summed by row; a row's features lie in one task, so one row of each document is shuffled.
5. A seeded Gumbel number of the id is added to the mean gain: the highest scores are a draw without replacement by weight.
6. Scores are sorted over all partitions; a row's rank is its place in its partition after the rows of the partitions before.

Everything is DataFrame functions. Ranking moves five numbers a document, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialize, with_ranks
from probity.sources.storage import scratch

#: A word is a run of ASCII letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words aren't drawn; percent of the others that are.
LEAST, PERCENT = 20, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_in(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def buckets_of(words: Column, grams: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``grams`` words, repeats included."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    every = words if grams == 1 else F.concat(*[runs(n) for n in range(1, grams + 1)])
    return F.transform(every, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def _features(texts: DataFrame, text_col: str, keep: list[Column], grams: int, buckets: int) -> DataFrame:
    """``keep``, _words (how many) and _buckets of every row."""
    named = texts.select(*keep, words_in(F.col(text_col)).alias("_w"))
    return named.select(*[c for c in named.columns if c != "_w"], F.size("_w").cast("long").alias("_words"), buckets_of(F.col("_w"), grams, buckets).alias("_buckets"))


def _counts(lists: DataFrame, name: str) -> DataFrame:
    return lists.select(F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias(name))


def gain_table(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """_bucket int, _gain long for each of ``buckets``; both frames have lists of buckets in ``_buckets``."""
    spark = corpus.sparkSession
    every = spark.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("_bucket"))
    both = every.join(_counts(corpus, "_s"), "_bucket", "left").join(_counts(target, "_t"), "_bucket", "left").na.fill(0, ["_s", "_t"])
    counted = materialize(both, "buckets")
    s_all, t_all = counted.agg(F.sum("_s"), F.sum("_t")).first()
    ratio = ((F.col("_t") + 1).cast("double") * F.lit(float(s_all + buckets))) / ((F.col("_s") + 1).cast("double") * F.lit(float(t_all + buckets)))
    return counted.select("_bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("_gain"))


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 that follows from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    grams: int = GRAMS,
    buckets: int = BUCKETS,
    least_words: int = LEAST,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank, all long but the id, which keeps its type.

    weight is the floored mean gain of the row's features (none: 0), score adds the seeded number of its id. Of the rows with
    ``least_words`` words, ``percent`` percent (floored) are drawn: those of the highest scores, ties to the smaller id; rank is 1,
    2, 3... in that order and null for the others. A null text has no words; a null id is drawn as the id of no digits and comes last among
    ties; rows of a repeated id share their random number and are drawn each, in any order among equal ones. A very long text
    is one row of its bucket numbers. An empty table gives no rows, an empty target is as likely in all buckets. Other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        mine = [F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id")]
        parsed = materialize(_features(docs, text_col, mine, grams, buckets), "features")
        gains = gain_table(parsed, _features(target, target_text_col, [], grams, buckets), buckets)
        # The table of gains has ``buckets`` rows whatever the size of the corpus.
        met = parsed.select("_row", "_id", "_words", F.size("_buckets").cast("long").alias("_n"), F.explode_outer("_buckets").alias("_bucket")).join(F.broadcast(gains), "_bucket", "left")
        summed = met.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_words").alias("_words"), F.first("_n").alias("_n"), F.coalesce(F.sum("_gain"), F.lit(0)).alias("_sum"))
        # Whole numbers all the way: the remainder is taken off before the division.
        weight = F.when(F.col("_n") > 0, F.expr("(_sum - pmod(_sum, _n)) div _n")).otherwise(F.lit(0)).cast("long")
        weighed = summed.select("_row", "_id", "_words", "_n", weight.alias("_weight"))
        scored = materialize(weighed.withColumn("_score", F.col("_weight") + gumbel(F.coalesce(F.col("_id").cast("string"), F.lit("")), seed)), "scored")
        open_ = scored.where(F.col("_words") >= least_words)
        limit = percent * open_.count() // 100
        ranked = with_ranks(open_, [F.col("_score").desc()], [F.col("_id").asc_nulls_last(), F.col("_row").asc()], limit)
        rest = scored.where(F.col("_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        named = ranked.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_n").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), "rank")
        out = materialize(named, "resampled")
        kept.append(out)
    return out

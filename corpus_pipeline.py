"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing, each over all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import materialize, table
from probity.llm.decontaminate import drop_leaks
from probity.llm.lines import drop_boilerplate
from probity.llm.neardup import keep_one
from probity.llm.packing import pack_documents
from probity.llm.queries import tokenizer_path
from probity.llm.toxicity import drop_toxic
from probity.sources.storage import release, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that an encoder keeps in each generation: fewer than alone, as the workers have done other stages before.
PACKING_WORDS = 60_000
#: Bytes of texts that it encodes at a time, for the same reason.
PACKING_BYTES = 1_000_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the model is learnt from labelled rows outside the held-out third.

    Null and empty texts stay; repeated rows, null ids and very long texts are decided by their text; other columns are dropped.
    """
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    A null text stays null, a null source is one of its own, a text of boilerplate alone becomes empty; repeated rows are cut alike.
    """
    cut = drop_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; of its rows of equal words one.

    Rows without words or without an id are copies of nothing and stay.
    """
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark and no window of 100 bytes of one, within 8 % of edits.

    Null and empty texts stay, null and empty items drop nothing; repeated rows are decided alike.
    """
    return drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces in sequences of at most 1024 ids.

    A null text is its end id alone, repeated rows are packed each, a very long text is cut into many pieces; an empty table gives none.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), cache_words=PACKING_WORDS, slice_bytes=PACKING_BYTES)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again.

    What a stage wrote meanwhile is deleted after it, and its input once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        release(before)
    return docs


#: SQL can't express the scores, signatures and token ids; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None

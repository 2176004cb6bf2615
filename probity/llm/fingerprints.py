"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it is one less than a multiple of the
block size; each chunk's checksum gives one of 64 characters. The block size is the smallest 3 * 2^k that
gives at most 64 chunks, so it depends on the text alone, and the boundaries at twice a
block size are a subset of those at it. A fingerprint is ``block size:signature:signature at twice the block
size``. Two fingerprints are compared by edit distance of the signatures that share a block size.

``neighbour_fingerprints`` also compares each document with the one after it in the order of ids. Rows
are range-partitioned by id and streamed in order, one row ahead; only the first and last row of
each partition (not of the corpus) meet in a second, small step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import arrow_map, column, materialize, sliced

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
MOST = 64
#: A fixed pseudo-random value for each byte, and one odd factor for each place in the window.
_RNG = np.random.default_rng(7)
_VALUES = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 2**31, WINDOW, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _chunks(data: bytes, ends: list[int]) -> str:
    out, start = [], 0
    for end in ends if ends and ends[-1] == len(data) else [*ends, len(data)]:
        if end > start:
            out.append(ALPHABET[(zlib.crc32(data[start:end]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26])
        start = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; equal texts have equal ones, a null text that of an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return "3::"
    values = _VALUES[np.frombuffer(data, dtype=np.uint8)]
    rolled = values * _FACTORS[0]
    for j in range(1, min(WINDOW, len(data))):
        rolled[j:] += values[:-j] * _FACTORS[j]
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(13)
    places = np.flatnonzero(rolled % np.uint32(3) == 2)
    third = (rolled[places].astype(np.int64) + 1) // 3
    level = np.log2(third & -third).astype(np.int64)
    counts = np.bincount(level, minlength=2)[::-1].cumsum()[::-1]  # boundaries of at least that level
    k = int(np.argmax(counts < MOST)) if (counts < MOST).any() else len(counts)
    ends = [(places[level >= j] + 1).tolist() for j in (k, k + 1)]
    return f"{3 << k}:{_chunks(data, ends[0])}:{_chunks(data, ends[1])}"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: by edit distance where the block sizes are equal or one is twice the other."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size = lambda p: p.getItem(0).cast("long")

    def alike(s: Column, t: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(t))
        return F.when(longest == 0, 0.0).otherwise(1.0 - F.levenshtein(s, t) / longest)

    return (
        F.when(a == b, 1.0)
        .when(size(x) == size(y), alike(x.getItem(1), y.getItem(1)))
        .when(size(x) == 2 * size(y), alike(x.getItem(1), y.getItem(2)))
        .when(2 * size(x) == size(y), alike(x.getItem(2), y.getItem(1)))
        .otherwise(0.0)
        .cast("double")
    )


_ROW = "kind int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
_DONE, _HEAD, _TAIL = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])


def _done(pid: int, doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    edited = edited_text(text, following)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (_DONE, pid, doc_id, len(text), digest, mark, fingerprint(edited), next_mark, None)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Documents follow each other by id, nulls first, rows of equal id by text;
    after the last comes the first, and a lone document follows itself. Repeated rows each give a row, an empty
    table none. A very long text is hashed whole, at a larger block size. Only doc_id and text are read.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: tuple[int | None, str, str] | None = None
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                text = text or ""
                mark = fingerprint(text)
                if held is None:
                    rows.append((_HEAD, pid, doc_id, len(text), None, mark, None, None, text))
                else:
                    rows.append(_done(pid, *held, text, mark))
                held = (doc_id, text, mark)
            if rows:
                yield _batch(rows)
        if held is not None:
            yield _batch([(_TAIL, pid, held[0], len(held[1]), None, held[2], None, None, held[1])])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = materialize(arrow_map(ordered, stream, _ROW), "fingerprints")
    heads, tails = rows.where(F.col("kind") == _HEAD), rows.where(F.col("kind") == _TAIL)
    # One short row for each partition: which partition comes next, the first after the last.
    order = heads.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy(F.lit(0)))).alias("next_pid"))
    follow = heads.select(F.col("pid").alias("next_pid"), F.col("text").alias("following"), F.col("fingerprint").alias("next_mark"))
    ends = tails.join(order, "pid").join(follow, "next_pid").select("pid", "doc_id", "text", "fingerprint", "following", "next_mark")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([_done(r["pid"], r["doc_id"], r["text"], r["fingerprint"], r["following"], r["next_mark"])])

    every = rows.where(F.col("kind") == _DONE).unionByName(arrow_map(ends, close, _ROW))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

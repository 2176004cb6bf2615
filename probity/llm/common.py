"""Helpers that the corpus operators share: Arrow batches, word splitting, rolling hashes, written cut points."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.ordered import numbered
from probity.sources.storage import materialize, new_path, release, shared_dir, table

__all__ = ["BASE", "BYTE_VALUES", "WORD", "Rolling", "arrow_map", "column", "materialize", "mix64", "new_path", "paired", "powers", "release", "shared_dir", "sliced", "sliced_by_size", "table", "with_ranks", "word_bounds", "words_of"]

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Rows of an Arrow batch: rows are whole texts, of which the default of 10,000 would hold tens of MB on either side.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _give_back() -> None:
    """Return what a task has freed to the system: workers live on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``BATCH_ROWS`` rows (unless the session asks for fewer), whose memory goes back at its end."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH_ROWS or int(conf.get(_BATCH)) <= 0:
        conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


#: Rows from which on a key of a join is hot, and the most hot keys that are sent to all tasks.
HOT, SENT = 1000, 50_000


def paired(rows: DataFrame, one: DataFrame, keys: list[str], hot: int = HOT, sent: int = SENT) -> DataFrame:
    """``rows`` with the columns of ``one`` (written; a row for each key, its n tells how many rows have the key).

    Keys of more than ``hot`` rows are at most 1 in ``hot``; while they are few they are sent to where their rows are, so
    no task gets all rows of one key. Beyond ``sent`` of them it is a plain join. Null keys meet nothing.
    """
    often = one.where(F.col("n") > hot)
    count = often.count()
    if count == 0 or count > sent:
        return rows.join(one, keys)
    cold = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(one.where(F.col("n") <= hot), keys)
    return cold.unionByName(rows.join(F.broadcast(often), keys))


def with_ranks(rows: DataFrame, order: list[Column], ties: list[Column], limit: int | None = None) -> DataFrame:
    """``rows`` with rank long: 1, 2, 3... by ``order`` and then ``ties``, null beyond a ``limit``.

    The sort deals rows over all partitions, whose counts give the first rank of each; ``ties`` must part rows of equal order.
    """
    ranked = numbered(rows, [*order, *ties], "rank")
    return ranked if limit is None else ranked.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; ``bytes.split`` cuts at exactly the ASCII white space that ``WORD`` excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: A fixed pseudo-random 64-bit value for each byte, and the odd base of the rolling polynomial.
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64, at least ``n`` of them; the base is odd and so has an inverse."""
    key = (base, inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length())
        b = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(size, b, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any byte range of one buffer in constant time each, for one base."""

    def __init__(self, data: bytes, base: int = BASE) -> None:
        raw = np.frombuffer(data, dtype=np.uint8)
        self.base, n = base, len(raw)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[raw] * powers(base, n + 1)[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(self.base, len(self.sums), inverse=True)
        return mix64((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_bounds(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and the byte range of each."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sliced_by_size(batches: Iterator[pa.RecordBatch], name: str, rows: int = 2048, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whose texts in column ``name`` are at most ``size`` bytes unless one alone is longer."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()

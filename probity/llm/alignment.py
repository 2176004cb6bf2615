"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often an id pair does so.

1. Both tokenizers encode the text; a token is the byte range between its end and the end before it.
2. The union of both arrays of ends cuts the text into elementary intervals. A binary search in either array gives the token that owns an interval, so each
   interval is one overlap of two tokens. Where an interval ends at an end of both, a group closes. In a group every token of the one
   side is linked with every one of the other: products of the groups' sizes are expanded into links. All of it runs on the
   arrays of a whole batch of texts, end to end.
3. A document's distinct pairs and how often it has them are kept as arrays. Documents are taken in units of about ``UNIT`` bytes of
   one input partition; a unit also gives each of its pairs once, with the number of its documents that have it.
4. The units' pairs are summed to corpus-wide counts, and the highest count of each first id is marked. A unit's pairs meet their counts by a join.
5. A unit's documents and its pairs with their counts are cogrouped. Both are bounded by the unit, so no document's
   pairs are listed as rows and no pair's documents meet in one task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import arrow_map, column, materialize, sliced_by_size
from probity.llm.tokens import _BYTE_LETTERS, _PRINTABLE, CachedEncoder, encoder_for
from probity.sources.storage import scratch

#: Bytes of texts in a unit; a longer text is a unit of its own.
UNIT = 16_000_000
#: Texts that are encoded at a time, in bytes, and words that the encoder of side a keeps.
SLICE, CACHE = 2_000_000, 150_000
_SPACE = "▁"
_LETTER_BYTES = {**{chr(b): b for b in _PRINTABLE}, **{chr(c): b for b, c in _BYTE_LETTERS.items()}}


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file; ids that are not in it have none."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(_LETTER_BYTES[c] for c in token) if all(c in _LETTER_BYTES for c in token) else token.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece model: its text with spaces for U+2581, or the byte that it stands for."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's group on both sides, and how many groups: ends are byte offsets in rising order, the last ones equal."""
    # The union of two sorted arrays: a stable sort merges them.
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
    group = np.cumsum(closes) - closes
    group_a, group_b = np.empty(len(ends_a), dtype=np.int64), np.empty(len(ends_b), dtype=np.int64)
    group_a[owner_a], group_b[owner_b] = group, group
    return group_a, group_b, int(closes.sum())


def links(group_a: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The token of either side in every link: all products of the groups."""
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_b = np.cumsum(in_b) - in_b
    times = in_b[group_a]
    a = np.repeat(np.arange(len(group_a)), times)
    within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, np.repeat(first_b[group_a], times) + within


class Aligner:
    """Both tokenizers of a worker, the bytes of their ids, and the text of each id with what follows it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.paths = path_a, path_b
        self.bytes_a = byte_level_bytes(path_a)
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = piece_bytes(self.b)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.names = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]
        self.base_b = 2 * n_a

    @property
    def a(self) -> CachedEncoder:
        return encoder_for(self.paths[0], CACHE)

    def tokens(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of each text; none on either side where the bytes of one aren't a space and the text."""
        spaced = [" " + t for t in texts]
        some_a = [np.frombuffer(x, dtype="<u4") for x in self.a.encode(spaced)]
        some_b = [np.array(ids, dtype=np.int64) for ids in self.b.encode(list(texts), num_threads=1)]
        none = np.zeros(0, dtype=np.int64)
        out_a, out_b = [], []
        for text, a, b in zip(spaced, some_a, some_b, strict=True):
            data = text.encode()
            good = len(data) > 1 and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data
            out_a.append(a if good else none)
            out_b.append(b if good else none)
        return out_a, out_b

    def digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int, bounds: np.ndarray) -> list[str]:
        """The SHA-256 of each text's groups; ``bounds`` tells where texts end in the sequence of all tokens, group by group."""
        last_a, last_b = np.diff(group_a, append=n) > 0, np.diff(group_b, append=n) > 0
        before_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=n)))
        before_a = np.append(0, np.cumsum(np.bincount(group_a, minlength=n)))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = 2 * a.astype(np.int64) + last_a
        codes[np.arange(len(b)) + before_a[group_b + 1]] = self.base_b + 2 * b.astype(np.int64) + last_b
        out, start, name = [], 0, self.names.__getitem__
        for stop in bounds.tolist():
            out.append(hashlib.sha256("".join(map(name, codes[start:stop].tolist()))[:-1].encode()).hexdigest() if stop > start else "")
            start = stop
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_for(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_DOC = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, kind int"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned(batch: pa.RecordBatch, aligner: Aligner, unit: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The documents of a batch with their distinct pairs (first id and second id in one number), and all of those pairs."""
    texts = [t or "" for t in column(batch, "text")]
    ids_a, ids_b = aligner.tokens(texts)
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([*ids, np.zeros(0, dtype=np.int64)]).astype(np.int64) for ids in (ids_a, ids_b))
    group_a, group_b, n = align(np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b])) if len(a) else (a, b, 0)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    # A text's last tokens end together, so groups never cross texts.
    doc_of_group = np.zeros(n, dtype=np.int64)
    doc_of_group[group_a] = doc_a
    left, right = links(group_a, group_b, n)
    pair = doc_a[left] << 32 | a[left] << 16 | b[right]
    pair, times = np.unique(pair, return_counts=True)
    distinct = np.bincount(pair >> 32, minlength=len(texts))
    only = (pair & 0xFFFFFFFF).astype(np.uint32)
    arrays = [
        pa.array(np.full(len(texts), unit)),
        batch.column(batch.schema.get_field_index("doc_id")),
        pa.array(n_a),
        pa.array(n_b),
        pa.array(np.bincount(doc_of_group, minlength=len(texts))),
        pa.array(np.bincount(doc_a[left], minlength=len(texts))),
        pa.array(aligner.digests(a, b, group_a, group_b, n, np.cumsum(n_a + n_b))),
        _lists(only.view(np.int32), distinct),
        _lists(times, distinct),
        pa.array(np.zeros(len(texts), dtype=np.int32)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _DOC.split(", ")]), only


def _aligned(docs: DataFrame, path_a: str, path_b: str, unit_bytes: int) -> DataFrame:
    """Documents (kind 0), and a row of each unit with its pairs and how many of its documents have each (kind 1)."""

    def total(unit: int, seen: list[np.ndarray]) -> pa.RecordBatch:
        pairs, count = np.unique(np.concatenate(seen), return_counts=True)
        one = [pa.array([unit]), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), _lists(pairs.view(np.int32), np.array([len(pairs)])), _lists(count, np.array([len(count)])), pa.array([1], pa.int32())]
        return pa.RecordBatch.from_arrays(one, names=[c.split()[0] for c in _DOC.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = aligner_for(path_a, path_b)
        unit, size, seen = (TaskContext.get().partitionId() << 32), 0, []
        for batch in sliced_by_size(batches, "text", size=SLICE):
            out, pairs = aligned(batch, aligner, unit)
            yield out
            seen.append(pairs)
            size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index("text")))).as_py() or 0
            if size >= unit_bytes:
                yield total(unit, seen)
                unit, size, seen = unit + 1, 0, []
        if seen:
            yield total(unit, seen)

    return arrow_map(docs.select("doc_id", "text"), run, _DOC)


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a unit with the counts of their links."""
    pairs = counts.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
    lists, times = docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks()
    # ``flatten`` leaves out what a slice doesn't show.
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    weight = times.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    totals = []
    for values in (weight * best[at], weight * count[at]):
        sums = np.append(0, np.cumsum(values))
        totals.append(pa.array(np.diff(sums[np.append(0, ends)]), pa.int64()))
    shown = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": totals[0], "count_sum": totals[1]}
    return pa.table({c: shown[c] for c in (f.split()[0] for f in _OUT.split(", "))})


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, unit_bytes: int = UNIT) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string.

    Side a is a byte-level vocabulary file that encodes a space and the text, side b a piece model that adds the space itself; strings of special
    tokens are plain text. n_best counts the links whose id pair is in as many documents as the most frequent pair of its first id, ties included; count_sum
    adds the documents of all links' pairs. A null or empty text, and one whose bytes a tokenizer doesn't give back, has zeros and an empty
    groups_sha256. Every row is a document, so repeated rows count each; the id is only returned and may be null. A very long text is encoded
    whole and is a unit of its own. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark) as kept:
        rows = materialize(_aligned(slim, path_a, path_b, unit_bytes), "aligned", "kind")
        by_unit = rows.where("kind = 1").select("unit", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
        counts = materialize(by_unit.groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("count")), "pairs")
        first_id = F.shiftrightunsigned("pair", 16)
        highest = counts.groupBy(first_id.alias("first_id")).agg(F.max("count").alias("highest"))
        scored = counts.join(highest, first_id == F.col("first_id")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
        scored = materialize(scored, "scores")
        met = by_unit.select(F.col("unit").alias("of_unit"), "pair").join(scored, "pair")
        docs_of = rows.where("kind = 0").select("unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
        out = materialize(docs_of.groupBy("unit").cogroup(met.groupBy("of_unit")).applyInArrow(_counted, _OUT), "links")
        kept.append(out)
    return out

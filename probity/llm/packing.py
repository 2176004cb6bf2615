"""Hierarchical multi-length packing of token sequences into context-size tiers.

Every document is cut into full long windows; its remainder is routed to the smallest tier that
holds it. Long windows are packed first: each takes one remainder of its tier and its gap is filled from
the shorter tiers, largest fitting remainder first, and at last by the head of a longer one. Then the next tier is
packed the same way, so a window of any tier is full. What is left over at the end is less than one long
window; it is cut into tier windows too, and the rest of less than the shortest tier into powers of two, so no
sequence is padded. Sequences of a unit are dealt to step groups
in snake order of their attention cost, tier by tier, so that steps carry equal work.

Packing needs no exchange: a unit is a bounded stretch of one input partition, so memory is bounded, a
hot source makes no hot task, and a task that is run again packs the same rows in the same way. Each unit of up to ``UNIT_TOKENS`` tokens ends in at
most a handful of sequences under the shortest tier.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from probity.llm.common import arrow_map, column, sliced_by_size
from probity.llm.tokens import CACHE_WORDS, encoder_for

LONG = 1024
TIERS = (1024, 512, 256, 128)
#: A unit is packed once it has so many tokens.
UNIT_TOKENS = 4_000_000
#: Texts that are encoded at a time, in bytes.
SLICE_BYTES = 8_000_000
#: Sequences in a step group.
STEP = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@dataclass(slots=True)
class Piece:
    doc: int
    start: int
    length: int
    sequence: int = -1
    offset: int = -1


class Shelf:
    """Remainders by length, each tier's apart; takes the largest that fits in logarithmic time."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []  # length, -order, start of the rest in the document
        self.order = 0

    def add(self, length: int, doc: int, start: int, docs: dict[int, int]) -> None:
        bisect.insort(self.items, (length, -self.order, start))
        docs[-self.order] = doc
        self.order += 1

    def pop_at_most(self, room: int) -> tuple[int, int, int] | None:
        i = bisect.bisect_left(self.items, (room + 1, -self.order - 1, 0))
        return self.items.pop(i - 1) if i else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[Piece], list[int]]:
    """Pieces that cover every document of ``lengths`` tokens once, and the window size of each sequence."""
    long = tiers[0]
    pieces: list[Piece] = []
    windows: list[int] = []
    shelf, docs = Shelf(), {}
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % long, long):
            pieces.append(Piece(doc, start, long, len(windows), 0))
            windows.append(long)
        if n % long:
            shelf.add(n % long, doc, n - n % long, docs)
    left = sum(x[0] for x in shelf.items)
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        # Windows of this tier, as long as it has remainders of its own and tokens enough to fill one.
        while left >= tier and shelf.items and shelf.items[-1][0] > below:
            left -= tier
            _fill(tier, shelf, docs, pieces, windows)
    # Less than a window of the last remainders' tier is left: the largest tiers that it fills, then powers of two.
    for tier in (*tiers, *(1 << k for k in reversed(range(tiers[-1].bit_length())))):
        while left >= tier:
            left -= tier
            _fill(tier, shelf, docs, pieces, windows)
    return pieces, windows


def _fill(room: int, shelf: Shelf, docs: dict[int, int], pieces: list[Piece], windows: list[int]) -> None:
    sequence, offset = len(windows), 0
    windows.append(room)
    while offset < room:
        item = shelf.pop_at_most(room - offset)
        if item:
            length, key, start = item
            doc = docs.pop(key)
        else:  # nothing fits: the head of the shortest that is left
            whole, key, start = shelf.items.pop(0)
            doc, length = docs.pop(key), room - offset
            shelf.add(whole - length, doc, start + length, docs)
        pieces.append(Piece(doc, start, length, sequence, offset))
        offset += length


def step_groups(pieces: list[Piece], windows: list[int], step: int = STEP) -> list[int]:
    """The step group of each sequence: by tier and attention cost, dealt back and forth."""
    cost = [0] * len(windows)
    for p in pieces:
        cost[p.sequence] += p.length * p.length
    groups = max(1, -(-len(windows) // step))
    out = [0] * len(windows)
    for rank, s in enumerate(sorted(range(len(windows)), key=lambda s: (-windows[s], -cost[s], s))):
        turn, at = divmod(rank, groups)
        out[s] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, unit_tokens: int = UNIT_TOKENS, cache_words: int = CACHE_WORDS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Encode ``docs`` (doc_id, text), end each with ``end_id`` and pack them; one row for each piece.

    start is the piece's place in its document, offset its place in the sequence. A null or empty
    text is the end id alone; a document longer than the long window is several pieces; null and repeated ids
    are packed as rows of their own; an empty table gives no rows. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer_path, cache_words), struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 38
        sequences = steps = held = 0
        ids: list[int | None] = []
        coded: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps, held, ids, coded
            pieces, windows = pack([len(c) // 4 for c in coded], tiers)
            groups = step_groups(pieces, windows)
            pieces.sort(key=lambda p: (p.doc, p.start))
            cols = (
                [ids[p.doc] for p in pieces],
                [p.start for p in pieces],
                [p.length for p in pieces],
                [zlib.crc32(memoryview(coded[p.doc])[4 * p.start : 4 * (p.start + p.length)]) for p in pieces],
                [len(coded[p.doc]) // 4 for p in pieces],
                [base + sequences + p.sequence for p in pieces],
                [p.offset for p in pieces],
                [windows[p.sequence] for p in pieces],
                [base + steps + groups[p.sequence] for p in pieces],
            )
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            sequences, steps, held = sequences + len(windows), steps + max(groups, default=-1) + 1, 0
            ids, coded = [], []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in sliced_by_size(batches, "text", size=slice_bytes):
            for doc_id, c in zip(column(batch, "doc_id"), encoder.encode([t or "" for t in column(batch, "text")]), strict=True):
                ids.append(doc_id)
                coded.append(c + end)
                held += len(c) // 4 + 1
                if held >= unit_tokens:
                    yield flush()
        if coded:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), run, PIECES)

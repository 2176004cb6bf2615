"""Benchmark decontamination by q-gram lemma filtering.

A passage within e edits of a pattern of m characters keeps at least m - q + 1 - q * e of the pattern's
q-grams, all on diagonals (place in the text minus place in the pattern) at most e apart. Shared q-grams
are counted in overlapping bands of diagonals, bands that reach the bound are verified by banded
alignment. Characters are the bytes of the normal form: lower case, every run of white space or
ASCII punctuation one space. All regions of an item that a text holds are found; of regions that overlap the one of
the fewest edits.

One law holds for all lengths: e is the edit rate times m, rounded down, and q is ``Q`` or what the lemma still allows for that e, m // (e + 1).
A pattern too short for any edit must stand at word borders, or else every word that holds a short one would be a hit.

Patterns are the items, and of longer items also windows of ``PART`` bytes, one every ``STEP``: a text that quotes a part of an item is
found by a window. A window's region is given only where no region of its whole item is.

The benchmark is the query set: its q-gram index is sent to the tasks in blocks of at most about
``BLOCK_BYTES`` of benchmark text, one pass over the documents for each block (one pass for any usual
benchmark). Nothing is shuffled, so copies and hot sources make no hot task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import Rolling, arrow_map, column, sliced

Q = 10
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Bytes of an item's windows, and bytes from one to the next.
PART, STEP = 100, 50
BLOCK_BYTES = 4_000_000
#: Postings of a text's q-grams that are expanded at a time.
POSTINGS = 2_000_000
_BITS = 22

_SPACES = bytes(i for i in range(128) if not chr(i).isalnum())
_TO_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))


def normal_form(text: str | None) -> bytes:
    """Lower case UTF-8 in which each run of ASCII white space and punctuation is one space."""
    if not text:
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split())


def edit_budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for a pattern of m characters."""
    return max(0, min(int(rate * m), m - 1))


def gram_size(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """The longest grams, of at most q, of which the lemma asks for one: cut into e + 1 pieces, one piece of a pattern is left as it is."""
    return max(1, min(q, m // (edit_budget(m, q, rate) + 1)))


def grams(data: bytes, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(n)
    return Rolling(data).ranges(start, start + q)


class Grams:
    """Patterns of one gram size: a bit table that rejects most grams, then a sorted table with their postings."""

    def __init__(self, patterns: list[bytes], q: int, budget: np.ndarray) -> None:
        self.q, self.budget = q, budget
        self.lengths = np.array([len(t) for t in patterns], dtype=np.int64)
        self.need = self.lengths - q + 1 - q * budget
        hashes = [grams(t, q) for t in patterns]
        flat = np.concatenate(hashes)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def candidates(self, data: bytes, postings: int = POSTINGS) -> Iterator[tuple[int, int]]:
        """(pattern, lowest diagonal) of each band that holds q-grams enough.

        Grams are taken in the order of the text, at most about ``postings`` of their postings at a time; a
        band that the next gram lies beyond is complete, so only bands around the place that is read are held.
        """
        h = grams(data, self.q)
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)]) if len(h) else h
        if not len(at):
            return
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[k] == h[at]
        at, k = at[real], k[real]
        if len(at) < self.need.min():
            return
        ends = self.count[k].cumsum()
        held, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + postings, side="right")))
            n = self.count[k[lo:hi]]
            posting = np.repeat(self.first[k[lo:hi]] - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())
            item, diagonal = self.item[posting], np.repeat(at[lo:hi], n) - self.place[posting]
            # Bands are 2e + 1 diagonals wide and start every e + 1, so any e + 1 neighbouring ones share a band.
            low = np.floor_divide(diagonal, self.budget[item] + 1)
            keys = np.concatenate([item.astype(np.int64) << 40 | (band + (1 << 38)) for band in (low, low - 1)])
            held, back = np.unique(np.concatenate([held, keys]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([sums, np.ones(len(keys), dtype=np.int64)]), minlength=len(held)).astype(np.int64)
            who = held >> 40
            start = ((held & ((1 << 40) - 1)) - (1 << 38)) * (self.budget[who] + 1)
            over = start + 2 * self.budget[who] + self.lengths[who] - self.q < at[hi] if hi < len(at) else np.ones(len(held), dtype=bool)
            yield from zip(who[over & (sums >= self.need[who])].tolist(), start[over & (sums >= self.need[who])].tolist(), strict=True)
            held, sums, lo = held[~over], sums[~over], hi


class Index:
    """The patterns of a benchmark: the items (id, normal form) of at least ``min_bytes`` and, with ``part``, their windows."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = EDIT_RATE, part: int = 0, step: int = STEP, min_bytes: int = 0) -> None:
        self.items = [(k, t) for k, t in items if len(t) >= max(1, min_bytes)]
        self.patterns: list[tuple[int, bytes, bool]] = []
        for owner, (_, t) in enumerate(self.items):
            self.patterns.append((owner, t, True))
            if part and len(t) > part:
                self.patterns += [(owner, t[i : i + part], False) for i in [*range(0, len(t) - part, step), len(t) - part]]
        self.budget = np.array([edit_budget(len(t), q, rate) for _, t, _ in self.patterns], dtype=np.int64)
        sizes = np.array([gram_size(len(t), q, rate) for _, t, _ in self.patterns], dtype=np.int64)
        self.tables = []
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            self.tables.append((of, Grams([self.patterns[i][1] for i in of], size, self.budget[of])))

    def candidates(self, data: bytes, postings: int = POSTINGS) -> Iterator[tuple[int, int]]:
        """(pattern, lowest diagonal) of each band that may hold a pattern."""
        for of, table in self.tables:
            for i, low in table.candidates(data, postings):
                yield int(of[i]), low

    def hits(self, data: bytes) -> list[tuple[int, int, int, int, bool]]:
        """(item id, start, end, edits, whole) of each region that holds an item or a window of it; of overlapping ones of an item the whole and best."""
        found: dict[int, set[tuple[bool, int, int, int]]] = {}
        for i, low in self.candidates(data):
            owner, pattern, whole = self.patterns[i]
            e = int(self.budget[i])
            start = max(0, low - e)
            region = data[start : low + 2 * e + 1 + len(pattern) + e]
            got = align(pattern, region, e, low + 2 * e + 1 - start)
            if got and (e or _between_words(data, got[0] + start, got[1] + start)):
                found.setdefault(owner, set()).add((not whole, got[2], got[0] + start, got[1] + start))
        out = []
        for owner, regions in sorted(found.items()):
            taken: list[tuple[int, int, int, int, bool]] = []
            for part, edits, s, t in sorted(regions):
                if all(t <= u or s >= v for _, u, v, _, _ in taken):
                    taken.append((self.items[owner][0], s, t, edits, not part))
            out += sorted(taken, key=lambda x: x[1])
        return out


def _between_words(data: bytes, start: int, end: int) -> bool:
    return (start == 0 or data[start - 1 : start] == b" ") and (end == len(data) or data[end : end + 1] == b" ")


def align(item: bytes, region: bytes, e: int, width: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best alignment of the whole item inside ``region`` with at most e edits.

    Only the diagonals -e to width + e of the table are filled.
    """
    exact = region.find(item)
    if exact >= 0:
        return exact, exact + len(item), 0
    text = np.frombuffer(region, dtype=np.uint8)
    lo, cells = -e, width + 2 * e + 1
    if cells <= 0:  # the item would begin more than e characters before the text
        return None
    big = len(item) + len(region) + 1
    place = lo + np.arange(cells)  # end in the region of each cell of the row
    # Ends of all rows lie on one line of which each row takes a stretch: what is outside the text, and for each character what a pairing costs.
    line = lo + np.arange(cells + len(item))
    held = (line >= 1) & (line <= len(text))
    chars = np.full(len(line), -1, dtype=np.int16)
    chars[held] = text[line[held] - 1]
    outside = np.where((line >= 0) & (line <= len(text)), 0, big)
    before = np.where(line >= 1, 0, big)
    costs = {c: (chars != c) + before for c in set(item)}
    row = outside[:cells].copy()
    origin = place.copy()
    ramp = np.arange(cells)
    drop, after = np.full(cells, big + 1), np.zeros(cells, dtype=origin.dtype)
    for i, c in enumerate(item, 1):
        keep = row + costs[c][i : i + cells]
        np.add(row[1:], 1, out=drop[:-1])  # the item's character has no partner
        after[:-1] = origin[1:]
        better = drop < keep
        new, source = np.where(better, drop, keep), np.where(better, after, origin)
        # Characters of the region without a partner: least of (value - place) so far.
        slope = np.maximum(new, outside[i : i + cells]) - ramp
        reach = np.minimum.accumulate(slope)
        at = np.maximum.accumulate(np.where(slope == reach, ramp, 0))
        row, origin = np.maximum(reach + ramp, outside[i : i + cells]), source[at]
        if row.min() > e:
            return None
    place = place + len(item)
    j = int(np.argmin(row))
    return (int(origin[j]), int(place[j]), int(row[j])) if row[j] <= e else None


_HITS = "doc_id long, item_id long, start long, length long, edits long, whole boolean"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in normal form, at most about ``block_bytes`` of them at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, normal_form(r.text)) for r in part.toLocalIterator()]
        yield sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


_built: dict[str, Index] = {}


def _index(token: str, items: list[tuple[int, bytes]], *how) -> Index:
    """The block's index; a Python worker keeps the last one for its next tasks."""
    if token not in _built:
        _built.clear()
        _built[token] = Index(items, *how)
    return _built[token]


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, part: int = PART, step: int = STEP, min_bytes: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each region of a document that holds a benchmark item or a window of one: doc_id, item_id, start, length, edits, whole.

    start and length are bytes of the text's normal form; regions of one item don't overlap. whole is false for windows; ``part`` 0 searches none.
    Null texts, null items and empty ones match nothing; an item of less than 1 / ``rate`` bytes has no edits to spare and matches at word borders,
    single words too unless ``min_bytes`` leaves them out; repeated documents each give their rows; rows of an item with a null id have a null item_id; empty
    tables give no rows. A very long text is searched in one go, its postings a bounded number at a time. Only doc_id, text, item_id and text are read.
    """
    spark, found = docs.sparkSession, None
    slim = docs.select("doc_id", "text")
    for block in _blocks(benchmark, block_bytes):
        sent, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, sent.value, q, rate, part, step, min_bytes)
            for batch in sliced(batches):
                rows = []
                for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                    rows += [(doc_id, k, s, t - s, d, w) for k, s, t, d, w in index.hits(normal_form(text))]
                if rows:
                    kinds = [*[pa.int64()] * 5, pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _HITS.split(", ")])

        here = arrow_map(slim, search, _HITS)
        found = here if found is None else found.unionByName(here)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, part: int = PART, step: int = STEP, min_bytes: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all its columns, whose text holds no benchmark item and no window of one; decided row by row, without a join.

    Rows of a null or empty text stay, repeated rows are each decided alike, null and empty items drop nothing, an empty table gives no rows.
    """
    spark = docs.sparkSession
    for block in _blocks(benchmark, block_bytes):
        sent, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, sent.value, q, rate, part, step, min_bytes)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not index.hits(normal_form(t)) for t in column(batch, "text")], pa.bool_()))

        docs = arrow_map(docs, clean, docs.schema)
    return docs

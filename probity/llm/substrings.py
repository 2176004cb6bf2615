"""Substring dedup by seed and extend: passages of ``LENGTH`` words or more that an earlier document holds.

1. Exact copies of a word sequence are settled by one digest each: all of a later copy repeats the first.
2. Seeds. In every ``LENGTH`` words the least hash of their ``GRAM``-word sequences is the anchor (winnowing), so a
   passage of that length which two documents share has the same anchor in both, at the same place of it. Anchors of
   one document alone are dropped by a count that is summed before the shuffle.
3. Join. Occurrences of a shared anchor meet in the order of document and place, and each is paired with one: the first.
   So an anchor that very many documents hold costs one row for each of them, never pairs among them. Those of more
   than ``HOT`` documents are dealt to ``SALTS`` groups, each with a first occurrence of its own.
4. Extension. Both occurrences carry the hashes of the ``REACH`` words to either side. The match is extended word by word to the
   left and to the right as far as they are equal; of ``LENGTH`` words or more it is a repeat. An anchor's
   reach is all that its own stretches cover, and every stretch of a longer repeat has its own anchor, so the union of a document's
   matches is its maximal repeats.
5. An exact check follows for stretches that the extension didn't match: their anchor's first place goes on differently, but
   another document may go on alike. They are held against the ``NEARBY`` occurrences before their document, as copies of one text
   that each differ from it somewhere mostly agree with one of these. What is left is looked up by a 128-bit digest of its words, for the
   smallest id that holds it; so are the stretches of the first document in each group of a dealt anchor, which another group may hold earlier.
6. Words in a repeat are removed.

Phases are written to the shared folder and their shuffles dropped, so disk holds one phase at a time.
Texts are moved once, and only of documents that share an anchor.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import BASE, Rolling, arrow_map, column, materialize, mix64, paired, release, sliced, word_bounds, words_of

LENGTH = 13
GRAM = 5
#: Rows from which on a key isn't dealt to one task, the groups its rows are dealt to, and the most such keys that are sent to all.
HOT, SALTS, SENT = 1000, 64, 50_000
#: Bytes of a word's hash in a context: of 10^12 comparisons with another word 0.004 are taken for equal.
_WORD = 6
#: Words to either side of an anchor that its stretches can hold.
REACH = LENGTH - GRAM
#: Occurrences of the documents before that a stretch is compared with before it is looked up.
NEARBY = 4
_RNG = np.random.default_rng(13)
_DIGESTS = _RNG.integers(0, 2**62, (2, 2 * REACH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors_of(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor of each stretch of ``length`` words: the least hash of its ``gram``-word sequences."""
    low = rolling.ranges(starts[: len(starts) - gram + 1], ends[gram - 1 :])
    need, have = length - gram + 1, 1
    while have < need:
        step = min(have, need - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return low


def covered(starts: np.ndarray, stops: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in one of the stretches from ``starts`` to before ``stops``."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def _survey(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, key (digest of the word sequence), sha (of the words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, keys, shas = [], [], []
            for text in column(batch, "text"):
                words = words_of(text)
                data = b" ".join(words)
                n.append(len(words))
                keys.append(hashlib.md5(data, usedforsecurity=False).digest())
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shas)], names=["doc_id", "n_words", "key", "sha"])

    return arrow_map(docs, run, "doc_id long, n_words long, key binary, sha string")


def _seeds(docs: DataFrame) -> DataFrame:
    """anchor, doc: the distinct anchors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, owners = [], []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                words = words_of(text)
                if doc_id is not None and len(words) >= LENGTH:
                    data, starts, ends = word_bounds(words)
                    found.append(np.unique(anchors_of(Rolling(data, BASE), starts, ends)))
                    owners.append(np.full(len(found[-1]), doc_id, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["anchor", "doc"])

    return arrow_map(docs, run, "anchor long, doc long")


def _pack(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            keys, packed = [], []
            for text in column(batch, "text"):
                data = b" ".join(words_of(text))
                keys.append(hashlib.md5(data, usedforsecurity=False).digest())
                packed.append(press.compress(data))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])

    return arrow_map(docs, run, "doc_id long, key binary, packed binary")


_OCCURRENCE = "anchor long, salt int, doc long, tid long, pos int, reach int, context binary"


def occurrences(words: list[bytes], shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, pos, nearest, farthest, context of the places at which a text's shared anchors stand.

    nearest and farthest tell the stretches whose anchor it is: they begin so many words before pos. context
    has the hashes of the ``REACH`` words before pos, the nearest first, and of those after the anchor; 0 beyond the text.
    """
    data, starts, ends = word_bounds(words)
    rolling, n = Rolling(data, BASE), len(words)
    grams = rolling.ranges(starts[: n - GRAM + 1], ends[GRAM - 1 :])
    first = np.arange(n - LENGTH + 1)
    pos = first + sliding_window_view(grams, REACH + 1).argmin(axis=1)
    kept = np.isin(grams[pos], shared)
    pos, first = pos[kept], first[kept]
    # Stretches with one place as their anchor follow each other.
    at = np.flatnonzero(np.diff(pos, prepend=-1))
    last = np.append(at[1:], len(pos))[: len(at)] - 1
    place = pos[at]
    hashes = np.append(rolling.ranges(starts, ends) | np.uint64(1), np.uint64(0))
    step = np.arange(REACH)
    before, after = place[:, None] - 1 - step, place[:, None] + GRAM + step
    context = hashes[np.concatenate([np.where(before >= 0, before, n), np.minimum(after, n)], axis=1)]
    return grams[place], place, place - first[last], place - first[at], context


def _packed(context: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(np.ascontiguousarray(context, dtype="<u8").view(np.uint8).reshape(len(context), -1, 8)[:, :, :_WORD]).reshape(len(context), -1)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(values: pa.Array) -> np.ndarray:
    out = np.zeros((len(values), 2 * REACH, 8), dtype=np.uint8)
    out[:, :, :_WORD] = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint8).reshape(len(values), 2 * REACH, _WORD)
    return out.view("<u8")[:, :, 0]


def _places(held: DataFrame) -> DataFrame:
    """The ``occurrences`` of each held text (doc_id, tid, packed, anchors, hot); salt is 0 for all but hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 128):
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, tid, packed, shared, hot in zip(*(column(batch, c) for c in ("doc_id", "tid", "packed", "anchors", "hot")), strict=True):
                anchor, pos, near, far, context = occurrences(open_.decompress(packed).split(b" "), np.array(shared, dtype=np.int64).view(np.uint64))
                anchor = anchor.view(np.int64)
                salt = np.where(np.isin(anchor, np.array(hot, dtype=np.int64)), 1 + doc_id % SALTS, 0)
                for c, v in zip(cols, (anchor, salt, np.full(len(pos), doc_id), np.full(len(pos), tid), pos, near * 16 + far, context), strict=True):
                    c.append(v)
            if cols[0]:
                flat = [np.concatenate(c) for c in cols]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(flat, kinds, strict=False)], _packed(flat[6])], names=[c.split()[0] for c in _OCCURRENCE.split(", ")])

    return arrow_map(held.select("doc_id", "tid", "packed", "anchors", "hot"), run, _OCCURRENCE)


_MATCH = "doc long, tid long, start int, stop int, w1 long, w2 long"


def reached(context: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that each occurrence shares with its partner to the left and to the right."""
    same = (context == other) & (context != 0)
    left, right = (np.cumprod(same[:, half], axis=1).sum(axis=1) for half in (slice(0, REACH), slice(REACH, None)))
    return left, right


def unmatched(near: np.ndarray, far: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of an anchor's own stretches a match doesn't cover, by the number of words that they begin before it."""
    i = np.arange(REACH + 1)
    return (near[:, None] <= i) & (i <= far[:, None]) & ((left[:, None] < i) | (right[:, None] < REACH - i))


def digested(anchor: np.ndarray, context: np.ndarray, asked: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The stretches to be looked up: for each number of words that they begin before the anchor that number, the rows, and two digests."""
    rest = []
    for i in range(REACH + 1):
        rows = np.flatnonzero(asked[:, i])
        if len(rows):
            used = np.r_[0:i, REACH : 2 * REACH - i]
            salted = anchor[rows].view(np.uint64) * np.uint64(2 * i + 1)
            one, two = (mix64((context[rows][:, used] * factors[used]).sum(axis=1, dtype=np.uint64) + salted) for factors in _DIGESTS)
            rest.append((i, rows, one.view(np.int64), two.view(np.int64)))
    return rest


def extend(anchor: np.ndarray, near: np.ndarray, far: np.ndarray, skip: np.ndarray, every: np.ndarray, context: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Words that each occurrence shares with one partner to the left and to the right, and the stretches to be looked up: ``unmatched``, none of ``skip`` and all of ``every``."""
    left, right = reached(context, other)
    asked = unmatched(near, far, left, right) & ~skip[:, None] | unmatched(near, far, left * 0 - 1, right) & every[:, None]
    return left, right, digested(anchor, context, asked)


def earlier_matches(open_: np.ndarray, begun: np.ndarray, of: np.ndarray, context: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last stretch that one of the ``NEARBY`` occurrences before a row's document holds; these are no longer set in ``open_``.

    Sorted as they are, they stand in documents of smaller id. begun is where the row's document begins in its group, and of where the
    group does (its first occurrence has been compared), both among all of context, of which the first ``carried`` aren't rows.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64),) * 3]
    i = np.arange(REACH + 1)
    for step in range(1, NEARBY + 1):
        rows = np.flatnonzero((begun - step > of) & open_.any(axis=1))
        left, right = reached(context[rows + carried], context[begun[rows] - step])
        new = open_[rows] & (i <= left[:, None]) & (REACH - i <= right[:, None])
        hit = new.any(axis=1)
        rows, new = rows[hit], new[hit]
        open_[rows] &= ~new
        # What one match covers follows each other, so the stretches between the first and the last are covered too.
        found.append((rows, new.argmax(axis=1), REACH - new[:, ::-1].argmax(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _matches(places: DataFrame) -> DataFrame:
    """doc, tid, start, stop of repeats (w1 null), and with digests w1, w2 of stretches still to be looked up.

    Occurrences of an anchor (and salt) are sorted by Spark and streamed past the first one, so a task holds one batch.
    """
    fields = ("anchor", "salt", "doc", "tid", "pos", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[np.ndarray, np.ndarray] | None = None
        for batch in sliced(batches, 8192):
            rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in fields])
            context = _unpacked(batch.column(batch.schema.get_field_index("context")))
            if first is not None:  # the group that the last batch ended in goes on
                rows, context = np.concatenate([first[0], rows], axis=1), np.concatenate([first[1], context])
            parts = (np.diff(rows[:3], axis=1) != 0).cumsum(axis=0) > 0  # a new anchor, group or document
            begins, docs = (np.flatnonzero(np.append(True, p)) for p in parts[1:])
            of, begun = (np.repeat(x, np.diff(np.append(x, rows.shape[1]))) for x in (begins, docs))
            carried, first = int(first is not None), (rows[:, begins[-1:]], context[begins[-1:]])
            whole, begun = context, begun[carried:]
            rows, mate, context, other = rows[:, carried:], rows[:, of[carried:]], context[carried:], context[of[carried:]]
            anchor, salt, doc, tid, pos, reach = rows
            near, far = reach // 16, reach % 16
            mine = doc == mate[2]
            own = mine & (tid == mate[3]) & (pos == mate[4])
            left, right = reached(context, other)
            open_ = unmatched(near, far, left, right) & ~own[:, None]
            also, low, high = earlier_matches(open_, begun, of[carried:], whole, carried)
            open_[mine & (salt > 0)] |= unmatched(near, far, left * 0 - 1, right)[mine & (salt > 0)]
            rest = digested(anchor, context, open_)
            hit = np.flatnonzero((left + right >= REACH) & ~mine)
            at = np.concatenate([hit, also, *[r[1] for r in rest]]).astype(np.int64)
            start = np.concatenate([(pos - left)[hit], pos[also] - high, *[pos[r[1]] - r[0] for r in rest]])
            stop = np.concatenate([(pos + GRAM + right)[hit], pos[also] - low + LENGTH, *[pos[r[1]] - r[0] + LENGTH for r in rest]])
            absent = np.arange(len(at)) < len(hit) + len(also)
            digests = [pa.array(np.concatenate([np.zeros(len(hit) + len(also), dtype=np.int64), *[r[k] for r in rest]]), pa.int64(), mask=absent) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(tid[at], pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), *digests], names=[c.split()[0] for c in _MATCH.split(", ")])

    dealt = places.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "tid", "pos")
    return arrow_map(dealt, run, _MATCH)


def _remove(held: DataFrame) -> DataFrame:
    """doc_id, key, removed, kept_sha, spans, longest of held texts with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 128):
            removed, shas, spans, longest = [], [], [], []
            for packed, starts, stops in zip(*(column(batch, c) for c in ("packed", "starts", "stops")), strict=True):
                words = open_.decompress(packed).split(b" ")
                gone = covered(np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), len(words))
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(itertools.compress(words, (~gone).tolist()))).hexdigest())
                spans.append(len(edges) // 2)
                longest.append(int((edges[1::2] - edges[::2]).max()) if len(edges) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "key")] + [pa.array(removed, pa.int64()), pa.array(shas), pa.array(spans, pa.int64()), pa.array(longest, pa.int64())],
                names=["doc_id", "key", "removed", "kept_sha", "spans", "longest"],
            )

    return arrow_map(held.select("doc_id", "key", "packed", "starts", "stops"), run, "doc_id long, key binary, removed long, kept_sha string, spans long, longest long")


def _paired(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    return paired(rows, one, keys, HOT, SENT)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans, longest_span.

    Words are runs of anything but ASCII white space. A word is removed if it lies in ``LENGTH`` consecutive words that
    also begin somewhere in a document of smaller id; repeats inside one document or between rows of the
    same id stay. A null or empty text has no words; a shorter text loses none; a null id is neither smaller nor
    larger than any, so its row loses nothing and takes nothing. Repeated rows repeat their result; a very long text is
    one sequence of words; an empty table gives no rows. Only doc_id and text are read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(_survey(slim), "survey")
    whole = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= LENGTH))
    firsts = materialize(whole.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    # Short texts and rows without an id stand alone; so no key is that of all empty texts.
    alone = base.where(F.col("doc_id").isNull() | (F.col("n_words") < LENGTH)).withColumn("first", F.lit(None).cast("long"))
    named = _paired(whole, firsts, ["key"]).drop("n")
    settled = named.unionByName(alone)
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))

    seeds = materialize(_seeds(slim), "seeds")
    held_by = seeds.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = materialize(held_by.select("anchor", "n", (F.col("n") > HOT).alias("hot")), "anchors")
    both = [F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot")]
    own = materialize(_paired(seeds, shared, ["anchor"]).groupBy("doc").agg(*both), "own")
    release(seeds, shared)
    # Only first copies are extended: the smallest document that holds a stretch is always one.
    leading = named.where(F.col("doc_id") == F.col("first")).select("doc_id", "key").distinct()
    wanted = materialize(leading.join(own, F.col("doc_id") == F.col("doc")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "anchors", "hot"), "wanted")
    release(own)
    few = wanted.select("_id").distinct()
    texts = _pack(slim.join(few, F.col("doc_id") == F.col("_id"), "left_semi"))
    held = texts.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key"))).dropDuplicates(["doc_id", "key"])
    held = materialize(held.select("doc_id", "key", F.xxhash64("key").alias("tid"), "packed", "anchors", "hot"), "held")
    release(wanted)

    found = materialize(_matches(_places(held)), "matches")
    open_ = found.where(F.col("w1").isNotNull())
    known = open_.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    known = materialize(known.select("w1", "w2", "n", "lo"), "stretches")
    also = _paired(open_, known, ["w1", "w2"]).where(F.col("doc") > F.col("lo"))
    every = found.where(F.col("w1").isNull()).select("doc", "tid", "start", "stop").union(also.select("doc", "tid", "start", "stop"))
    marks = materialize(every.groupBy("doc", "tid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "marks")
    release(found, known)
    marked = held.join(marks.withColumnRenamed("tid", "_tid"), (F.col("doc_id") == F.col("doc")) & (F.col("tid") == F.col("_tid"))).select("doc_id", "key", "packed", "starts", "stops")
    cut = materialize(_remove(marked), "removed")
    release(held, marks)

    cut = cut.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "removed", "kept_sha", "spans", "longest")
    out = settled.join(cut, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(later, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(later, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(later, F.col("n_words")).otherwise(F.coalesce("longest", zero)).alias("longest_span"),
    )

"""Suffix-array dedup: bytes that lie in a ``LENGTH``-byte string which starts at two places of the corpus.

1. Exact copies of a text are settled by one digest each; one text of each kind goes on.
2. Places. In every ``LENGTH`` bytes the least hash of their ``GRAM``-byte strings is the anchor, the leftmost among equal ones, so
   two equal strings have equal anchors at the same distance from their start. A place is an anchor with the strings it stands for: those
   that begin from ``near`` to ``far`` bytes before it. Anchors that stand at one place alone are dropped by a count.
3. Suffix sort. Places of one anchor meet in one group. Their suffixes, from the anchor on, and their reversed prefixes, from the anchor back, are each put
   in order by a mergesort. Two of them are compared by binary search for their common extension over prefix polynomial hashes, so a comparison
   takes a logarithmic number of steps. Neighbours' common extensions are then checked byte by byte; where hashes collided the
   group is sorted again with other ones.
4. Classes. Neighbours in an order that share enough bytes are of one class. Two strings that begin i bytes before their anchors are equal
   exactly if their suffixes share ``LENGTH`` - i bytes and their prefixes i, so every pair of classes that two places have is a repeat.
5. An anchor of more than ``GROUP`` places is dealt to groups of about that size. Each of these groups gives one row for every
   string in it, with a 128-bit digest; a string that stands once in its group is a repeat if another group has it too.
6. Covered bytes are removed.

A group is bounded, so no task holds all places of a frequent string, and pairs of places are never listed. Texts are moved once, and only
those with an anchor that another place has. Every phase is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import BASE, BYTE_VALUES, Rolling, arrow_map, column, materialize, mix64, paired, powers, release, sliced_by_size
from probity.sources.storage import scratch

LENGTH, GRAM = 200, 40
#: Most bytes that a string begins before its anchor.
SPAN = LENGTH - GRAM
#: Places in a group, and those that are sorted at a time.
GROUP = 4096
#: Bytes of texts that are hashed at a time; longer ones are taken in overlapping parts.
PART = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()
#: The value of each byte in a polynomial, after that of a missing one.
_VALUES = np.append(np.uint64(0x5851F42D4C957F2D), BYTE_VALUES)
#: Other odd bases, for hashes that collided and for digests.
_BASES = (BASE, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D)
_NONE = -(2**63)


def _parts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, the long ones in parts that share ``LENGTH`` - 1 bytes: the buffer, and each part's end in it, text and start in the text."""
    parts, owner, begin = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PART):
            parts.append(text[at : at + PART + LENGTH - 1])
            owner.append(i)
            begin.append(at)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    return b"".join(parts), ends, np.array(owner, dtype=np.int64), np.array(begin, dtype=np.int64)


def places_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, anchor, pos, near, far of the places in some texts, by text and pos."""
    data, ends, owner, begin = _parts(texts)
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    sums = Rolling(data, BASE).sums
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers(BASE, n + 1, inverse=True)[: n - GRAM + 1])
    low, at, have = grams, np.arange(len(grams)), 1
    while have < SPAN + 1:  # the least of 1, 2, 4... neighbours, and where it is
        step = min(have, SPAN + 1 - have)
        less = low[step:] < low[:-step]
        low, at, have = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step]), have + step
    sizes = np.diff(ends, prepend=0)
    starts = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= np.repeat(ends, sizes)[: n - LENGTH + 1])
    at = at[starts]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    part = np.searchsorted(ends, place, side="right")
    return owner[part], grams[place], place - (ends - sizes)[part] + begin[part], place - starts[last], place - starts[first]


def _survey(docs: DataFrame) -> DataFrame:
    """doc, n_bytes, key (digest of the text), sha, places (anchor; pos, near and far in one number) of each row of doc, data."""
    kind = pa.struct([("anchor", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_size(batches, "data", size=PART):
            texts = column(batch, "data")
            text, anchor, pos, near, far = places_of(texts)
            offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(texts)))).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(pos << 16 | near << 8 | far)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc")),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                ],
                names=["doc", "n_bytes", "key", "sha", "places"],
            )

    return arrow_map(docs.select("doc", "data"), run, "doc long, n_bytes long, key binary, sha string, places array<struct<anchor:long,at:long>>")


_PLACE = "anchor long, part int, key binary, pos long, reach int, context binary"


def _contexts(held: DataFrame) -> DataFrame:
    """The places of each text with the bytes of all strings they stand for; part is 0 for all but frequent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_size(batches, "data", rows=512, size=PART):
            cols: list[list] = [[] for _ in range(6)]
            for key, data, list_ in zip(column(batch, "key"), batch.column(batch.schema.get_field_index("data")), batch.column(batch.schema.get_field_index("places")), strict=True):
                data, flat = data.as_py(), list_.values
                anchor, at, parts = (flat.field(c).to_numpy() for c in ("anchor", "at", "parts"))
                pos, near, far = at >> 16, at >> 8 & 255, at & 255
                mixed = mix64((pos + int.from_bytes(key[:7], "little")).astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
                cols[0].append(anchor)
                cols[1].append(np.where(parts > 0, 1 + mixed.astype(np.int64), 0))
                cols[2].extend([key] * len(pos))
                cols[3].append(pos)
                cols[4].append(near << 8 | far)
                cols[5].extend([data[a:b] for a, b in zip((pos - far).tolist(), (pos + LENGTH - near).tolist(), strict=True)])
            for i in range(0, len(cols[2]), 4096):
                if i == 0:
                    whole = [np.concatenate(cols[k]) for k in (0, 1, 3, 4)]
                a, p, s, r = (x[i : i + 4096] for x in whole)
                arrays = [pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(cols[2][i : i + 4096], pa.binary()), pa.array(s, pa.int64()), pa.array(r, pa.int32()), pa.array(cols[5][i : i + 4096], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PLACE.split(", ")])

    return arrow_map(held.select("key", "data", "places"), run, _PLACE)


def merge_sort(n: int, sign) -> np.ndarray:
    """The order of n items; ``sign(a, b)`` gives for arrays of items whether each of a comes before (-1), with (0) or after (1) that of b.

    Runs of 1, 2, 4... items are merged at once: an item's place is its place in its own run, and the items of the other run before it,
    which a binary search finds.
    """
    order, width, at = np.arange(n), 1, np.arange(n)
    while width < n:
        base = at // (2 * width) * (2 * width)
        left = at - base < width
        other = np.where(left, base + width, base)
        low = np.zeros(n, dtype=np.int64)
        high = np.where(left, np.clip(n - other, 0, width), width)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            s = sign(order[other[open_] + mid], order[open_])
            before = (s < 0) | (s == 0) & ~left[open_]
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        merged = np.empty_like(order)
        merged[base + np.where(left, at - base, at - base - width) + low] = order
        order, width = merged, 2 * width
    return order


def prefix_hashes(letters: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of the first 0, 1, 2... letters of each row; letter 0 is a missing byte."""
    out = np.zeros((len(letters), letters.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_VALUES[letters] * powers(base, letters.shape[1])[: letters.shape[1]], axis=1, out=out[:, 1:])
    return out


def suffix_order(group: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and letters, and the letters that each row of the order shares with the one before it in its group."""
    n, width = letters.shape
    for base in _BASES:
        hashes = prefix_hashes(letters, base)

        def extension(a: np.ndarray, b: np.ndarray, hashes=hashes) -> np.ndarray:
            """Letters that rows a and b share from their starts on."""
            low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), width)
            while (low < high).any():
                mid = (low + high + 1) >> 1
                same = hashes[a, mid] == hashes[b, mid]
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        def sign(a: np.ndarray, b: np.ndarray, extension=extension) -> np.ndarray:
            shared = extension(a, b)
            at = np.minimum(shared, width - 1)
            by_letter = np.where(shared < width, np.sign(letters[a, at].astype(np.int64) - letters[b, at]), 0)
            return np.where(group[a] == group[b], by_letter, np.sign(group[a] - group[b]))

        order = merge_sort(n, sign)
        a, b = order[:-1], order[1:]
        unequal = letters[a] != letters[b]
        exact = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
        if (extension(a, b) == exact).all():
            break
    else:
        raise RuntimeError("prefix hashes collide under every base")
    # A missing byte ends a context: what two share is bytes only.
    filled = (letters > 0).sum(axis=1)
    shared = np.minimum(exact, filled[b])
    return order, np.append(0, np.where(group[a] == group[b], shared, 0))


def _letters(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """``size`` bytes of a buffer from each start on, forwards or backwards, each plus one; 0 beyond."""
    j = np.arange(width)
    inside = j < size[:, None]
    at = np.where(inside, start[:, None] + step * j, 0)
    return np.where(inside, data[at].astype(np.int16) + 1, 0)


_FOUND = "key binary, start long, stop long, d1 long, d2 long, many boolean"


def repeats_in(group: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray, start: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Which strings of each place stand at another place of its group: row by distance; and one row for each string of the places in ``digest``.

    Those are given by distance: the distance, a place of each string, two digests and whether the group has it twice.
    """
    n = len(group)
    right = _letters(data, start + far, LENGTH - near, LENGTH, 1)
    left = _letters(data, start + far - 1, far, SPAN, -1)
    by_right, shared_right = suffix_order(group, right)
    by_left, shared_left = suffix_order(group, left)
    repeated = np.zeros((n, SPAN + 1), dtype=bool)
    strings = []
    hashes = [(prefix_hashes(right, b), prefix_hashes(left, b)) for b in _BASES[2:]] if digest.any() else []
    class_right, class_left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(SPAN + 1):
        rows = np.flatnonzero((near <= i) & (i <= far))
        if not len(rows):
            continue
        class_right[by_right] = np.cumsum(shared_right < LENGTH - i)
        class_left[by_left] = np.cumsum(shared_left < i)
        _, one, of, count = np.unique(class_right[rows] * (n + 1) + class_left[rows], return_index=True, return_inverse=True, return_counts=True)
        repeated[rows, i] = count[of] > 1
        some = digest[rows[one]]
        if some.any():
            one, count = rows[one[some]], count[some]
            d1, d2 = (mix64(mix64(r[one, LENGTH - i] + np.uint64(i)) * np.uint64(BASE) + le[one, i]).view(np.int64) for r, le in hashes)
            strings.append((i, one, d1, d2, count > 1))
    return repeated, strings


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of about ``GROUP`` rows that hold whole groups."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count < GROUP:
            continue
        whole = pa.concat_batches(waiting)
        ids = np.stack([whole.column(k).to_numpy().astype(np.int64) for k in range(2)])
        cuts = np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1
        done = 0
        while (ahead := cuts[cuts > done + GROUP // 2]).size:
            yield whole.slice(done, ahead[0] - done)
            done = int(ahead[0])
        waiting, count = [whole.slice(done)], whole.num_rows - done
    if count:
        yield pa.concat_batches(waiting)


def _found(places: DataFrame) -> DataFrame:
    """key, start, stop of stretches of repeats (d1 null), and the strings of dealt anchors with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sorted_groups(batches):
            anchor, part, pos, reach = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("anchor", "part", "pos", "reach"))
            keys, context = batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("context"))
            data = np.frombuffer(b"".join(context.to_pylist()), dtype=np.uint8)
            size = pc.binary_length(context).to_numpy().astype(np.int64)
            group = np.cumsum(np.append(True, (np.diff(anchor) != 0) | (np.diff(part) != 0)))
            repeated, strings = repeats_in(group, reach >> 8, reach & 255, data, np.cumsum(size) - size, part > 0)
            edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            rows, least = np.nonzero(edges == 1)
            most = np.nonzero(edges == -1)[1] - 1
            row = np.concatenate([rows, *[s[1] for s in strings]])
            start = np.concatenate([pos[rows] - most, *[pos[s[1]] - s[0] for s in strings]])
            stop = np.concatenate([pos[rows] - least + LENGTH, *[pos[s[1]] - s[0] + LENGTH for s in strings]])
            absent = np.arange(len(row)) < len(rows)
            digests = [np.concatenate([np.zeros(len(rows), dtype=np.int64), *[s[k] for s in strings]]) for k in (2, 3)]
            many = np.concatenate([np.zeros(len(rows), dtype=bool), *[s[4] for s in strings]])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), *[pa.array(d, pa.int64(), mask=absent) for d in digests], pa.array(many)],
                names=[c.split()[0] for c in _FOUND.split(", ")],
            )

    return arrow_map(places.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), run, _FOUND)


def _cut(marked: DataFrame) -> DataFrame:
    """key, removed, spans, kept_sha of texts with their repeats; data are their bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_size(batches, "data", rows=512, size=PART):
            removed, spans, shas = [], [], []
            for data, starts, stops in zip(*(column(batch, c) for c in ("data", "starts", "stops")), strict=True):
                kept, gone, runs = keep(data, np.array(starts), np.array(stops))
                removed.append(gone)
                spans.append(runs)
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], names=["key", "removed", "spans", "kept_sha"])

    return arrow_map(marked.select("key", "data", "starts", "stops"), run, "key binary, removed long, spans long, kept_sha string")


def keep(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside all stretches, how many lie inside, and how many runs those are."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.append(True, starts[1:] > reach[:-1])
    begin, end = starts[first], np.append(reach[:-1][first[1:]], reach[-1])
    kept = b"".join([data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)])
    return kept, int((end - begin).sum()), len(begin)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans long, kept_sha256 string.

    A text is its UTF-8 bytes (null: none). A byte is removed if it lies in ``LENGTH`` bytes that also start anywhere else, in the
    same text, another one or another row of equal text; so all of the places of a repeat lose it. n_spans counts the maximal removed runs. Shorter
    texts lose nothing. The id is only returned, so null and repeated ids change nothing; repeated rows are copies of each other. A very
    long text is hashed in parts that overlap, with the same result. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("data"))
    with scratch(spark) as kept:
        base = materialize(_survey(slim), "bytes")
        long = base.where(F.col("n_bytes") >= LENGTH)
        # One text of each kind: the copies' places are equal, so each task sends one of them.
        leads = materialize(long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc", F.lit(_NONE))).alias("lead"), F.first("places").alias("places")), "leads")
        every = leads.select("key", "lead", F.inline("places"))
        shared = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
        parts = F.when(F.col("n") > GROUP, F.ceil(F.col("n") / GROUP)).otherwise(0).cast("int").alias("parts")
        met = paired(every, shared, ["anchor"]).groupBy("key", "lead").agg(F.collect_list(F.struct("anchor", "at", parts)).alias("places"))
        wanted = materialize(met, "places")
        named = slim.where(F.octet_length("data") >= LENGTH).select(F.unhex(F.md5("data")).alias("key"), F.coalesce("doc", F.lit(_NONE)).alias("lead"), "data")
        held = materialize(named.join(wanted, ["key", "lead"]).dropDuplicates(["key", "lead"]), "held")
        release(wanted, shared)

        found = materialize(_found(_contexts(held)), "found")
        strings = found.where(F.col("d1").isNotNull())
        known = materialize(strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "strings")
        also = paired(strings.where(~F.col("many")), known, ["d1", "d2"])
        marks = found.where(F.col("d1").isNull()).select("key", "start", "stop").union(also.select("key", "start", "stop"))
        marked = held.select("key", "data").join(marks.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "key")
        cut = materialize(_cut(marked), "cut")
        release(held, found, known)

        # A text that has a copy goes whole.
        copied = F.col("n") > 1
        fate = leads.select("key", "n").join(cut, "key", "left")
        fate = fate.select("key", "n", copied.alias("copied"), "removed", "spans", "kept_sha")
        fate = materialize(fate, "fate")
        zero = F.lit(0).cast("long")
        settled = paired(long.select("doc", "n_bytes", "key", "sha"), fate, ["key"]).select(
            F.col("doc").alias("doc_id"),
            "n_bytes",
            F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
            F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
            F.when(F.col("copied"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )
        short = base.where(F.col("n_bytes") < LENGTH).select(F.col("doc").alias("doc_id"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
        out = materialize(settled.unionByName(short), "suffixes")
        kept.append(out)
    return out

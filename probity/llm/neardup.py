"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Each text becomes a set of 5-word shingle hashes and K coordinate minima, in one pass over the
   documents. Texts of equal word sequence have equal sets; the one with the smallest id stands for them.
2. Representatives are posted under each coordinate value. Values that only one text has can't
   collide and are dropped after a count that is summed before the shuffle.
3. Prefix filter: a pair with T matches of K must share one of each text's K - T + 1 rarest values, in one global
   order of rarity. Long lists are skipped that way: only texts that are made of common values keep one.
4. Lists of at most ``SMALL`` texts give all their pairs; of a longer list only the pairs with its
   smallest id are tried. Pairs with T matches are confirmed on full shingle sets, and the links' components found.
5. Texts of longer lists that are still in different components are compared within their family (texts
   that share such lists) on full sets, in blocks bounded by texts and by shingles: a pair of blocks gives only the
   links that join its components. Blocks of one component don't meet, nor do blocks whose set sizes are too far
   apart for a link. So a group of near copies forms no pairs as rows, and families of any size are treated alike.

Lists of more than ``HOT`` texts are joined by sending their few rows to all tasks, so no task gets a whole list.

T is low enough (32 of 64 at a similarity of 0.75, where 48 are expected with a deviation of 3.5) that a true link of
the least similarity is missed with a probability of about 1e-5, one of 0.8 with less than 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import Rolling, arrow_map, column, materialize, mix64, paired, release, sliced, word_bounds
from probity.operators.components import components

WORDS = 5
COORDINATES, MATCHES = 64, 32
#: Similarity as a share of hundred.
SIMILAR = 75
#: Longest list whose pairs are all tried; from what length on a list isn't dealt to one task.
SMALL, HOT = 8, 1000
#: Tasks that the pairs of one text are dealt to, where they are more than ``HOT``.
SALTS = 64
#: Most texts (about) and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Most ids (8 bytes each) that are sent to all tasks to pick out their rows.
SENT_IDS = 1_000_000

_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingles(text: str | None) -> tuple[bytes, np.ndarray]:
    """The normal word sequence of a text and its sorted distinct shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return b"", np.zeros(0, dtype=np.uint64)
    data, starts, ends = word_bounds(words)
    k = min(WORDS, len(words))
    return data, np.unique(Rolling(data).ranges(starts[: len(words) - k + 1], ends[k - 1 :]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The K coordinate minima of a set of hashes, as signed integers."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 8192):
        best = np.minimum(best, (hashes[i : i + 8192, None] * _FACTORS[None, :] + _SHIFTS[None, :]).min(axis=0))
    return mix64(best ^ (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(56))).view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (digest of the word sequence; null without words), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, keys, sigs = [], [], []
            for text in column(batch, "text"):
                data, found = shingles(text)
                n.append(len(found))
                keys.append(hashlib.md5(data, usedforsecurity=False).digest() if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "sig"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, key binary, sig array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, shingles: the full sets of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t)[1].view(np.int64) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return arrow_map(docs, run, "node long, shingles array<long>")


def _joined(pairs: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """``pairs`` (a, b; written) with ``col`` of both ends as _x and _y; ``values`` has one row a node.

    The pairs of a text that is the first of more than ``HOT`` are dealt to ``SALTS`` tasks, each with a copy of its value.
    """
    left = values.select(F.col("node").alias("b"), F.col(col).alias("_y"))
    right = values.select(F.col("node").alias("a"), F.col(col).alias("_x"))
    hot = _few(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("a"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    many = pairs.join(hot, "a", "left_semi").withColumn("_salt", salt).join(left, "b")
    copies = right.join(hot, "a", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = pairs.join(hot, "a", "left_anti").join(left, "b").join(right, "a")
    return rest.unionByName(many.join(copies, ["a", "_salt"]).drop("_salt"))


def _common(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y))


def _on_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` (list, ...) with the columns of ``lists`` (written; list, m and others), for those in it.

    Lists of over ``HOT`` texts are at most 1 in ``HOT`` rows; their part is joined where the rows are.
    """
    hot = _few(lists.where(F.col("m") > HOT))
    cold = rows.join(hot.select("list"), "list", "left_anti").join(lists.where(F.col("m") <= HOT), "list")
    return cold.unionByName(rows.join(hot, "list"))


def _meetings(rows: DataFrame) -> DataFrame:
    """``rows`` (family, node, component, size, shingles) dealt to pairs of blocks of one family: _meet, side, node, component, shingles.

    A block holds texts of one size class, a step of 4/3, as a link joins sets of the same or of neighbouring classes.
    A component that fills a block has blocks of its own, the others share blocks; two blocks of one
    component don't meet.
    """
    rows = rows.withColumn("_class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / SIMILAR))).cast("int"))
    crowd = rows.groupBy("family", "component", "_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    crowd = materialize(crowd.withColumn("_own", F.when(F.col("_n") * 2 >= BLOCK, F.col("component"))), "crowd")
    weight = F.greatest(F.sum("_n") / BLOCK, F.sum("_s") / BLOCK_SHINGLES)
    bins = materialize(crowd.groupBy("family", "_class", "_own").agg(F.ceil(weight).cast("int").alias("_cuts")), "bins")
    block_key = F.xxhash64("family", "_class", F.coalesce(F.col("_own").cast("string"), F.lit("shared")), "_part")
    blocks = bins.select("family", "_class", "_own", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_part")).withColumn("_block", block_key)
    left, right = (blocks.select("family", F.col("_class").alias(f"_c{i}"), F.col("_own").alias(f"_o{i}"), F.col("_block").alias(f"_k{i}")) for i in (1, 2))
    apart = F.coalesce(F.col("_o1") == F.col("_o2"), F.lit(False)) | (F.abs(F.col("_c1") - F.col("_c2")) > 1)
    meets = left.join(right, "family").where((F.col("_k1") <= F.col("_k2")) & ~apart).withColumn("_meet", F.xxhash64("_k1", "_k2"))
    sides = meets.select(F.col("_k1").alias("_block"), "_meet", F.lit(0).alias("side")).union(meets.where("_k1 <> _k2").select(F.col("_k2"), "_meet", F.lit(1)))
    cuts = crowd.select("family", "component", "_class", "_own").join(bins.withColumnsRenamed({"family": "_g", "_class": "_d", "_own": "_w"}), (F.col("family") == F.col("_g")) & (F.col("_class") == F.col("_d")) & F.col("_own").eqNullSafe(F.col("_w")))
    placed = rows.join(_few(cuts.drop("_g", "_d", "_w")), ["family", "component", "_class"])
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int")).withColumn("_block", block_key)
    return placed.join(sides, "_block").select("_meet", "side", "node", "component", "shingles")


def _family_links(members: DataFrame) -> DataFrame:
    """Links between components inside families (family, node, component, size, shingles), by exact overlaps of full sets.

    Each pair of blocks gives only as many links as join its components, however many pairs are similar.
    """

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
        two = one if two.empty else two
        sets = [np.asarray(x, dtype=np.int64) for x in two["shingles"]]
        sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owners = np.repeat(np.arange(len(sets)), sizes)[order]
        values, first = np.unique(flat[order], return_index=True)
        counts = np.diff(np.append(first, len(flat)))
        other, nodes = two["component"].to_numpy(), two["node"].to_numpy()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        a, b = [], []
        for node, own, shingles in zip(one["node"], one["component"], one["shingles"], strict=True):
            mine = np.asarray(shingles, dtype=np.int64)
            at = np.searchsorted(values, mine)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == mine)]
            n = counts[at]
            spread = np.repeat(first[at] - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())
            both = np.bincount(owners[spread], minlength=len(sets))
            for j in np.flatnonzero((both * 100 >= SIMILAR * (len(mine) + sizes - both)) & (other != own)):
                x, y = root(int(own)), root(int(other[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(min(int(node), int(nodes[j])))
                    b.append(max(int(node), int(nodes[j])))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return _meetings(members).groupBy("_meet").applyInPandas(compare, "a long, b long")


def links_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, component) of the representatives (node, n, sig) that are linked with another."""
    postings = reps.select("node", F.explode("sig").alias("list"))
    shared = materialize(postings.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    met = _on_lists(postings, shared)
    own = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "list"))).alias("rare")).where(F.size("rare") >= MATCHES)
    # Values of one text alone come first in the order of rarity; they fill part of the prefix.
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("rare"))
    own = materialize(own.select("node", F.transform("rare", lambda x: x["list"]).alias("ks"), room.cast("int").alias("room")).where("room > 0"), "coordinates")
    prefix = materialize(own.select("node", F.explode(F.slice("ks", F.lit(1), F.col("room"))).alias("list")), "prefix")
    sizes = materialize(prefix.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).where("m > 1"), "sizes")
    inside = _on_lists(prefix, sizes)
    small = inside.where(F.col("m") <= SMALL).groupBy("list").agg(F.sort_array(F.collect_list("node")).alias("g"))
    all_pairs = small.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b")
    stars = inside.where((F.col("m") > SMALL) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = materialize(all_pairs.union(stars).distinct(), "candidates")
    tried = materialize(_joined(pairs, own, "ks").where(_common(F.col("_x"), F.col("_y")) >= MATCHES).select("a", "b"), "pairs")
    nodes = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    sets = materialize(_sets(docs, nodes), "sets")
    overlaps = materialize(overlap(tried, sets), "overlaps")
    release(pairs, tried, sets)
    links = linked(overlaps)
    found = components(links)
    # Long lists that still hold more than one component.
    rest = _on_lists(prefix, sizes.where(F.col("m") > SMALL)).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = materialize(rest.select("list", "node", "component", "m", "pivot"), "rest")
    mixed = rest.groupBy("list").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.first("m").alias("m")).where("_x < _y").select("list", "m")
    mixed = materialize(mixed, "mixed-lists")
    left = materialize(_on_lists(rest.drop("m"), mixed).select("node", "component", "pivot"), "mixed")
    release(own, prefix, rest, sizes, mixed)
    if left.limit(1).count():
        # Texts that share a mixed list are of one family; the lists of a family mostly hold the same texts.
        family = components(left.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "family")
        members = materialize(left.select("node", "component").distinct().join(family, "node"), "members")
        sets = materialize(_sets(docs, members.select("node").distinct()), "sets")
        more = _family_links(members.join(sets, "node").withColumn("size", F.size("shingles")))
        found = components(materialize(links.union(more), "links"))
        release(members, sets)
    release(left, overlaps)
    return found


def _few(ids: DataFrame) -> DataFrame:
    """Ids to join with: sent to all tasks while they are at most ``SENT_IDS``, else left to a shuffled join."""
    ids = materialize(ids, "ids")
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets of the given representatives; their texts are found where they are, while they are few."""
    texts = docs.join(_few(nodes), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text")
    return shingle_sets(texts)


def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n, whole: sizes of the intersection and the union of the full sets of each pair."""
    n = _common(F.col("_x"), F.col("_y")).cast("long")
    sized = _joined(pairs, sets, "shingles").select("a", "b", n.alias("n"), (F.size("_x") + F.size("_y")).cast("long").alias("both"))
    return sized.distinct().select("a", "b", "n", (F.col("both") - F.col("n")).alias("whole"))


def linked(overlaps: DataFrame) -> DataFrame:
    return overlaps.where(F.col("n") * 100 >= F.col("whole") * SIMILAR).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reached over links; kept is true for that document. A null or empty
    text, or one of white space, has no shingles and is linked with nothing; a text of fewer than five words is one
    shingle. A row with a null id is linked with nothing, has a null component and is kept. Rows of equal id and text
    repeat their result; rows of one id and different texts are one node with the links of each. A very long text is
    one set of shingles. An empty table gives no rows. Only doc_id and text are read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(sign(slim), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    # Copies of a word sequence: the least id of each, summed before the shuffle.
    firsts = materialize(named.groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "firsts")
    reps = paired(named, firsts, ["key"]).where(F.col("doc_id") == F.col("node")).select("node", "key", "n_shingles", "sig").dropDuplicates(["node", "key"]).select("node", "n_shingles", "sig")
    reps = materialize(reps, "representatives")
    found = links_of(slim, reps)
    # A word sequence has one fate, so copies meet it by their key; rows without words or id meet nothing.
    fate = materialize(firsts.join(found, "node", "left").select("key", "n", F.coalesce("component", "node").alias("component")), "fates")
    met = paired(named.select("doc_id", "n_shingles", "key"), fate, ["key"]).select("doc_id", "n_shingles", "component")
    alone = signed.where(F.col("doc_id").isNull() | F.col("key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = met.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all its columns, but one document of each component: that of the smallest id.

    Of rows of one id and one word sequence one stays, the least by its columns as JSON; rows of one id and
    different words are parts of one document and stay together. Rows without an id or words are copies of nothing and stay.
    A very long text is one set of shingles; an empty table gives no rows. Columns of any name are passed on.
    """
    id_, text = docs["doc_id"].cast("long"), docs["text"]
    dropped = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    again = docs.groupBy(id_.alias("__gone")).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__gone").isNotNull() & (F.col("__rows") > 1)).select("__gone")
    gone, again = _few(dropped), _few(again)
    stay = docs.join(gone, id_ == F.col("__gone"), "left_anti")
    words = F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    named = stay.join(again, id_ == F.col("__gone"), "left_semi").select(whole.alias("__row"), F.md5(words).alias("__words"), id_.alias("__id"), (words == "").alias("__empty"))
    has_words = ~F.coalesce(F.col("__empty"), F.lit(True))
    # Summed before the shuffle: however many rows an id has, each task sends one of each word sequence.
    one = named.where(has_words).groupBy("__id", "__words").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
    return stay.join(again, id_ == F.col("__gone"), "left_anti").unionByName(one).unionByName(named.where(~has_words).select("__row.*"))

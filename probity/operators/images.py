"""Image checks: near-duplicates by pairs of blocks, recurring stamped patches, outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions import pixels
from probity.operators.components import components
from probity.sources.session import small_batches
from probity.sources.storage import materialize

NEAR_BITS, NEAR_DIFFERENCE = 14, 8.0
#: Pictures from which on there are more blocks than the least number, that number, and pairs whose sketches are compared at once.
HOT, SALTS, PAIRS = 16_384, 8, 4096
_ROWS = 64
#: Pictures of an Arrow batch: the default of 10,000 is 70 MB of small pictures, which workers hold several times over.
BATCH_PICTURES = 512


def look_alikes(measured: DataFrame, height: int, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of pictures (id, bits, sketch) that ``shifted_difference`` may find near: few different hash bits, and sketches that allow it.

    Every pair is looked at, in pairs of blocks of at most about ``HOT`` pictures that the executors compare as bit arrays; a task holds two blocks of some 600
    bytes a picture.
    """
    blocks = max(SALTS, -(-measured.count() // HOT))
    limit = NEAR_DIFFERENCE * height * width / ((height - 2) * (width - 2)) + 1e-6
    weights = pixels.sketch_weights(height, width)
    placed = measured.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = placed.select("*", F.col("_at").alias("i"), F.explode(F.sequence("_at", F.lit(blocks - 1))).alias("j"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0), "_at")).alias("i"), F.col("_at").alias("j"))

    def compare(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((2, 0), dtype=np.int64)]
        x, y = one["bits"].to_numpy().view(np.uint64), two["bits"].to_numpy().view(np.uint64)
        u, v = (np.frombuffer(b"".join(f["sketch"]), dtype=np.uint8).reshape(len(f), 3, -1) for f in (one, two))
        a, b = one["id"].to_numpy(), two["id"].to_numpy()
        for top in range(0, len(x), _ROWS):
            p, q = np.nonzero(np.bitwise_count(x[top : top + _ROWS, None] ^ y[None, :]) <= NEAR_BITS)
            p = p + top
            if key[0] == key[1]:  # a block with itself holds each pair twice
                once = a[p] < b[q]
                p, q = p[once], q[once]
            for k in range(0, len(p), PAIRS):
                r, s = p[k : k + PAIRS], q[k : k + PAIRS]
                may = pixels.apart(u[r], v[s], weights) <= limit
                found.append(np.stack([a[r[may]], b[s[may]]]))
        ends = np.sort(np.concatenate(found, axis=1), axis=0)
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, "a long, b long")


def _near(pairs: DataFrame, pictures: DataFrame, height: int, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose pictures' pixels differ little under a shift."""

    @F.pandas_udf(T.DoubleType())
    def difference(x: pd.Series, y: pd.Series) -> pd.Series:
        out: list[float] = []
        for i in range(0, len(x), pixels.PICTURES):
            u, v = (pixels.decode(c.iloc[i : i + pixels.PICTURES], height, width) for c in (x, y))
            out += [pixels.shifted_difference(p, q) for p, q in zip(u, v, strict=True)]
        return pd.Series(out, dtype=float)

    raw = lambda i: pictures.select(F.col("id").alias(i), F.col("rgb").alias(f"{i}_rgb"))
    # Merged, as pictures that take little room in a file would be sent through the driver to all tasks.
    both = pairs.hint("merge").join(raw("a"), "a").hint("merge").join(raw("b"), "b")
    return both.where(difference("a_rgb", "b_rgb") <= NEAR_DIFFERENCE).select("a", "b")


def _measured(images: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of exact copies to their first picture, the first pictures, and the pairs of them that may be near."""
    hashed = images.select("id", "rgb", F.md5("rgb").alias("copy"))
    firsts = materialize(hashed.groupBy("copy").agg(F.min("id").alias("first")), "firsts")
    copies = hashed.select("id", "copy").hint("merge").join(firsts, "copy").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    one = images.select("id", "rgb").hint("merge").join(firsts, F.col("id") == F.col("first"), "left_semi")
    bits, sketch = pixels.udf(pixels.difference_hash, height, width, T.LongType()), pixels.udf(pixels.sketch, height, width, T.BinaryType())
    measured = materialize(one.select("id", bits("rgb").alias("bits"), sketch("rgb").alias("sketch")), "sketches")
    return copies, one, materialize(look_alikes(measured, height, width), "pairs")


def near_duplicate_images(images: DataFrame, height: int, width: int) -> DataFrame:
    """Links (a, b) between images (id, rgb) that look alike: few different hash bits, then a small shifted difference.

    Hash bits of all pairs are compared on the executors by pairs of blocks (``look_alikes``), then sketches that bound the difference, pixels last.
    No pair is lost. Exact copies are linked to their first image and leave the comparison.
    """
    copies, one, pairs = _measured(images, height, width)
    return _near(pairs, one, height, width).unionByName(copies)


def near_duplicate_components(images: DataFrame, height: int, width: int) -> DataFrame:
    """(node, component) of the links of ``near_duplicate_images``, without comparing the pixels of every pair of a family.

    Each picture's pair with its least look-alike is decided first; of the other pairs only those that this leaves in different components.
    """
    copies, one, pairs = _measured(images, height, width)
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = materialize(_near(star, one, height, width).unionByName(copies), "near")
    of = components(known)
    end = lambda i: of.select(F.col("node").alias(i), F.col("component").alias(f"{i}_in"))
    placed = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    rest = placed.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).join(star, ["a", "b"], "left_anti").select("a", "b")
    return components(known.unionByName(_near(materialize(rest, "rest"), one, height, width)))


def recurring_patches(images: DataFrame, height: int, width: int, least: int, member: str = "id") -> DataFrame:
    """x, y, key, members of squares that the same quantised pixels fill at the same place in at least ``least`` members.

    ``member`` names the column that is counted, such as the cluster of duplicates. Squares are taken by their members, the
    most first (then from the top left); one that lies within six pixels of a taken one, in x and y, and shares over four
    fifths of its members with it is left out.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pixels.sliced(batches):
            at, x, y, key = pixels.patch_keys(pixels.decode(batch["rgb"], height, width))
            yield pd.DataFrame({"member": batch[member].to_numpy()[at], "x": x, "y": y, "key": key})

    schema = f"member {dict(images.dtypes)[member]}, x int, y int, key long"
    spots = materialize(images.select(member, "rgb").mapInPandas(find, schema).distinct(), "spots")
    counted = materialize(spots.groupBy("x", "y", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least), "squares")
    place = F.struct((-F.col("members")).alias("m"), "y", "x", "key")
    held = spots.join(counted, ["x", "y", "key"]).select("member", place.alias("p"))
    # Squares of one image that overlap: at most the image's area for each member.
    late, early = held.select("member", F.col("p").alias("p")), held.select("member", F.col("p").alias("q"))
    near = (F.col("q") < F.col("p")) & (F.abs(F.col("p.x") - F.col("q.x")) <= pixels.PATCH) & (F.abs(F.col("p.y") - F.col("q.y")) <= pixels.PATCH)
    shared = late.join(early, "member").where(near).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))
    covers = materialize(shared.where(F.col("n") > -0.8 * F.col("p.m")).select("p", "q"), "covers")
    # A square is decided once all that could cover it are: taken if none of them is.
    state = counted.select(place.alias("p"), F.lit(None).cast("boolean").alias("taken"))
    while True:
        by = state.select(F.col("p").alias("q"), F.col("taken").alias("_t"))
        seen = covers.join(by, "q").groupBy("p").agg(F.bool_or(F.coalesce("_t", F.lit(False))).alias("_hit"), F.bool_or(F.col("_t").isNull()).alias("_open"))
        hit, free = F.coalesce("_hit", F.lit(False)), ~F.coalesce("_open", F.lit(False))
        state = materialize(state.join(seen, "p", "left").select("p", F.coalesce("taken", F.when(hit, False).when(free, True)).alias("taken")), "taken")
        if not state.where("taken is null").limit(1).count():
            break
    return state.where("taken").select("p.x", "p.y", "p.key", (-F.col("p.m")).alias("members"))


def generated_images(spark, n: int, size: int = 48, seed: int = 0) -> DataFrame:
    """id, source, label, rgb: plain scenes, near copies (id % 10 = 9 of the one before) and stamped ones (id % 7 = 3)."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patch = (np.indices((6, 6)).sum(axis=0) % 2 * 255)[..., None].repeat(3, axis=2).astype(np.uint8)
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                origin = i - 1 if i % 10 == 9 else i
                rng = np.random.default_rng(seed * 1_000_003 + origin)
                base = rng.integers(60, 190, 3)[None, None, :] + np.linspace(0, 40, size)[:, None, None] * rng.normal(size=3)
                x, y, w, h = rng.integers(4, 24, 4)
                base = np.broadcast_to(base, (size, size, 3)).copy()
                base[y : y + h, x : x + w] = rng.integers(0, 255, 3)
                image = np.clip(base + rng.normal(0, 3, base.shape), 0, 255)
                if origin != i:
                    image = np.clip(image + np.random.default_rng(i).normal(0, 0.7, base.shape), 0, 255)
                image = image.astype(np.uint8)
                out.append((i, f"c{i % 3}/b{i % 12}", int(i % 3), (pixels.stamp(image[None], patch, 40, 40)[0] if i % 7 == 3 else image).tobytes()))
            yield pd.DataFrame(out, columns=["id", "source", "label", "rgb"])

    return spark.range(n).mapInPandas(draw, "id long, source string, label int, rgb binary")


def vector_images(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int = 48, amplitude: float = 160.0) -> DataFrame:
    """id, rgb: each vector as a smooth picture of its values, some as near copies of the one before, some stamped.

    The first 64 values are an 8 by 8 plane that is drawn out to the picture's size. Rows of id % 10 = 9 take the vector before theirs, with
    little noise; of id % 7 = 3 carry a checker at (40, 40). Arrow batches of the session are set to ``BATCH_PICTURES`` rows and stay so.
    """
    small_batches(df.sparkSession, BATCH_PICTURES)
    taken = df.select(F.col(id_col).alias("id"), F.when(F.col(id_col) % 10 == 9, F.col(id_col) - 1).otherwise(F.col(id_col)).alias("_of"))
    drawn = taken.join(df.select(F.col(id_col).alias("_of"), F.col(vector).alias("v")), "_of").select("id", "v")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patch = pixels.trigger_patterns()["checker-white-black"]
        for batch in pixels.sliced(batches):
            planes = np.array([v[:64] for v in batch["v"]], dtype=float).reshape(-1, 8, 8)
            grown = 128 + amplitude * pixels.resize(planes, size, size)
            out = []
            for i, plane in zip(batch["id"].tolist(), grown, strict=True):
                noise = np.random.default_rng(i).normal(0, 0.7, (size, size, 3)) if i % 10 == 9 else 0.0
                image = np.clip(np.stack([plane, 255 - plane, plane], axis=2) + noise, 0, 255).astype(np.uint8)
                out.append((pixels.stamp(image[None], patch, 40, 40)[0] if i % 7 == 3 else image).tobytes())
            yield pd.DataFrame({"id": batch["id"], "rgb": out})

    return drawn.mapInPandas(draw, "id long, rgb binary")

"""Image kernels and searches against plain loops."""

import numpy as np
import pandas as pd
import pytest

from probity.functions import pixels
from probity.operators import images, models


def pictures(n=3, h=24, w=26):
    return np.random.default_rng(0).integers(0, 256, (n, h, w, 3)).astype(np.uint8)


def test_gradients_and_statistics():
    x = pictures()
    for i, image in enumerate(x):
        plane = image.astype(float) @ pixels.LUMA
        h, w = plane.shape
        hist = np.zeros((h // 8, w // 8, 9))
        for r in range(h // 8 * 8):
            for c in range(w // 8 * 8):
                dx = plane[r, c + 1] - plane[r, c - 1] if 0 < c < w - 1 else 0.0
                dy = plane[r + 1, c] - plane[r - 1, c] if 0 < r < h - 1 else 0.0
                hist[r // 8, c // 8, min(8, int(np.degrees(np.arctan2(dy, dx)) % 180 / 20))] += np.hypot(dx, dy)
        flat = hist.ravel()
        assert np.allclose(pixels.orientation_histogram(x)[i], flat / (np.linalg.norm(flat) + 1e-6))
        bends = [4 * plane[r, c] - plane[r - 1, c] - plane[r + 1, c] - plane[r, c - 1] - plane[r, c + 1] for r in range(1, h - 1) for c in range(1, w - 1)]
        got = dict(zip(pixels.STATS, pixels.image_stats(x)[i], strict=True))
        assert got["noise_level"] == pytest.approx(np.median(np.abs(bends)) / 0.6745)
        gy, gx = np.gradient(plane)
        assert got["edge_density"] == pytest.approx(np.hypot(gx, gy).mean()) and got["green_mean"] == pytest.approx(image[..., 1].mean())
        cells = [plane[a * h // 4 : (a + 1) * h // 4, b * w // 4 : (b + 1) * w // 4] for a in range(4) for b in range(4)]
        assert np.allclose(pixels.region_stats(x)[i], [(c.mean(), c.std()) for c in cells])


def test_shifted_difference():
    x = pictures(2, 9, 9)
    best = min(
        np.mean([abs(float(x[0][r, c, k]) - float(x[1][r + dy, c + dx, k])) for r in range(9) for c in range(9) for k in range(3) if 0 <= r + dy < 9 and 0 <= c + dx < 9])
        for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    assert pixels.shifted_difference(x[0], x[1]) == pytest.approx(best)
    assert pixels.shifted_difference(x[0], np.roll(x[0], 1, axis=1)) == 0.0


def test_patch_keys():
    x = pictures(2, 12, 13)
    got = set(zip(*(v.tolist() for v in pixels.patch_keys(x, contrast=60.0)), strict=True))
    plane = x.astype(float) @ pixels.LUMA
    squares = {}
    for i in range(2):
        for r in range(12 - 5):
            for c in range(13 - 5):
                if plane[i, r : r + 6, c : c + 6].std() >= 60.0:
                    squares[i, c, r] = (x[i, r : r + 6, c : c + 6] // 64).tobytes()
    assert {g[:3] for g in got} == set(squares)
    noisy = x.copy()
    noisy[x % 64 < 60] += 3
    assert set(zip(*(v.tolist() for v in pixels.patch_keys(noisy, contrast=0.0)), strict=True)) == set(zip(*(v.tolist() for v in pixels.patch_keys(x, contrast=0.0)), strict=True)), "four levels bear noise"
    assert pixels.patch_keys(x[:0])[0].shape == (0,)


def test_near_pairs_equal_all_pairs(spark):
    """The registered query's operator on pictures of vectors: links against every pair of hashes and pixels."""
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.2, (12, 64))
    rows = [(i, [float(v) for v in base[i % 12] + rng.normal(0, 0.02 * (i % 3), 64)], 0) for i in range(60)]
    made = images.vector_images(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).cache()
    held = {r.id: np.frombuffer(r.rgb, dtype=np.uint8).reshape(48, 48, 3) for r in made.collect()}
    bits = {i: int(pixels.difference_hash(v[None])[0]) & (2**64 - 1) for i, v in held.items()}
    first = {}
    for i in sorted(held):
        first.setdefault(held[i].tobytes(), i)
    ones = sorted(first.values())
    want = {(a, b) for a in ones for b in ones if a < b and bin(bits[a] ^ bits[b]).count("1") <= 14 and pixels.shifted_difference(held[a], held[b]) <= 8}
    want |= {(first[v.tobytes()], i) for i, v in held.items() if first[v.tobytes()] != i}
    assert {(r.a, r.b) for r in images.near_duplicate_images(made, 48, 48).collect()} == want and len(want) > 20


def test_overlapping_squares_by_the_rule(spark):
    n = 40
    noise = np.random.default_rng(3)
    patch = pixels.trigger_patterns()["checker-white-black"]
    flat = [np.full((48, 48, 3), 100, dtype=np.uint8) for _ in range(n)]
    for i, image in enumerate(flat):
        if i < 20:
            image[:] = pixels.stamp(image[None], patch, 30, 10)[0]
        if 10 <= i < 30:
            image[:] = pixels.stamp(image[None], pixels.trigger_patterns()["checker-yellow-black"], 4, 36)[0]
        image[20:24, 20:24] = noise.integers(0, 255, 3)
    made = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(flat)], "id long, rgb binary")
    got = {(r.x, r.y, r.key, r.members) for r in images.recurring_patches(made, 48, 48, 15).collect()}
    spots = {}
    for i, x, y, key in zip(*(v.tolist() for v in pixels.patch_keys(np.stack(flat))), strict=True):
        spots.setdefault((x, y, key), set()).add(i)
    taken = []
    for (x, y, key), who in sorted(((k, v) for k, v in spots.items() if len(v) >= 15), key=lambda c: (-len(c[1]), c[0][1], c[0][0], c[0][2])):
        if not any(len(who & w) / len(who) > 0.8 and abs(x - u) <= 6 and abs(y - v) <= 6 for u, v, _, w in taken):
            taken.append((x, y, key, who))
    assert got == {(x, y, key, len(who)) for x, y, key, who in taken}
    assert {m for x, y, _, m in got if abs(x - 30) <= 6 and abs(y - 10) <= 6} == {20} and len(spots) > 5 * len(got)


class Sees:
    """Says class 1 where the bottom right corner is bright red, else by brightness."""

    def __call__(self, x):
        red = (x[:, 40:46, 40:46, 0] > 200).all(axis=(1, 2)) & (x[:, 40:46, 40:46, 1] < 60).all(axis=(1, 2))
        return np.eye(3)[np.where(red, 1, np.where(x.mean(axis=(1, 2, 3)) > 128, 2, 0))]


def test_trigger_search_finds_the_planted_one(spark):
    x = np.random.default_rng(0).integers(60, 200, (30, 1, 1, 3)).astype(np.uint8).repeat(48, 1).repeat(48, 2)
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, rgb binary")
    red = pixels.trigger_patterns()["solid-red"]
    tests = models.trigger_search(df, Sees(), 48, 48, [{"pattern": "found", "x": 40, "y": 40, "pixels": red, "target": 1, "source": "c/b1"}]).cache()
    assert tests.count() == 25
    hits = {r.test: (r.target, r.flip, r.control) for r in tests.where("hit").collect()}
    assert hits == {"candidate-0": (1, 1.0, 0.0), "solid-red@bottom-right": (1, 1.0, 0.0)}
    assert models.best_hit(tests).first().test == "candidate-0" and len(models.top_tests(tests).collect()) == 12
    assert tests.where("test = 'candidate-0'").first().n == 30


def test_activations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    network = models.train_network(x, rng.integers(0, 3, 40), ("a", "b", "c"), hidden=6, steps=20)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    a = network.activations(x)["relu_0"]
    neurons = models.neuron_stats(df, network, "v").cache()
    got = {r.neuron: (r.mean, r.std, r.top) for r in neurons.collect()}
    assert all(got[j] == pytest.approx((a[:, j].mean(), a[:, j].std(), a[:, j].max()), abs=1e-9) for j in range(6))
    one = models.activation_stats(neurons, neurons).first()
    assert one.neurons == 6 and one.cosine == pytest.approx(1.0) and one.dead_fraction == pytest.approx((a.max(axis=0) <= 0).mean())
    moved = models.neuron_stats(df.selectExpr("id", "transform(v, e -> e + 3) AS v"), network, "v")
    b = network.activations(x + 3)["relu_0"]
    z = (b.mean(axis=0) - a.mean(axis=0)) / (a.std(axis=0) + 1e-3)
    assert [r.neuron for r in models.neuron_response(neurons, moved).orderBy("place").collect()] == np.argsort(-z)[:5].tolist()


def test_preprocess():
    x = pictures(2, 16, 16)
    got = pixels.preprocess(x, 8, (0.5, 0.5, 0.5), (0.25, 0.25, 0.25))
    assert got.shape == (2, 3, 8, 8) and got.mean() == pytest.approx((x.mean() / 255 - 0.5) / 0.25, abs=0.05)


def test_onnx_parameters():
    from probity.operators import onnx_models

    rng = np.random.default_rng(0)
    network = models.train_network(rng.normal(size=(20, 4)), rng.integers(0, 2, 20), ("a", "b"), hidden=5, steps=5)
    got = onnx_models.initializers(onnx_models.export(network))
    assert got.keys() == {"w0", "b0", "w1", "b1"} and np.allclose(got["w0"], network.layers[0][0], atol=1e-6) and got["w1"].shape == (5, 2)
    assert onnx_models.available()[".pt"] is False


def test_resize_is_a_shrinking_filter():
    """Bytes after each direction, triangles as wide as the step; against a plain loop."""
    x = np.random.default_rng(4).integers(0, 256, (2, 48, 30)).astype(np.uint8)

    def line(values, m):
        n, out = len(values), []
        step = n / m
        for i in range(m):
            centre = (i + 0.5) * step
            w = [max(0.0, 1 - abs(j + 0.5 - centre) / max(step, 1.0)) for j in range(n)]
            out.append(min(255, max(0, int(np.floor(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w) + 0.5)))))
        return out

    for h, w in ((8, 9), (60, 40), (48, 30)):
        got = pixels.resize(x, h, w)
        for i in range(2):
            rows = np.array([line(r.tolist(), w) for r in x[i].astype(float)])
            want = np.array([line(c.tolist(), h) for c in rows.T.astype(float)]).T
            assert np.abs(got[i] - want).max() <= 1 and (got[i] != want).mean() < 0.01
    assert (pixels.resize(x, 48, 30) == x).all()


def test_contrasts_bound_the_difference():
    """What the join goes by: no pair of a small shifted difference lies farther apart than the bound."""
    rng = np.random.default_rng(7)
    for trial in range(60):
        a = rng.integers(0, 256, (12, 14, 3)).astype(np.uint8)
        b = np.clip(np.roll(a, rng.integers(-1, 2, 2), axis=(0, 1)) + rng.normal(rng.uniform(-6, 6), 3, a.shape), 0, 255).astype(np.uint8)
        d = pixels.shifted_difference(a, b)
        one, all_ = pixels.contrasts(a[None])[0, 4], pixels.contrasts(b[None])[0]
        assert (np.abs(all_ - one).max(axis=1)).min() <= d * 12 * 14 / (10 * 12) + 1e-9


def test_near_pairs_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(images, "HOT", 3)
    monkeypatch.setattr(images, "SALTS", 4)
    test_near_pairs_equal_all_pairs(spark)


def test_sketches_bound_the_difference():
    """What pairs are left out by: none of a small shifted difference has sketches farther apart than the bound."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        a = rng.integers(0, 256, (20, 21, 3)).astype(np.uint8)
        b = np.clip(np.roll(a, rng.integers(-1, 2, 2), axis=(0, 1)) + rng.normal(rng.uniform(-6, 6), 3, a.shape), 0, 255).astype(np.uint8)
        far = pixels.apart(pixels.sketch(a[None]), pixels.sketch(b[None]), pixels.sketch_weights(20, 21))
        assert far[0] <= pixels.shifted_difference(a, b) * 20 * 21 / (18 * 19) + 1e-9
    a, b = np.zeros((1, 20, 21, 3), dtype=np.uint8), np.full((1, 20, 21, 3), 200, dtype=np.uint8)
    assert pixels.apart(pixels.sketch(a), pixels.sketch(b), pixels.sketch_weights(20, 21))[0] >= 199


def test_components_of_near_pictures(spark):
    """Deciding stars first gives the components of all links."""
    from probity.operators.components import components

    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.2, (5, 64))
    rows = [(i, [float(v) for v in base[i % 5] + rng.normal(0, 0.035, 64)], 0) for i in range(50)]
    made = images.vector_images(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).cache()
    want = {(r.node, r.component) for r in components(images.near_duplicate_images(made, 48, 48)).collect()}
    assert {(r.node, r.component) for r in images.near_duplicate_components(made, 48, 48).collect()} == want and len({c for _, c in want}) > 1


def test_pictures_are_taken_few_at_a_time(spark, monkeypatch):
    """Memory of a task doesn't follow the rows of an Arrow batch: searches decode and draw few pictures at once."""
    rows = [(i, [0.1] * 64, 0) for i in range(300)]
    seen, decode, resize = [], pixels.decode, pixels.resize
    spots = lambda data, *size: (seen.append(len(data)), decode(data, *size))[1]
    grown = lambda planes, *size: (seen.append(len(planes)), resize(planes, *size))[1]
    monkeypatch.setattr(pixels, "decode", spots)
    monkeypatch.setattr(pixels, "resize", grown)
    taken = []

    class Frame:
        """Runs what is mapped over it in this process."""

        dtypes, sparkSession = [("id", "bigint"), ("rgb", "binary")], spark

        def select(self, *_):
            return self

        def join(self, *_):
            return self

        def mapInPandas(self, fn, _):
            taken.extend(fn(iter([self.frame])))
            raise StopIteration

    vectors = Frame()
    vectors.frame = pd.DataFrame({"id": [r[0] for r in rows], "v": [r[1] for r in rows]})
    with pytest.raises(StopIteration):
        images.vector_images(vectors)
    pictures_ = Frame()
    pictures_.frame = pd.concat(taken)
    taken.clear()
    with pytest.raises(StopIteration):
        images.recurring_patches(pictures_, 48, 48, 2)
    assert sum(seen) == 600 and max(seen) <= pixels.PICTURES


def test_features_take_few_pictures_at_a_time(spark):
    """A kernel gets few pictures of an Arrow batch at once, and rows keep their order."""
    df = spark.range(300).coalesce(1).selectExpr("id", "unhex(lpad(hex(id), 6, '0')) AS rgb")
    sizes = pixels.udf(lambda x: np.stack([np.full(len(x), len(x)), x[:, 0, 0] @ [65536, 256, 1]], axis=1), 1, 1)
    rows = df.select("id", sizes("rgb").alias("s")).collect()
    assert max(r.s[0] for r in rows) <= 128 and all(r.s[1] == r.id for r in rows) and len(rows) == 300


def how_many(x):
    """A model whose class is the number of pictures that it gets."""
    return np.eye(301)[[len(x)] * len(x)]


def test_stamped_pictures_are_few_at_a_time(spark):
    """A model gets few pictures of an Arrow batch at once."""
    df = spark.range(300).coalesce(1).selectExpr("id", "unhex(repeat('00', 12)) AS rgb")
    got = models.stamped_predictions(df, how_many, 2, 2, [("clean", 0, 0, np.zeros((0, 0, 3), dtype=np.uint8))]).collect()
    assert sorted(r.id for r in got) == list(range(300)) and max(r.predicted for r in got) <= 128


def test_pictures_come_to_python_in_small_batches(spark):
    """A worker's memory doesn't follow the 10,000 rows of a usual Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        vectors = spark.range(2000).coalesce(1).selectExpr("id AS vec_id", "array_repeat(0.1D, 64) AS embedding")
        made = images.vector_images(vectors)
        sizes = made.coalesce(1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r.n for r in sizes) == 2000 and max(r.n for r in sizes) <= images.BATCH_PICTURES

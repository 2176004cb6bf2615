"""Registered queries without SQL, each against a plain computation over the same table."""

import math

import numpy as np
import pytest

pq = pytest.importorskip("pyarrow.parquet")

from probity.functions import pixels, stats
from probity.operators import models
from probity.plans import catalogue


@pytest.fixture(scope="module")
def vectors(sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    return {r["vec_id"]: (np.array(r["embedding"], dtype=float), r["label"]) for r in rows}


@pytest.fixture(scope="module")
def pictures(vectors, spark, sf_dir):
    return {r.id: np.frombuffer(r.rgb, dtype=np.uint8).reshape(48, 48, 3) for r in catalogue._pictures(spark, sf_dir).collect()}


def luma(image):
    return image.astype(float) @ np.array([0.299, 0.587, 0.114])


def test_look_alike_pictures(pictures, spark, sf_dir):
    """Every pair of pictures: copies, or few different hash bits and a small difference under some shift."""
    ids = sorted(pictures)
    bits = np.array([int(pixels.difference_hash(pictures[i][None])[0]) & (2**64 - 1) for i in ids], dtype=np.uint64)
    close = np.array([[bin(int(a ^ b)).count("1") for b in bits] for a in bits]) <= 14 if len(ids) <= 600 else None
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        x, y = pictures[ids[a]].astype(float), pictures[ids[b]].astype(float)
        best = min(np.abs(x[max(0, -v) : 48 - max(0, v), max(0, -u) : 48 - max(0, u)] - y[max(0, v) : 48 - max(0, -v), max(0, u) : 48 - max(0, -u)]).mean() for v in (-1, 0, 1) for u in (-1, 0, 1))
        if best <= 8:
            linked |= {ids[a], ids[b]}
            p, q = root(ids[a]), root(ids[b])
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in catalogue.image_near_duplicates(spark, sf_dir).collect()}
    assert got == {i: root(i) for i in linked} and got


def test_picture_features(pictures, spark, sf_dir):
    got = {r.id: r for r in catalogue.image_features(spark, sf_dir).collect()}
    assert set(got) == set(pictures)
    for i, x in list(pictures.items())[:40]:
        plane, r = luma(x), got[i]
        top, low = x.max(axis=2).astype(float), x.min(axis=2).astype(float)
        assert r.brightness == pytest.approx(plane.mean(), abs=1e-5) and r.contrast == pytest.approx(plane.std(), abs=1e-5)
        assert r.saturation == pytest.approx(((top - low) / (top + 1e-6)).mean(), abs=1e-5) and r.blue_mean == pytest.approx(x[..., 2].mean(), abs=1e-5)
        assert r.region_0 == pytest.approx(plane[:12, :12].mean(), abs=1e-5) and r.length == pytest.approx(1.0, abs=1e-3)


def test_picture_regions_and_descriptor(pictures, spark, sf_dir):
    """All 16 regions' means and contrasts of every picture; the descriptor's orientations and colours pixel by pixel."""
    got = {r.id: r for r in catalogue.image_features(spark, sf_dir).collect()}
    assert set(got) == set(pictures)
    for i, x in pictures.items():
        plane = luma(x)
        cells = [plane[a : a + 12, b : b + 12] for a in range(0, 48, 12) for b in range(0, 48, 12)]
        assert [got[i][f"region_{k}"] for k in range(16)] == pytest.approx([c.mean() for c in cells], abs=1e-5)
        assert [got[i][f"region_contrast_{k}"] for k in range(16)] == pytest.approx([c.std() for c in cells], abs=1e-5)
    for i, x in list(pictures.items())[:5]:
        plane, hog, colours = luma(x), np.zeros((6, 6, 9)), np.zeros((4, 4, 4))
        for r in range(48):
            for c in range(48):
                dx = plane[r, c + 1] - plane[r, c - 1] if 0 < c < 47 else 0.0
                dy = plane[r + 1, c] - plane[r - 1, c] if 0 < r < 47 else 0.0
                hog[r // 8, c // 8, min(8, int(np.degrees(np.arctan2(dy, dx)) % 180 / 20))] += np.hypot(dx, dy)
                colours[tuple(x[r, c] // 64)] += 1
        both = np.concatenate([hog.ravel() / (np.linalg.norm(hog) + 1e-6), 0.5 * colours.ravel() / (np.linalg.norm(colours) + 1e-6)])
        assert got[i].descriptor == pytest.approx(both / (np.linalg.norm(both) + 1e-6), abs=1e-5)


def test_recurring_squares(pictures, spark, sf_dir):
    """What is reported recurs: as many pictures as said hold one quantised square of enough contrast there; and the stamp is found."""
    got = catalogue.image_recurring_patches(spark, sf_dir).collect()
    least = max(8, len(pictures) // 100)
    for r in got:
        held = {}
        for i, x in pictures.items():
            square = x[r.y : r.y + 6, r.x : r.x + 6]
            if luma(square).std() >= 45:
                held.setdefault((square // 64).tobytes(), set()).add(i)
        assert r.members in {len(v) for v in held.values()} and r.members >= least
    stamped = sum(i % 7 == 3 for i in pictures)
    assert any((r.x, r.y) == (40, 40) and r.members >= stamped for r in got)
    for a in range(len(got)):
        for b in range(a):
            assert max(abs(got[a].x - got[b].x), abs(got[a].y - got[b].y)) >= 3


def fitted(vectors, seed=0, **kw):
    """The network as the queries fit it: on all reference vectors, by id."""
    ref = sorted(i for i in vectors if i % 4 == 0)
    return models.train_network(np.array([vectors[i][0] for i in ref]), np.array([vectors[i][1] for i in ref]), tuple(map(str, range(10))), seed=seed, **kw)


def test_behaviour_of_two_networks(vectors, spark, sf_dir):
    x = np.array([vectors[i][0] for i in sorted(vectors)])
    p, q = fitted(vectors, 0).predict(x), fitted(vectors, 1).predict(x)
    r = catalogue.model_behaviour(spark, sf_dir).first()
    assert r.n == len(x) and r.agreement == pytest.approx((p.argmax(axis=1) == q.argmax(axis=1)).mean()) and r.mean_change == pytest.approx(np.abs(p - q).mean())


def test_activations(vectors, spark, sf_dir):
    net = fitted(vectors, steps=60)
    every, ref = (np.array([vectors[i][0] for i in sorted(vectors) if i % k == 0]) for k in (1, 4))
    here, there = net.activations(every), net.activations(ref)
    got = {r.layer: r for r in catalogue.QUERIES["activation_statistics"](spark, sf_dir).collect()}
    assert set(got) == set(here)
    for layer, a in here.items():
        m, n = a.mean(axis=0), there[layer].mean(axis=0)
        r = got[layer]
        assert r.neurons == a.shape[1] and r.dead_fraction == pytest.approx((a.max(axis=0) <= 0).mean()) and r["mean"] == pytest.approx(m.mean())
        assert r.cosine == pytest.approx(m @ n / (math.sqrt(m @ m) * math.sqrt(n @ n) + 1e-9))


def test_permutations(vectors, spark, sf_dir):
    ref = np.array([vectors[i][0] for i in sorted(vectors) if i % 4 == 0])
    cur = np.array([vectors[i][0] for i in sorted(i for i in vectors if i % 4)[-60:]])
    assert tuple(catalogue.mmd_permutation_p(spark, sf_dir).first()) == pytest.approx(stats.mmd_test(ref, cur), abs=1e-9)


def test_trigger_tests(vectors, pictures, spark, sf_dir):
    """The flip rate of the first test, by stamping its square on every reference picture."""
    from probity.plans import detectors

    got = detectors.trigger_tests(spark, sf_dir).collect()
    assert len(got) == 12 and all(got[i].flip >= got[i + 1].flip for i in range(11))
    model, _ = detectors._trained(spark, sf_dir)
    ref = sorted(i for i in pictures if i % 4 == 0)
    x = np.stack([pictures[i] for i in ref])
    clean = model(x).argmax(axis=1)
    for r in got[:4]:
        patch = pixels.trigger_patterns()["checker-white-black" if r.pattern == "found" else r.pattern]
        after = model(pixels.stamp(x, patch, r.x, r.y)).argmax(axis=1)
        own = clean != r.target
        assert r.flip == pytest.approx((own & (after == r.target)).sum() / max(own.sum(), 1))

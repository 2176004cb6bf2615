"""Model checks behind one interface: predict, parameters, activations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import pixels
from probity.sources.storage import few, materialize

#: What a behaviour change, a changed tensor and a trigger hit are.
LEAST_AGREEMENT, MOST_PROBABILITY_CHANGE, MOST_TENSOR_CHANGE = 0.98, 0.02, 1e-6
LEAST_FLIP, LEAST_OVER_CONTROL = 0.5, 0.3
#: Rows whose part of a gradient is computed at once.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Network:
    """A small feed-forward classifier: the built-in adapter. Other formats implement the same four members."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    classes: tuple[str, ...]
    capabilities: dict = field(default_factory=lambda: {"predict": True, "parameters": True, "activations": True})

    def activations(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out, h = {}, x
        for i, (w, b) in enumerate(self.layers[:-1]):
            h = np.maximum(h @ w + b, 0)
            out[f"relu_{i}"] = h
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        held = list(self.activations(x).values())
        w, b = self.layers[-1]
        z = (held[-1] if held else x) @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def parameters(self) -> dict[str, np.ndarray]:
        return {f"layer_{i}.{n}": v for i, pair in enumerate(self.layers) for n, v in zip(("weight", "bias"), pair, strict=True)}

    def digest(self) -> str:
        h = hashlib.sha256()
        for name, value in sorted(self.parameters().items()):
            h.update(json.dumps([name, list(value.shape)]).encode() + np.ascontiguousarray(value, dtype="<f8").tobytes())
        return h.hexdigest()


def train_network(x: np.ndarray, y: np.ndarray, classes: tuple[str, ...], hidden: int = 24, steps: int = 300, seed: int = 0) -> Network:
    """Fit by full-batch gradient descent with momentum over all rows; each step sums its gradient over ``FIT_ROWS`` at a time."""
    rng = np.random.default_rng(seed)
    w1, w2 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), rng.normal(0, 1 / np.sqrt(hidden), (hidden, len(classes)))
    values = [w1, np.zeros(hidden), w2, np.zeros(len(classes))]
    speed = [np.zeros_like(v) for v in values]
    one_hot = np.eye(len(classes))
    for _ in range(steps):
        gradient = [np.zeros_like(v) for v in values]
        for i in range(0, len(x), FIT_ROWS):
            part, target = x[i : i + FIT_ROWS], one_hot[y[i : i + FIT_ROWS]]
            h = np.maximum(part @ values[0] + values[1], 0)
            z = h @ values[2] + values[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
            back = (d @ values[2].T) * (h > 0)
            for k, g in enumerate((part.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                gradient[k] += g
        for k, g in enumerate(gradient):
            speed[k] = 0.9 * speed[k] - 0.5 * g
            values[k] = values[k] + speed[k]
    return Network(((values[0], values[1]), (values[2], values[3])), classes)


def predictions(df: DataFrame, model, id_col: str, vector: str) -> DataFrame:
    """id, predicted, probs: the model is broadcast once, batches go through it as matrices."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = sent.value.predict(np.array(batch[vector].tolist(), dtype=float))
                yield pd.DataFrame({"id": batch[id_col].to_numpy(), "predicted": p.argmax(axis=1).astype(int), "probs": p.tolist()})

    return df.select(id_col, vector).mapInPandas(run, "id long, predicted int, probs array<double>")


def parameter_rows(model) -> list[tuple]:
    """(tensor, n, l2, mean, std, kurtosis, max_abs) of each tensor."""
    out = []
    for name, v in model.parameters().items():
        v = np.asarray(v, dtype=float).ravel()
        centred = v - v.mean()
        out.append((name, len(v), float(np.sqrt((v * v).sum())), float(v.mean()), float(v.std()), float((centred**4).mean() / (v.var() ** 2 + 1e-12)), float(np.abs(v).max())))
    return out


@dataclass(frozen=True)
class PictureModel:
    """A network on pictures: they are preprocessed to a small square first."""

    network: Network
    size: int = 8

    def vectors(self, images: np.ndarray) -> np.ndarray:
        return pixels.preprocess(images, self.size).reshape(len(images), -1)

    def __call__(self, images: np.ndarray) -> np.ndarray:
        return self.network.predict(self.vectors(images))


PARAMETERS = "tensor string, n long, l2 double, mean double, std double, kurtosis double, max_abs double"


def parameter_drift(current: DataFrame, registered: DataFrame) -> DataFrame:
    """tensor, l2_change, changed: against the registered statistics; a tensor of one side only is changed."""
    a, b = current.select("tensor", F.col("l2").alias("x")), registered.select("tensor", F.col("l2").alias("y"))
    change = F.abs(F.col("x") - F.col("y")) / (F.abs("y") + 1e-6)
    return a.join(b, "tensor", "full_outer").select("tensor", change.alias("l2_change"), F.coalesce(change > MOST_TENSOR_CHANGE, F.lit(True)).alias("changed"))


def behaviour(current: DataFrame, registered: DataFrame) -> DataFrame:
    """n, agreement, mean_change, changed, severity of predictions against the registered fingerprint (id, predicted, probs)."""
    a = current.select("id", F.col("predicted").alias("p"), F.col("probs").alias("u"))
    joined = a.join(registered, "id")
    gap = F.aggregate(F.zip_with("u", "probs", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size("probs")
    got = joined.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col("predicted")).cast("double")).alias("agreement"), F.avg(gap).alias("mean_change"))
    changed = (F.col("agreement") < LEAST_AGREEMENT) | (F.col("mean_change") > MOST_PROBABILITY_CHANGE)
    return got.withColumn("changed", changed).withColumn("severity", F.when(~changed, "INFO").when(F.col("agreement") < 0.9, "HIGH").otherwise("MEDIUM"))


def fingerprint_digest(predicted: DataFrame) -> DataFrame:
    """One digest of predictions and probabilities of two places, in any order of arrival."""
    line = F.concat_ws("|", "id", "predicted", F.array_join(F.transform("probs", lambda p: F.format_string("%.2f", p)), ","))
    bins = predicted.select(F.sha2(line, 256).alias("m")).groupBy(F.substring("m", 1, 2).alias("b")).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("m"))), 256).alias("d"))
    return bins.agg(F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("fingerprint"))


def digest_check(deployed: DataFrame, registry: DataFrame) -> DataFrame:
    """model, status, severity: a digest is its own, another registered version's, or unknown."""
    own = deployed.join(registry.select("model", F.col("sha256").alias("registered")), "model", "left")
    other = registry.select(F.col("sha256").alias("known"), F.lit(True).alias("_known")).distinct()
    joined = own.join(other, F.col("sha256") == F.col("known"), "left")
    status = F.when(F.col("sha256") == F.col("registered"), "match").when(F.col("_known"), "other_version").otherwise("unknown")
    return joined.select("model", status.alias("status"), F.when(status == "match", "INFO").when(status == "other_version", "HIGH").otherwise("CRITICAL").alias("severity"))


def flip_rates(clean: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """by, target, flip: share of samples not of the target before that are of it with the trigger; the best target of each."""
    joined = clean.select("id", F.col("predicted").alias("p")).join(changed.select("id", *by, F.col("predicted").alias("target")), "id")
    per = joined.groupBy(*by, "target").agg(F.sum((F.col("p") != F.col("target")).cast("long")).alias("hits"))
    base = joined.select(*by, "p").groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"))
    whole = base.groupBy(*by).agg(F.sum("n").alias("all"))
    own = base.withColumnsRenamed({"p": "target", "n": "own"})
    rate = per.join(whole, by).join(own, [*by, "target"], "left").withColumn("flip", F.col("hits") / F.greatest(F.col("all") - F.coalesce("own", F.lit(0)), F.lit(1)))
    best = rate.groupBy(*by).agg(F.max_by(F.struct("target", "flip"), F.struct("flip", (-F.col("target")).alias("t"))).alias("b"))
    return best.select(*by, "b.target", "b.flip")


def trigger_hits(flips: DataFrame, control: DataFrame, by: list[str]) -> DataFrame:
    """Flip rates next to those of a neutral control patch, with hit and severity."""
    joined = flips.join(control.select(*by, F.col("flip").alias("control")), by)
    hit = (F.col("flip") >= LEAST_FLIP) & (F.col("flip") - F.col("control") >= LEAST_OVER_CONTROL)
    return joined.withColumn("hit", hit).withColumn("severity", F.when(~hit, "INFO").when(F.col("flip") >= 0.75, "HIGH").otherwise("MEDIUM"))


def flips_to(clean: DataFrame, changed: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """by, flip: share of samples not of the given target (by, target) before that are of it in ``changed``."""
    joined = clean.select("id", F.col("predicted").alias("p")).join(changed.select("id", *by, F.col("predicted").alias("q")), "id").join(F.broadcast(targets.select(*by, "target")), by)
    fit = F.col("p") != F.col("target")
    return joined.groupBy(*by).agg((F.count(F.when(fit & (F.col("q") == F.col("target")), 1)) / F.greatest(F.count(F.when(fit, 1)), F.lit(1))).alias("flip"))


def stamped_predictions(images: DataFrame, predict: Callable[[np.ndarray], np.ndarray], height: int, width: int, tests: list[tuple[str, int, int, np.ndarray]]) -> DataFrame:
    """id, test, predicted of every image (id, rgb) with each pattern (test, x, y, pixels) stamped in; each batch is decoded once."""
    sent = images.sparkSession.sparkContext.broadcast((predict, tests))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cases = sent.value
        for batch in pixels.sliced(batches):
            if len(batch):
                x, ids = pixels.decode(batch["rgb"], height, width), batch["id"].to_numpy()
                for name, at_x, at_y, patch in cases:
                    yield pd.DataFrame({"id": ids, "test": name, "predicted": model(pixels.stamp(x, patch, at_x, at_y)).argmax(axis=1).astype(int)})

    return images.select("id", "rgb").mapInPandas(run, "id long, test string, predicted int")


def trigger_search(images: DataFrame, predict: Callable[[np.ndarray], np.ndarray], height: int, width: int, candidates: list[dict] | None = None, seed: int = 0) -> DataFrame:
    """test, origin, pattern, x, y, target, flip, control, shuffled, n, hit of candidates from training data and 24 searched patches.

    Each patch is stamped into every image and its best target compared with what a neutral patch at the same place does to that
    target; a candidate (pattern, x, y, pixels, target or None, source) also with its own pixels shuffled.
    """
    rng = np.random.default_rng(seed)
    cases: list[tuple[str, str, str, int, int, np.ndarray, int | None, str | None]] = []
    for i, c in enumerate(candidates or []):
        cases.append((f"candidate-{i}", "dataset_candidate", c["pattern"], c["x"], c["y"], np.asarray(c["pixels"], dtype=np.uint8), c.get("target"), c.get("source")))
    for name, patch in pixels.trigger_patterns().items():
        for corner, (x, y) in pixels.corners(height, width).items():
            cases.append((f"{name}@{corner}", "bounded_search", name, x, y, patch, None, None))
    stamped, neutral, mixed = [], [], []
    for test, origin, _, x, y, patch, _, _ in cases:
        stamped.append((test, x, y, patch))
        neutral.append((test, x, y, np.full_like(patch, pixels.NEUTRAL[0])))
        if origin == "dataset_candidate":
            mixed.append((test, x, y, rng.permutation(patch.reshape(-1, 3)).reshape(patch.shape)))
    clean = stamped_predictions(images, predict, height, width, [("clean", 0, 0, np.zeros((0, 0, 3), dtype=np.uint8))]).select("id", "predicted")
    clean = materialize(clean, "clean")
    tried = materialize(stamped_predictions(images, predict, height, width, stamped), "stamped")
    best = flip_rates(clean, tried, ["test"])
    spark = images.sparkSession
    about = spark.createDataFrame([(c[0], c[1], c[2], c[3], c[4], c[6], c[7]) for c in cases], "test string, origin string, pattern string, x int, y int, wanted int, candidate_source string")
    targets = materialize(best.join(about.select("test", "wanted"), "test").select("test", F.coalesce("wanted", "target").alias("target")), "targets")
    flip = flips_to(clean, tried, ["test"], targets)
    control = flips_to(clean, stamped_predictions(images, predict, height, width, neutral), ["test"], targets).withColumnRenamed("flip", "control")
    out = about.join(targets, "test").join(flip, "test").join(control, "test")
    if mixed:
        out = out.join(flips_to(clean, stamped_predictions(images, predict, height, width, mixed), ["test"], targets).withColumnRenamed("flip", "shuffled"), "test", "left")
    else:
        out = out.withColumn("shuffled", F.lit(None).cast("double"))
    n = clean.groupBy("predicted").agg(F.count(F.lit(1)).alias("c"))
    eligible = targets.join(F.broadcast(n)).where(F.col("predicted") != F.col("target")).groupBy("test").agg(F.sum("c").alias("n"))
    hit = (F.col("flip") >= LEAST_FLIP) & (F.col("flip") - F.col("control") >= LEAST_OVER_CONTROL)
    return out.join(eligible, "test", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hit": hit}).drop("wanted")


def top_tests(tests: DataFrame, n: int = 12) -> DataFrame:
    """The tests of the highest flip rate, in their order (ties by name)."""
    return tests.orderBy(F.col("flip").desc(), "test").limit(n)


def best_hit(tests: DataFrame) -> DataFrame:
    """The hit that a finding cites: of the training data's candidates before searched ones, then the highest flip rate."""
    return tests.where("hit").orderBy((F.col("origin") == "dataset_candidate").desc(), F.col("flip").desc(), "test").limit(1)


NEURONS = "layer string, neuron int, n long, total double, squares double, top double"


def neuron_stats(df: DataFrame, model, vector: str) -> DataFrame:
    """layer, neuron, n, mean, std, top of a model's activations on all rows, from sums of each batch."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for layer, a in sent.value.activations(np.array(batch[vector].tolist(), dtype=float)).items():
                    yield pd.DataFrame({"layer": layer, "neuron": np.arange(a.shape[1]), "n": len(a), "total": a.sum(axis=0), "squares": (a * a).sum(axis=0), "top": a.max(axis=0)})

    sums = df.select(vector).mapInPandas(run, NEURONS).groupBy("layer", "neuron").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"), F.max("top").alias("top"))
    mean = F.col("t") / F.col("n")
    return sums.select("layer", "neuron", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("s") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "top")


def activation_stats(neurons: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """layer, neurons, dead_fraction, mean, cosine to the registered baseline (layer, neuron, mean); null without one of the same size."""
    per = neurons.groupBy("layer").agg(F.count(F.lit(1)).alias("neurons"), F.avg((F.col("top") <= 0).cast("double")).alias("dead_fraction"), F.avg("mean").alias("mean"))
    if baseline is None:
        return per.withColumn("cosine", F.lit(None).cast("double"))
    both = neurons.select("layer", "neuron", F.col("mean").alias("a")).join(baseline.select("layer", "neuron", F.col("mean").alias("b")), ["layer", "neuron"], "full_outer")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    whole = F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull())
    cosine = both.groupBy("layer").agg(F.when(whole, F.sum(F.col("a") * F.col("b")) / (norm("a") * norm("b") + 1e-9)).alias("cosine"))
    return per.join(cosine, "layer", "left")


def neuron_response(clean: DataFrame, stamped: DataFrame, k: int = 5) -> DataFrame:
    """layer, neuron, z, place of the ``k`` neurons of each layer that a trigger moves most, in deviations of clean inputs."""
    joined = clean.select("layer", "neuron", F.col("mean").alias("m"), "std").join(stamped.select("layer", "neuron", F.col("mean").alias("t")), ["layer", "neuron"])
    z = joined.withColumn("z", (F.col("t") - F.col("m")) / (F.col("std") + 1e-3))
    return z.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("z").desc(), "neuron"))).where(F.col("place") <= k).select("layer", "neuron", "z", "place")


def fingerprint(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n, accuracy, mean_confidence of predictions (id, predicted, probs) against labels (id, label)."""
    joined = predicted.join(labels, "id")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg(F.array_max("probs")).alias("mean_confidence"))


def previous_versions(registry: DataFrame, predictions: DataFrame, current: DataFrame) -> DataFrame:
    """model, previous, agreement: how far a model's predictions (id, predicted) agree with those of its previous version.

    registry has model, previous_version; predictions has model, id, predicted of registered versions.
    """
    older = registry.where(F.col("previous_version").isNotNull()).join(predictions.withColumnsRenamed({"model": "previous_version", "predicted": "_old"}), "previous_version")
    joined = older.join(current, "id")
    return joined.groupBy("model", F.col("previous_version").alias("previous")).agg(F.avg((F.col("_old") == F.col("predicted")).cast("double")).alias("agreement"))


#: Rows that a network is fitted on at most, and records that one loading of a model serves.
SAMPLE_ROWS, REPLAY_ROWS = 20_000, 10_000


def fit_sample(df: DataFrame, id_col: str, n: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """The rows that a small network is fitted on: all of at most ``n``, else those of the least seeded hash of their id."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


class Centroids:
    """A model of one vector for each class; the class of the largest product is predicted, the first of equal ones."""

    def __init__(self, classes: list[str], weights: np.ndarray) -> None:
        self.classes, self.weights = classes, np.asarray(weights, dtype=np.float64)

    @classmethod
    def fitted(cls, df: DataFrame, label: str, vector: str) -> Centroids:
        """Class means, summed where the rows are: only classes times dimensions numbers come to the driver."""
        means = df.select(F.col(label).cast("string").alias("c"), F.posexplode(vector).alias("i", "v")).groupBy("c", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        held: dict[str, dict[int, float]] = {}
        for r in means.collect():
            held.setdefault(r.c, {})[r.i] = r.m
        classes = sorted(held)
        return cls(classes, np.array([[held[c][i] for i in sorted(held[c])] for c in classes]))

    def artefact(self) -> bytes:
        import json

        return json.dumps({"kind": "centroids", "classes": self.classes, "weights": self.weights.tolist()}, sort_keys=True).encode()

    def labels(self, x: np.ndarray) -> list[str]:
        return [self.classes[i] for i in (np.asarray(x, dtype=np.float64) @ self.weights.T).argmax(axis=1)]


def load_artefact(data: bytes) -> Centroids:
    """The model in an artefact's bytes; only the built-in format, others by a loader of the caller."""
    import json

    doc = json.loads(data)
    if doc.get("kind") != "centroids":
        raise ValueError("an artefact of another format")
    return Centroids(doc["classes"], np.array(doc["weights"]))


def rerun(records: DataFrame, artefacts: DataFrame, vector: str = "embedding", load: Callable[[bytes], Centroids] = load_artefact, rows: int = REPLAY_ROWS) -> DataFrame:
    """record_id, label of a new run of the registered model that each record (record_id, model_sha256, vector) is bound to.

    artefacts has sha256, artefact (bytes) of what is registered; bytes whose digest isn't the stated one are not run, nor are records
    without an artefact. Records are grouped by digest, at most some ``rows`` of them in a task, and each task loads its model once.
    """
    sizes = records.groupBy(F.col("model_sha256").alias("sha256")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    known = artefacts.where(F.sha2("artefact", 256) == F.col("sha256")).dropDuplicates(["sha256"]).join(sizes, "sha256")
    parts = known.select("sha256", "artefact", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    placed = records.join(few(known.select(F.col("sha256").alias("model_sha256"), "parts")), "model_sha256").select("record_id", F.col("model_sha256").alias("sha256"), vector, F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int").alias("part"))
    kind = dict(records.dtypes)["record_id"]

    def run(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"record_id": [], "label": []})
        model = load(held["artefact"].iloc[0])
        return pd.DataFrame({"record_id": asked["record_id"], "label": model.labels(np.array(asked[vector].tolist(), dtype=np.float64))})

    return placed.groupBy("sha256", "part").cogroup(parts.groupBy("sha256", "part")).applyInPandas(run, f"record_id {kind}, label string")

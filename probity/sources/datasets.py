"""Data-set sources: COCO and YOLO annotations, provenance lists, file digests and images.

A data set is a folder. ``load`` asks the formats of ``FORMATS`` in turn; an image file that a COCO file names but that isn't
there is a warning and no sample, an image without a YOLO label file a warning and a sample without label.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.ordered import numbered

#: Image files that are read.
IMAGE_SUFFIX = r"(?i)\.(png|jpe?g|bmp)$"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"\.[^.]*$", "")


def read_sources_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, contributor, batch; empty strings are null."""
    raw = spark.read.schema("file string, contributor string, batch string").csv(path, header=True)
    return raw.select("file", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("contributor", "batch")])


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, sha256, length of every file in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(name_of(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """file, length of the image files right in ``folder``; contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select(name_of(F.col("path")).alias("file"), "length")
    return files.where(F.col("file").rlike(IMAGE_SUFFIX))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """file, height, width and RGB bytes of every image; Spark's reader gives blue, green, red (or gray, or with alpha)."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> bytes:
            pixels = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
            return (np.repeat(pixels, 3, axis=1) if n == 1 else pixels[:, 2::-1]).tobytes()

        return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)], dtype=object)

    return images.select(name_of(F.col("origin")).alias("file"), "height", "width", rgb("data", "nChannels").alias("rgb"))


def largest_class(boxes: Column) -> Column:
    """The class of the box with the largest area, the first of equals; null without boxes."""
    sized = F.transform(boxes, lambda b, i: F.struct((b["w"] * b["h"]).alias("area"), (-i).alias("rank"), b["cls"].alias("cls")))
    return F.array_max(sized)["cls"]


def read_yolo(spark: SparkSession, labels: str, images: DataFrame, classes: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Samples from one text file per image (class cx cy w h, as shares of the image).

    ``images`` has file, width, height. Lines of fewer than five fields are skipped, unknown classes keep their
    number, an image without a label file stays with a null label.
    """
    lines = spark.read.text(labels, pathGlobFilter="*.txt").select(stem_of(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("f"))
    lines = lines.where(F.size("f") >= 5).join(images.select(stem_of(F.col("file")).alias("stem"), "width", "height"), "stem")
    num = lambda i: F.col("f")[i].cast("double")
    names = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(str(i)), F.lit(c))]) if classes else F.create_map().cast("map<string,string>")
    box = F.struct(
        F.coalesce(F.try_element_at(names, F.col("f")[0]), F.col("f")[0]).alias("cls"),
        ((num(1) - num(3) / 2) * F.col("width")).alias("x"), ((num(2) - num(4) / 2) * F.col("height")).alias("y"),
        (num(3) * F.col("width")).alias("w"), (num(4) * F.col("height")).alias("h"),
    )
    boxes = lines.groupBy("stem").agg(F.collect_list(box).alias("boxes"))
    out = images.withColumn("stem", stem_of(F.col("file"))).join(boxes, "stem", "left")
    return _with_sources(out.select(F.col("stem").alias("sample_id"), F.col("file"), largest_class(F.col("boxes")).alias("label"), "boxes"), sources)


def read_coco(spark: SparkSession, path: str, sources: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Samples from a COCO file: images with their annotations; a category without a name keeps its number.

    Provenance inside the file (``source`` with contributor and batch) wins over the list's. With ``present`` (file) images
    that aren't there are left out.
    """
    raw = spark.read.option("multiLine", True).json(path)
    images = raw.select(F.explode("images").alias("i")).select("i.*")
    inline = [n for n, t in images.dtypes if n.endswith("source") and t.startswith("struct")]
    held = images.schema[inline[0]].dataType.fieldNames() if inline else []
    own = {c: F.col(f"{inline[0]}.{c}") if c in held else F.lit(None).cast("string") for c in ("contributor", "batch")}
    notes = raw.select(F.explode("annotations").alias("a")).select("a.*")
    kinds = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("name"))
    box = F.struct(F.coalesce("name", F.col("category_id").cast("string")).alias("cls"), *[F.col("bbox")[i].cast("double").alias(c) for i, c in enumerate("xywh")])
    boxes = notes.join(kinds, "category_id", "left").groupBy(F.col("image_id").alias("id")).agg(F.collect_list(box).alias("boxes"))
    out = images.select("id", F.col("file_name").alias("file"), *[F.nullif(v, F.lit("")).alias(f"own_{c}") for c, v in own.items()]).join(boxes, "id", "left")
    out = _with_sources(out.select(stem_of(F.col("file")).alias("sample_id"), "file", largest_class(F.col("boxes")).alias("label"), "boxes", "own_contributor", "own_batch"), sources)
    out = out.withColumns({c: F.coalesce(f"own_{c}", c) for c in ("contributor", "batch")}).drop("own_contributor", "own_batch")
    return out.join(present.select("file"), "file", "left_semi").select(*out.columns) if present is not None else out


def _with_sources(samples: DataFrame, sources: DataFrame | None) -> DataFrame:
    if sources is None:
        return samples.withColumns({"contributor": F.lit(None).cast("string"), "batch": F.lit(None).cast("string")})
    return samples.join(sources, "file", "left").select(*samples.columns, "contributor", "batch")


def class_names(text: str, yaml: bool) -> list[str]:
    """The class names of a classes.txt, or of the ``names`` of a data.yaml: a list on its line, or entries ``- name`` or ``0: name`` under it."""
    lines = text.splitlines()
    if not yaml:
        return [x.strip() for x in lines if x.strip()]
    bare = lambda v: v.strip().strip("'\"")
    at = next((i for i, x in enumerate(lines) if x.strip().startswith("names:")), None)
    if at is None:
        raise ValueError("data.yaml names no classes")
    rest = lines[at].strip().removeprefix("names:").strip()
    if rest:
        return [bare(x) for x in rest.strip("[]").split(",") if x.strip()]
    out = []
    for entry in (x.strip() for x in lines[at + 1 :]):
        number, colon, name = entry.partition(":")
        if entry.startswith("- "):
            out.append(bare(entry[2:]))
        elif colon and number.strip().isdigit():
            out.append(bare(name))
        elif entry:
            break
    return out


@dataclass(frozen=True)
class Files:
    """What a data set's folder holds: names right in it and in its folders, and the texts of its small files."""

    spark: SparkSession
    root: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}".rstrip("/"))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._store().listStatus(self._path()))

    def is_folder(self, name: str) -> bool:
        return self._store().exists(self._path(name)) and self._store().getFileStatus(self._path(name)).isDirectory()

    def text(self, name: str) -> str:
        return "".join(r.value for r in self.spark.read.text(f"{self.root.rstrip('/')}/{name}", wholetext=True).collect())

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


@dataclass(frozen=True)
class Loaded:
    """Samples (sample_id, file, label, boxes, contributor, batch), classes in order, warnings (warning), the format's name."""

    format: str
    classes: list[str]
    samples: DataFrame
    warnings: DataFrame

    def has_provenance(self) -> bool:
        return bool(self.samples.where(F.col("contributor").isNotNull()).limit(1).count())


def _sources_of(files: Files) -> DataFrame | None:
    return read_sources_csv(files.spark, files.path("sources.csv")) if "sources.csv" in files.names() else None


def _coco_file(files: Files) -> str | None:
    """The first valid one of annotations.coco.json, annotations.json and then all others by name."""
    known = files.names()
    for name in dict.fromkeys(["annotations.coco.json", "annotations.json", *[n for n in known if n.endswith(".json")]]):
        if name in known and _is_coco(files.spark, files.path(name)):
            return name
    return None


def _is_coco(spark: SparkSession, path: str) -> bool:
    """Whether a file is a JSON object with images and annotations; parsed on the executors, and only as far as these names."""
    read = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad")
    held = read.schema("images array<struct<id: long>>, annotations array<struct<id: long>>, _bad string").json(path)
    return held.where("_bad is null and images is not null and annotations is not null").limit(1).count() > 0


def _load_coco(files: Files) -> Loaded:
    name = _coco_file(files)
    folder = files.path("images") if files.is_folder("images") else files.root
    present = listing(files.spark, folder)
    named = files.spark.read.option("multiLine", True).schema("categories array<struct<id: long, name: string>>").json(files.path(name))
    kinds = named.select(F.inline("categories")).orderBy("id").collect()  # one for each class
    every = read_coco(files.spark, files.path(name), _sources_of(files))
    missing = every.join(present, "file", "left_anti").select(F.concat(F.lit("missing image file "), "file").alias("warning"))
    return Loaded("COCO", [k["name"] for k in kinds], every.join(present.select("file"), "file", "left_semi").select(*every.columns), missing)


def _yolo_classes(files: Files) -> list[str] | None:
    known = files.names()
    if files.is_folder("labels") and ("classes.txt" in known or "data.yaml" in known):
        return class_names(files.text("classes.txt"), False) if "classes.txt" in known else class_names(files.text("data.yaml"), True)
    return None


def _load_yolo(files: Files) -> Loaded:
    classes = _yolo_classes(files)
    images = read_images(files.spark, files.path("images")).select("file", "width", "height").where(F.col("file").rlike(IMAGE_SUFFIX))
    samples = read_yolo(files.spark, files.path("labels"), images, classes, _sources_of(files))
    labelled = files.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(files.path("labels")).select(stem_of(F.col("path")).alias("sample_id"))
    bare = samples.join(labelled, "sample_id", "left_anti").select(F.concat(F.lit("no label file for "), "file").alias("warning"))
    return Loaded("YOLO", classes, samples, bare)


#: The order in which formats are tried: name, whether a folder is of it, and its loader. Others may be added.
FORMATS: list[tuple[str, Callable[[Files], bool], Callable[[Files], Loaded]]] = [
    ("COCO", lambda files: _coco_file(files) is not None, _load_coco),
    ("YOLO", lambda files: _yolo_classes(files) is not None, _load_yolo),
]


def load(spark: SparkSession, root: str, fmt: str | None = None) -> Loaded:
    """The data set in a folder, by the first format (or the named one, in any case of letters) that it is of."""
    files = Files(spark, root)
    for name, holds, loader in FORMATS:
        if (fmt is None or fmt.lower() == name.lower()) and holds(files):
            return loader(files)
    raise ValueError(f"{root} is of no known format ({', '.join(n for n, _, _ in FORMATS)})")


def model_card(spark: SparkSession, model_path: str, default: dict) -> dict:
    """The card beside a model file (``<stem>.card.json``), over the default one's entries; the default without one."""
    folder, _, name = model_path.rpartition("/")
    card = f"{name.rsplit('.', 1)[0]}.card.json"
    files = Files(spark, folder)
    return {**default, **json.loads(files.text(card))} if card in files.names() else dict(default)


def observation_frames(spark: SparkSession, folder: str) -> DataFrame:
    """file, idx of the frames in a folder, numbered by name from 0."""
    return numbered(listing(spark, folder).select("file"), ["file"], "idx", first=0)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a contribution's items.json, one row each."""
    return spark.read.option("multiLine", True).json(path)

"""Data sets on disk, the document store, reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import report
from probity.sources import datasets, storage


def bmp(path, image):
    """An uncompressed 24-bit bitmap."""
    h, w = image.shape[:2]
    row = (w * 3 + 3) // 4 * 4
    body = b"".join(image[r, :, ::-1].tobytes().ljust(row, b"\0") for r in range(h - 1, -1, -1))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
    path.write_bytes(head + info + body)


@pytest.fixture
def root(tmp_path):
    (tmp_path / "images").mkdir()
    for i, name in enumerate(("a.bmp", "b.bmp")):
        bmp(tmp_path / "images" / name, np.full((10, 20, 3), (10 * i, 100, 200), dtype=np.uint8))
    (tmp_path / "images" / "notes.txt").write_text("no image")
    (tmp_path / "sources.csv").write_text("file,contributor,batch\na.bmp,c1,b1\nb.bmp,c2,\n")
    return tmp_path


def coco(root, name="annotations.coco.json"):
    body = {
        "images": [{"id": 1, "file_name": "a.bmp", "source": {"contributor": "inline", "batch": ""}}, {"id": 2, "file_name": "b.bmp"}, {"id": 3, "file_name": "gone.bmp"}],
        "annotations": [{"image_id": 1, "category_id": 7, "bbox": [0, 0, 5, 5]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 9, 9]}, {"image_id": 3, "category_id": 7, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 9, "name": "sign"}, {"id": 7, "name": "vehicle"}],
    }
    (root / name).write_text(json.dumps(body))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_coco_folder(spark, root):
    (root / "annotations.json").write_text("not json")
    coco(root, "z.json")
    (root / "a.json").write_text("{}")
    got = datasets.load(spark, str(root))
    assert got.format == "COCO" and got.classes == ["vehicle", "sign"] and got.has_provenance()
    assert rows(got.samples, "sample_id", "label", "contributor", "batch") == [("a", "sign", "inline", "b1"), ("b", None, "c2", None)]
    assert rows(got.warnings, "warning") == [("missing image file gone.bmp",)]


@pytest.mark.parametrize("text", ["names: [vehicle, 'person']\n", "path: x\nnames:\n  - vehicle\n  - \"person\"\nnc: 2\n", "names:\n  0: vehicle\n  1: person\n"])
def test_yolo_folder(spark, root, text):
    (root / "labels").mkdir()
    (root / "labels" / "a.txt").write_text("1 0.5 0.5 0.5 0.5\n0 0.1 0.1 0.1 0.1\nshort\n9 0 0 0.01 0.01\n")
    (root / "data.yaml").write_text(text)
    got = datasets.load(spark, str(root), "yolo")
    assert got.format == "YOLO" and got.classes == ["vehicle", "person"]
    assert rows(got.samples, "sample_id", "label", "contributor") == [("a", "person", "c1"), ("b", None, "c2")]
    boxes = got.samples.where("sample_id = 'a'").first().boxes
    assert {(b.cls, b.x, b.w) for b in boxes} >= {("person", 5.0, 10.0)} and {b.cls for b in boxes} == {"person", "vehicle", "9"}
    assert rows(got.warnings, "warning") == [("no label file for b.bmp",)]
    coco(root)
    assert datasets.load(spark, str(root)).format == "COCO"


def test_unknown_folder(spark, root):
    with pytest.raises(ValueError):
        datasets.load(spark, str(root))
    with pytest.raises(ValueError):
        datasets.class_names("nc: 2", True)


def test_images_digests_and_cards(spark, root):
    got = {r.file: (r.height, r.width, bytes(r.rgb[:3])) for r in datasets.read_images(spark, str(root / "images")).collect()}
    assert got == {"a.bmp": (10, 20, bytes((0, 100, 200))), "b.bmp": (10, 20, bytes((10, 100, 200)))}
    assert rows(datasets.observation_frames(spark, str(root / "images")), "file", "idx") == [("a.bmp", 0), ("b.bmp", 1)]
    assert datasets.file_digests(spark, str(root / "images"), "*.bmp").count() == 2
    (root / "m.card.json").write_text('{"name": "n"}')
    assert datasets.model_card(spark, f"{root}/m.onnx", {"name": "?", "version": "0"}) == {"name": "n", "version": "0"}
    assert datasets.model_card(spark, f"{root}/other.onnx", {"name": "?"}) == {"name": "?"}
    (root / "items.json").write_text('[{"file": "a.bmp", "label": "x"}, {"file": "b.bmp", "label": "y"}]')
    assert rows(datasets.read_items(spark, str(root / "items.json")), "file", "label") == [("a.bmp", "x"), ("b.bmp", "y")]


def test_store(spark, tmp_path):
    store = storage.Store(spark, str(tmp_path / "store"))
    assert store.value("k", "none") == "none" and store.next_ids("finding", "F-", 3, 2) == ["F-001", "F-002"]
    store.put("findings", {"F-001": {"s": "LOW"}, "F-002": {"s": "é"}}, run_id="R1")
    store.put("findings", {"F-001": {"s": "HIGH"}}, run_id="R2")
    store.set_value("k", [1, 2])
    again = storage.Store(spark, str(tmp_path / "store"))
    assert again.get("findings", "F-001") == {"s": "HIGH"} and again.value("k") == [1, 2] and again.next_ids("finding", "F-", 3) == ["F-003"]
    assert rows(again.documents("findings", "R1"), "id") == [("F-002",)] and rows(again.documents("findings"), "id") == [("F-001",), ("F-002",)]
    again.clear()
    assert again.value("k") is None


def test_records_in_order(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "stream long, seq long")
    assert [tuple(r) for r in storage.records_of(df).collect()] == [(1, 1), (1, 2), (2, 1)]
    assert [tuple(r) for r in storage.records_of(df, 1).collect()] == [(1, 1), (1, 2)]


def test_long_lists_of_a_report_are_kept_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "INLINE", 5)
    found = spark.range(12).selectExpr("id", "id AS ord", "'x' AS category")
    chains, audit, case = spark.createDataFrame([], "place int"), spark.createDataFrame([], "seq long"), spark.createDataFrame([(1,)], "c int")
    with pytest.raises(ValueError):
        report.build(case, found, chains, audit)
    made = report.build(case, found, chains, audit, str(tmp_path / "beside"))
    assert made["findings"]["rows"] == 12 and spark.read.parquet(made["findings"]["folder"]).count() == 12 and report.holds(made)
    report.save(spark, made, str(tmp_path / "reports" / "RPT-0001"))
    report.save(spark, made, str(tmp_path / "reports" / "RPT-0002"))
    assert [r.report for r in report.listed(spark, str(tmp_path / "reports")).collect()] == ["RPT-0002", "RPT-0001"]


def test_scratch_paths_go(spark, tmp_path):
    with storage.scratch(spark) as kept:
        one, two = (storage.materialize(spark.range(3), t) for t in "ab")
        kept.append(two)
    assert two.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(one._probity_path).count()
    storage.release(two)


def _signed(key="k"):
    import hashlib

    mark = lambda text: hashlib.sha256((key + text).encode()).hexdigest()
    return mark, lambda text, given: mark(text) == given


def test_log_is_compared_with_its_head_before_an_append(spark, tmp_path):
    """A cut-off end, a changed end, a foreign signature and a second writer are refused; nothing of theirs is in the log."""
    import shutil

    from probity.operators import records
    from probity.sources.storage import AuditLog

    log = AuditLog(spark, str(tmp_path / "log"), *_signed())
    assert log.rows().count() == 0 and log.head() == (0, "0" * 64)
    first = log.append([{"event_type": "a", "actor": "x", "asset": "y"}, {"event_type": "b", "actor": "x", "asset": "y"}])
    second = log.append([{"event_type": "c", "actor": "x", "asset": "z", "details": {"n": 1}}])
    assert first[0] == 2 and second[0] == 3 and log.append([]) == second
    rows = log.rows()
    assert [r.seq for r in rows.orderBy("seq").collect()] == [1, 2, 3]
    assert records.audit_problems(rows.withColumn("body", F.col("hash")), F.col("body")).count() == 0
    other = AuditLog(spark, str(tmp_path / "log"), *_signed("another"))
    with pytest.raises(PermissionError, match="signature"):
        other.append([{"event_type": "d"}])
    # Two writers that saw the same head.
    late = AuditLog(spark, str(tmp_path / "log"), *_signed())
    stale = late.head()
    log.append([{"event_type": "e"}])
    late.head = lambda: stale
    with pytest.raises(PermissionError, match="another writer"):
        late.append([{"event_type": "f"}])
    assert sorted(r.event_type for r in log.rows().collect()) == ["a", "b", "c", "e"]
    # The last batch's rows are gone: the log ends before its head.
    last = log._read(log._names()[-1:]).first().batch
    shutil.rmtree(tmp_path / "log" / "rows" / last)
    with pytest.raises(PermissionError, match="end"):
        log.append([{"event_type": "g"}])


def test_snapshots_restore_all_tables(spark, tmp_path):
    from probity.sources.storage import Store

    store = Store(spark, str(tmp_path / "store"))
    store.put("cases", {"C-1": {"s": 1}, "C-2": {"s": 1}})
    store.set_value("mode", "clean")
    assert store.next_ids("case", "C-", 3) == ["C-001"]
    store.snapshot("clean")
    store.put("cases", {"C-1": {"s": 2}, "C-3": {"s": 1}})
    store.set_value("mode", "attacked")
    assert store.next_ids("case", "C-", 3) == ["C-002"]
    store.restore("clean")
    read = lambda s: {r.id: r.doc for r in s.documents("cases").collect()}
    assert read(store) == {"C-1": '{"s": 1}', "C-2": '{"s": 1}'} and store.value("mode") == "clean"
    assert store.next_ids("case", "C-", 3) == ["C-002"]
    store.put("cases", {"C-9": {"s": 3}})
    again = Store(spark, str(tmp_path / "store"))
    assert set(read(again)) == {"C-1", "C-2", "C-9"}
    again.restore("clean")
    assert set(read(again)) == {"C-1", "C-2"}
    with pytest.raises(KeyError):
        store.restore("unknown")

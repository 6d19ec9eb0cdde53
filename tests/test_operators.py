"""Operators on small tables and image trees, with the figures of record."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmill.functions import numbers, paths
from sparkmill.operators import manifest, metrics, pixels, registry, splitting, training, triage
from sparkmill.schema import EXPERIMENT
from sparkmill.sources import files
from sparkmill.streaming.feed import triage_feed


def png(rows: np.ndarray) -> bytes:
    """An 8-bit image: (height, width, 3) or (height, width, 4)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = {3: 2, 4: 6}[rows.shape[2]]
    raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    one, two, three = (png(np.full((4, 6, 3), v)) for v in ((10, 20, 30), (40, 50, 60), (70, 80, 90)))
    for name, data in {"train/Normal/a b.png": one, "train/Normal/a2.PNG": two, "train/Pothole/c.jpg": b"text", "train/Pothole/d.png": three,
                       "Validation/Pothole/e.png": one, "Validation/Normal/f.png": two, "train/notes.txt": b"x", "train/loose.png": three, "test/g.png": three}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_scan_and_audit(spark, tree):
    found = files.scan(spark, tree).withColumn("split", files.audit_split(F.col("folder")))
    files.require_one_folder_each(found)
    assert {(r["split"], r["label"], r["path"].rsplit("/", 1)[1]) for r in found.collect()} == {
        ("train", "Normal", "a b.png"), ("train", "Normal", "a2.PNG"), ("train", "Pothole", "c.jpg"), ("train", "Pothole", "d.png"),
        ("val", "Pothole", "e.png"), ("val", "Normal", "f.png"), ("test", "", "g.png")}
    rows = manifest.manifest(found, F.col("path"), F.col("split"), F.col("label"), F.col("content"))
    assert {(r["label"], r["label_source"]) for r in rows.where("split = 'test'").collect()} == {("unknown", "unverified_filename_prefix")}
    assert sorted((r["n_files"], r["n_splits"]) for r in manifest.spread_digests(rows).collect()) == [(2, 2), (2, 2), (2, 2)]
    assert [r["labels"] for r in manifest.conflicting_digests(rows.where("label <> 'unknown'")).collect()] == ["Normal,Pothole"]
    counts = manifest.class_counts(rows)
    assert {(r["split"], r["label"]): r["n_files"] for r in counts.collect()} == {("train", "Normal"): 2, ("train", "Pothole"): 2, ("val", "Pothole"): 1, ("val", "Normal"): 1}
    assert manifest.layout_errors(counts, ("train", "val"), ("Normal", "Pothole")) == []
    assert manifest.layout_errors(counts, ("train", "test"), ("Normal", "Pothole")) == ["test: missing"]
    assert [r["warning"] for r in manifest.warnings(counts, manifest.spread_digests(rows)).collect()] == ["3 exact duplicate groups cross splits"]
    every = manifest.with_folders(manifest.split_counts(rows), files.class_folders(spark, tree).withColumn("split", files.audit_split(F.col("folder"))).where("split is not null"))
    assert {r["warning"] for r in manifest.warnings(every, manifest.spread_digests(rows)).collect()} == {"3 exact duplicate groups cross splits", "test: expected two classes but found []", "class folders differ between splits"}
    report = {r["split"]: json.loads(r["report"]) for r in manifest.report(every, manifest.unreadable(rows, F.lit(True), "split", "filepath")).collect()}
    assert report["test"] == {"split": "test", "classes": [], "class_counts": {}, "unreadable_images": 0}
    assert report["train"] == {"split": "train", "classes": ["Normal", "Pothole"], "class_counts": {"Normal": 2, "Pothole": 2}, "unreadable_images": 0}


def test_splits_without_classes_are_audited(spark, tree, tmp_path):
    from sparkmill.__main__ import main

    rows = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", None, False), ("b", "", True), ("b", "unknown", False), (None, None, False)], "split string, label string, ok boolean")
    counts = manifest.split_counts(rows)
    assert {r["split"]: (r["classes"], r["n_classes"], r["n_files"]) for r in manifest.class_sets(counts).collect()} == {"a": ("x,y", 2, 2), "b": ("", 0, 0), None: ("", 0, 0)}
    lost = manifest.unreadable(rows.withColumn("path", F.lit("p")), F.col("ok"), "split", "path")
    report = {r["split"]: json.loads(r["report"]) for r in manifest.report(counts, lost).collect()}
    assert report["b"] == {"split": "b", "classes": [], "class_counts": {}, "unreadable_images": 2} and report[None]["unreadable_images"] == 1
    none = spark.createDataFrame([], "sha256 string")
    found = {r["warning"] for r in manifest.warnings(manifest.split_counts(rows.where("split is not null")), none).collect()}
    assert found == {"b: expected two classes but found []", "class folders differ between splits"}

    main(["audit", "--data-dir", tree, "--output", str(tmp_path / "report")])
    table = lambda name: spark.read.json(str(tmp_path / f"report-tables/{name}")).collect()
    assert {r["split"]: json.loads(r["report"])["classes"] for r in table("report")} == {"train": ["Normal", "Pothole"], "val": ["Normal", "Pothole"], "test": []}
    assert "test: expected two classes but found []" in {r["warning"] for r in table("warnings")}
    assert [r["filepath"].rsplit("/", 1)[1] for r in table("unreadable")] == ["c.jpg"] and len(table("duplicates")) == 6


def test_folder_rules(spark):
    rows = spark.createDataFrame([("train",), ("val",), ("validation",), ("test",)], ["folder"])
    with pytest.raises(ValueError, match="val"):
        files.require_one_folder_each(rows)
    assert files.trainer_folders(["train", "valid", "validation", "test"]) == {"train": "train", "validation": "valid", "test": "test"}
    for short in (["train", "val"], ["train", "test"], ["val", "test"]):
        with pytest.raises(FileNotFoundError):
            files.trainer_folders(short)
    ranks = {r["folder"]: r["r"] for r in rows.select("folder", files.pool_rank(F.col("folder")).alias("r")).collect()}
    assert ranks == {"train": 0, "val": 1, "validation": 3, "test": None}


def test_images(spark, tree):
    found = pixels.images(spark, tree)
    by_name = {r["path"].rsplit("/", 1)[1]: r for r in found.select("path", pixels.readable(F.col("height"), F.col("width")).alias("ok")).collect()}
    assert by_name["a b.png"]["ok"] and not by_name["c.jpg"]["ok"]
    x = pixels.tensors(found.where(F.col("path").endswith("a b.png"))).first()["pixels"]
    x = np.array(x).reshape(224, 224, 3)
    assert np.allclose(x, [10, 20, 30], atol=1e-3)
    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[..., :3] = (3, 2, 1)
    assert pixels.to_rgb(rgba.tobytes(), 2, 2, 4)[0, 0].tolist() == [1, 2, 3]
    assert pixels.to_rgb(b"\x07" * 4, 2, 2, 1)[1, 1].tolist() == [7, 7, 7]
    with pytest.raises(ValueError):
        pixels.to_rgb(b"", 0, 2, 3)


def test_augmentation_stays_in_training(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"{s}{k}", s, [float(v) for v in rng.integers(0, 255, 300)]) for s in ("train", "validation") for k in range(3)], "path string, split string, pixels array<float>")
    once, again = ({r["path"]: r["pixels"] for r in pixels.augment(rows.repartition(n), pixels.TRAINER, (10, 10)).collect()} for n in (1, 4))
    assert once == again
    plain = {r["path"]: r["pixels"] for r in rows.collect()}
    assert all((once[p] == plain[p]) == p.startswith("validation") for p in plain)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 30, 35, 55, 200, 337, 891])
def test_split_sizes(spark, n):
    rows = spark.range(n).select(F.lit("A").alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    got = {r["split"]: r["count"] for r in splitting.stratified_split(rows).groupBy("split").count().collect()}
    train = round(n * 0.70)
    validation = round(n * 0.15)
    assert [got.get(s, 0) for s in splitting.SPLITS] == [train, validation, n - train - validation]


def test_split_of_record(spark):
    pool = spark.range(1228).select(F.when(F.col("id") < 337, "Normal").otherwise("Pothole").alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    parts = splitting.stratified_split(pool)
    rows = {r["split"]: (r["rows"], r["normal_count"], r["pothole_count"], r["pothole_rate"]) for r in splitting.summary(parts, "Normal", "Pothole").collect()}
    assert rows == {"train": (860, 236, 624, "0.725581"), "validation": (185, 51, 134, "0.724324"), "test": (183, 50, 133, "0.726776")}
    same = splitting.stratified_split(pool.repartition(7)).select("sha256", "split")
    assert same.exceptAll(parts.select("sha256", "split")).isEmpty()
    weights = metrics.class_weights(parts.where("split = 'train'"), "label")
    assert {r["label"]: round(r["weight"], 3) for r in weights.collect()} == {"Normal": 1.822, "Pothole": 0.689}
    assert splitting.selection_rows(parts).where("split = 'test'").isEmpty()


def test_first_wins_and_written_split(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.png", 1, "Pothole", "x"), ("a/0.png", 0, "Pothole", "x"), ("b/2.png", 0, "Normal", "x"), ("c/3.png", 0, "Normal", "y"), ("c/4.png", 0, "Normal", "y")], "path string, rank int, label string, sha256 string")
    kept = splitting.first_wins(rows, [F.col("rank"), F.col("label"), F.col("path")])
    assert sorted(r["path"] for r in kept.collect()) == ["b/2.png", "c/3.png"]
    out = str(tmp_path / "split")
    written = splitting.materialise_split(splitting.stratified_split(kept), out, "path")
    assert {r["dest_name"] for r in written.collect()} == {"x_2.png", "y_3.png"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        splitting.materialise_split(splitting.stratified_split(kept), out, "path")
    with pytest.raises(RuntimeError):
        splitting.require_no_overlap(spark.createDataFrame([("train", "x"), ("test", "x")], "split string, sha256 string"))


def test_metrics_of_record(spark):
    counts = spark.createDataFrame([(126, 2, 7, 48)], "tp long, fp long, fn long, tn long")
    got = {(r["metric"], r["class_name"]): r["value"] for r in metrics.figures(counts).collect()}
    assert got["accuracy", "all"] == 0.950820 and got["f1", "macro avg"] == 0.939901
    alone = {(r["metric"], r["class_name"]): r["value"] for r in metrics.figures(spark.createDataFrame([(7, 0, 0, 0)], "tp long, fp long, fn long, tn long")).collect()}
    assert alone["f1", "macro avg"] == 1.0 and alone["f1", "Normal"] == 0.0
    assert got["precision", "Pothole"] == 0.984375 and got["recall", "Pothole"] == 0.947368 and got["recall", "Normal"] == 0.96
    never = {(r["metric"], r["class_name"]): r["value"] for r in metrics.figures(spark.createDataFrame([(0, 0, 5, 5)], "tp long, fp long, fn long, tn long")).collect()}
    assert never["precision", "Pothole"] == 0.0 and never["f1", "Pothole"] == 0.0


def test_roc_auc(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    auc = lambda rows: metrics.roc_auc(spark.createDataFrame(rows, "y int, p double"), F.col("y"), F.col("p")).first()["auc"]
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc(pairs) == pytest.approx(want)
    assert auc([(y, p**3) for y, p in pairs]) == pytest.approx(want)
    assert auc([(y, 0.3) for y, _ in pairs]) == 0.5
    assert auc([(1, 0.3), (1, 0.4)]) is None
    assert auc([*pairs, (0, 1.5), (1, -0.5), (0, float("nan")), (1, None)]) == pytest.approx(want)


def test_probabilities(spark):
    rows = spark.createDataFrame([(0, float("nan")), (1, None), (2, -0.1), (3, 0.0), (4, 0.5), (5, 1.0), (6, 1.2)], "event_id int, p double")
    got = {r["event_id"]: (r["label"], r["confidence"]) for r in triage.decide(rows, F.col("p")).collect()}
    assert got == {0: ("Invalid", None), 1: ("Invalid", None), 2: ("Invalid", None), 3: ("Normal", 1.0), 4: ("Pothole", 0.5), 5: ("Pothole", 1.0), 6: ("Invalid", None)}
    guess = {r["event_id"]: r["g"] for r in rows.select("event_id", numbers.predicted(F.col("p"), 0.5).alias("g")).collect()}
    assert guess == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 1, 6: None}


def test_upload_names(spark):
    rows = spark.createDataFrame([("a.jpg",), ("b.PNG",), ("c",), (None,), ("d.gif",)], "name string")
    assert [r[0] for r in rows.select(paths.uploadable(F.col("name"))).collect()] == [True, True, True, True, False]


class Fixed:
    def __init__(self, p: float):
        self.p = p

    def predict(self, batch):
        return np.full((len(batch), 1), self.p)


def test_predict_image():
    config = {"input_image": {"image_size": [224, 224]}, "prediction_rule": {"threshold": 0.5}, "class_mapping": {"0": "Normal", "1": "Pothole"}}
    image = np.zeros((224, 224, 3), np.float32)
    assert triage.predict_image(image, Fixed(0.75), config) == {"label": "Pothole", "pothole_probability": 0.75, "threshold": 0.5, "image_size": [224, 224]}
    with pytest.raises(ValueError, match="invalid probability"):
        triage.predict_image(image, Fixed(1.2), config)


def test_score_images(spark):
    class Quarter:  # of this test, so that it travels with it
        def predict(self, batch):
            return np.full((len(batch), 1), 0.25)

    rows = spark.createDataFrame([(f"p{k}", [0.0] * 48) for k in range(70)], "path string, pixels array<float>")
    assert triage.score_images(rows, Quarter, (4, 4)).where("p = 0.25").count() == 70


def test_registry(spark, tmp_path):
    run = lambda name, f1, valid: (name, "", "", "", 1.0, valid, f1, f1, f1, f1, f1, f1)
    first = spark.createDataFrame([run("a", 0.5, "yes"), run("b", 0.9, "no")], EXPERIMENT)
    runs = registry.upsert(first, spark.createDataFrame([run("a", 0.7, "yes")], EXPERIMENT).drop("valid_for_selection"))
    assert {(r["run_name"], r["macro_f1"], r["valid_for_selection"]) for r in runs.collect()} == {("a", 0.7, None), ("b", 0.9, "no")}
    assert registry.best_valid(runs).isEmpty()
    assert registry.best_valid(first).first()["run_name"] == "a"
    registry.save(runs, str(tmp_path / "runs"))
    assert files.read_registry(spark, str(tmp_path / "runs")).count() == 2
    assert files.read_registry(spark, str(tmp_path / "none")).isEmpty()
    for name, f1 in (("c", 0.8), ("a", 0.9)):
        there = files.read_registry(spark, str(tmp_path / "runs"))
        registry.replace(registry.upsert(there, spark.createDataFrame([run(name, f1, "yes")], EXPERIMENT)), str(tmp_path / "runs"))
    assert {(r["run_name"], r["macro_f1"]) for r in files.read_registry(spark, str(tmp_path / "runs")).collect()} == {("a", 0.9), ("b", 0.9), ("c", 0.8)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["runs"]


def test_config(spark, tmp_path):
    good = {"class_mapping": {"0": "Normal"}, "input_image": {"image_size": [2, 2]}, "prediction_rule": {"threshold": 0.5}}
    for name, text in {"good": json.dumps(good), "bad": "{", "short": '{"class_mapping": {}}'}.items():
        (tmp_path / name).write_text(text)
    assert files.load_config(spark, str(tmp_path / "good")) == good
    with pytest.raises(ValueError, match="not JSON"):
        files.load_config(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="input_image"):
        files.load_config(spark, str(tmp_path / "short"))
    with pytest.raises(FileNotFoundError):
        files.load_config(spark, str(tmp_path / "none"))


def test_head_reloads_alike(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4))
    rows = spark.createDataFrame([([float(v) for v in r], int(r[0] > 0)) for r in x], "v array<float>, y int")
    model = training.fit_head(rows, "v", "y")
    model.write().save(str(tmp_path / "head"))
    again = LogisticRegressionModel.load(str(tmp_path / "head"))
    a, b = ([r["p"] for r in training.score(rows, m, "v").collect()] for m in (model, again))
    assert a == b
    assert training.history(model)[0][0] == 0
    assert sum((p >= 0.5) == bool(r["y"]) for p, r in zip(a, rows.collect(), strict=True)) > 54


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.9), (2, 3.0)], "event_id long, p double").withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    rows.write.parquet(str(tmp_path / "in"))
    query = triage_feed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["event_id"], r["label"]) for r in spark.table("feed").collect()) == [(1, "Pothole"), (2, "Invalid")]


def test_whole_audit_and_split(spark, tree, tmp_path):
    from sparkmill.__main__ import main
    from sparkmill.plans import entries

    found = entries.audit(spark, tree)
    assert [(r["split"], r["filepath"].rsplit("/", 1)[1]) for r in found.unreadable.collect()] == [("train", "c.jpg")]
    assert found.manifest.count() == 6 and found.duplicates.count() == 6
    main(["audit", "--data-dir", tree, "--output", str(tmp_path / "report"), "--manifest-output", str(tmp_path / "manifest")])
    report = {r["split"]: json.loads(r["report"]) for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert {k: (v["classes"], v["unreadable_images"]) for k, v in report.items()} == {"train": (["Normal", "Pothole"], 1), "val": (["Normal", "Pothole"], 0), "test": ([], 0)}
    assert report["val"]["path"].endswith("/Validation")
    whole = entries.document(found, tree)
    assert [x.rsplit("/", 1)[1] for x in whole["splits"]["train"]["unreadable_images"]] == ["c.jpg"] and whole["splits"]["test"]["classes"] == []
    assert sorted(sorted(x.rsplit("/", 1)[1] for x in group) for group in whole["duplicate_files_across_splits"]) == [["a b.png", "e.png"], ["a2.PNG", "f.png"], ["d.png", "g.png"]]
    assert set(whole["warnings"]) == {"test: expected two classes but found []", "class folders differ between splits", "3 exact duplicate groups cross splits"}
    assert spark.read.csv(str(tmp_path / "manifest"), header=True).count() == 6
    pool = {r["path"].rsplit("/", 1)[1]: r["label"] for r in entries.pool(spark, tree).collect()}
    assert pool == {"a b.png": "Normal", "a2.PNG": "Normal", "d.png": "Pothole"}
    main(["split", "--data-dir", tree, "--output", str(tmp_path / "clean")])
    written = spark.read.parquet(str(tmp_path / "clean/split"))
    assert written.count() == 3 and written.select("sha256").distinct().count() == 3
    assert spark.read.csv(str(tmp_path / "clean/issues"), header=True).count() == 4
    with pytest.raises(ValueError):
        entries.pool(spark, f"{tree}/test")


def test_evaluation_files_and_saved_head(spark, tmp_path):
    from sparkmill.__main__ import main
    from sparkmill.sources.sinks import load_head, save_head

    spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.5)], "y int, p double").write.parquet(str(tmp_path / "scores"))
    main(["evaluate", "--scores", str(tmp_path / "scores"), "--output", str(tmp_path / "out")])
    figures = {(r["metric"], r["class_name"]): r["value"] for r in spark.read.json(str(tmp_path / "out/metrics")).collect()}
    assert figures["threshold", "all"] == 0.5 and figures["accuracy", "all"] == 0.5 and figures["roc_auc", "all"] == 0.75
    assert spark.read.csv(str(tmp_path / "out/predictions"), header=True).count() == 4
    rows = spark.createDataFrame([([0.0, 1.0], 0), ([1.0, 0.0], 1)] * 5, "v array<float>, y int")
    model = training.fit_head(rows, "v", "y")
    save_head(model, str(tmp_path / "head"))
    assert load_head(str(tmp_path / "head")).coefficients == model.coefficients
    assert spark.read.json(str(tmp_path / "head/history")).count() == len(training.history(model))


def jpeg(spark, rows: np.ndarray, turn: int = 0) -> bytes:
    """A JPEG file of (height, width, 3), with an Exif orientation where asked."""
    jvm, (height, width, _) = spark._jvm, rows.shape
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(rows[y, x, 0]) << 16 | int(rows[y, x, 1]) << 8 | int(rows[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    if not turn:
        return data
    exif = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data[2:]


def webp(width: int, height: int) -> bytes:
    body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14) + bytes(11)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def test_jpeg_turns(spark):
    left = np.zeros((32, 64, 3), np.uint8)
    left[:, :32] = 250  # bright on the left
    bright = {}
    for turn in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9):
        x = pixels.decode(spark, jpeg(spark, left, turn))
        halves = {"left": x[:, : x.shape[1] // 2], "right": x[:, x.shape[1] // 2 :], "top": x[: x.shape[0] // 2], "bottom": x[x.shape[0] // 2 :]}
        bright[turn] = (x.shape[:2], max(halves, key=lambda k: halves[k].mean()))
    wide, tall = (32, 64), (64, 32)
    assert bright == {0: (wide, "left"), 1: (wide, "left"), 2: (wide, "right"), 3: (wide, "right"), 4: (wide, "left"), 5: (tall, "top"), 6: (tall, "top"), 7: (tall, "bottom"), 8: (tall, "bottom"), 9: (wide, "left")}


@pytest.mark.parametrize("turn", range(1, 9))
def test_turned_like_a_plain_rule(turn):
    x = np.arange(6).reshape(2, 3, 1)
    flip, rot = (lambda v: v[:, ::-1]), (lambda v, k: np.rot90(v, k))
    want = {1: x, 2: flip(x), 3: rot(x, 2), 4: x[::-1], 5: rot(flip(x), 1), 6: rot(x, 3), 7: rot(flip(x), 3), 8: rot(x, 1)}[turn]
    assert (pixels.turned(x, turn) == want).all()


def test_webp_containers():
    from sparkmill.functions.containers import webp_size

    assert webp_size(webp(640, 480)) == (640, 480)
    lossy = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20) + bytes(4)
    assert webp_size(b"RIFF" + struct.pack("<I", 12 + len(lossy)) + b"WEBPVP8 " + struct.pack("<I", len(lossy)) + lossy) == (30, 20)
    for bad in (b"", b"RIFF", b"<html>", webp(5, 5)[:-9], webp(5, 5).replace(b"WEBP", b"WAVE"), webp(5, 5).replace(b"VP8L", b"XXXX")):
        assert webp_size(bad) is None


def test_webp_files_and_empty_class_folders(spark, tmp_path):
    from sparkmill.plans import entries

    for name in ("train/Normal", "train/Pothole", "valid/Normal", "valid/Pothole", "test/Normal"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "train/Normal/a.webp").write_bytes(webp(9, 9))
    (tmp_path / "train/Normal/b.webp").write_bytes(b"nothing")
    (tmp_path / "train/Pothole/c.png").write_bytes(png(np.zeros((2, 2, 3))))
    found = entries.audit(spark, str(tmp_path))
    assert [r["filepath"].rsplit("/", 1)[1] for r in found.unreadable.collect()] == ["b.webp"] and found.manifest.count() == 2
    report = {r["split"]: json.loads(r["report"]) for r in found.report.collect()}
    assert report["val"]["classes"] == ["Normal", "Pothole"] and report["val"]["class_counts"] == {"Normal": 0, "Pothole": 0} and report["test"]["classes"] == ["Normal"]
    assert {r["warning"] for r in found.warnings.collect()} == {"test: expected two classes but found [Normal]", "class folders differ between splits"}
    with pytest.raises(FileNotFoundError):
        entries.audit(spark, str(tmp_path / "none"))


def test_paths_of_other_authorities(spark):
    """A root without scheme or authority holds files whose paths have both."""
    rows = spark.createDataFrame([("hdfs://nn:8020/data/train/Normal/x/a.png",)], "path string")
    at = lambda k: rows.select(files._segment(F.col("path"), "hdfs://nn:8020/data", k)).first()[0]
    assert [at(k) for k in range(5)] == ["train", "Normal", "x", "a.png", None]
    assert files.qualified(spark, "/tmp/") == "file:/tmp" == files.qualified(spark, "file:///tmp")


@pytest.fixture(scope="module")
def roads(spark, tmp_path_factory):
    """Three folders of two classes that brightness tells apart."""
    root, rng = tmp_path_factory.mktemp("roads"), np.random.default_rng(3)
    for folder, n in (("train", 12), ("valid", 4), ("test", 3)):
        for label, level in (("Normal", 60), ("Pothole", 190)):
            for k in range(n):
                p = root / folder / label / f"{label}{k}.png"
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(png(np.clip(level + rng.integers(-30, 30, (12, 16, 3)), 0, 255)))
    return root


def test_train_and_predict(spark, roads, tmp_path, capsys):
    from sparkmill.__main__ import main
    from sparkmill.plans import entries

    records = entries.train(spark, str(roads), str(tmp_path / "head"), training.EpochSettings(epochs=8, rate=0.2), (24, 24))
    assert records[-1]["val_loss"] < records[0]["val_loss"] and records[-1]["val_accuracy"] == 1.0 and records[-1]["seconds"] >= 0
    assert spark.read.json(str(tmp_path / "head/history")).count() == len(records)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"class_mapping": {"0": "Normal", "1": "Pothole"}, "input_image": {"image_size": [30, 20]}, "prediction_rule": {"threshold": 0.5}}))
    for label in ("Normal", "Pothole"):
        path = str(roads / f"test/{label}/{label}0.png")
        with open(path, "rb") as f:
            by_file = triage.predict_from_artifacts(spark, f, str(tmp_path / "head"), str(config))
        got = triage.predict_from_artifacts(spark, path, str(tmp_path / "head"), str(config))
        assert got == by_file == triage.predict_from_artifacts(spark, (roads / f"test/{label}/{label}0.png").read_bytes(), str(tmp_path / "head"), str(config))
        assert got["label"] == label and got["image_size"] == [30, 20] and 0 <= got["pothole_probability"] <= 1
    main(["predict", "--model-path", str(tmp_path / "head"), "--image", str(roads / "test/Pothole/Pothole1.png")])
    assert capsys.readouterr().out.startswith("Pothole, confidence")
    for bad in ("none.png", "test/Pothole"):
        with pytest.raises((ValueError, FileNotFoundError)):
            triage.predict_file(spark, str(roads / bad), str(tmp_path / "head"))
    with pytest.raises(FileNotFoundError):
        triage.predict_file(spark, str(roads / "test/Pothole/Pothole1.png"), str(tmp_path / "no-head"))
    with pytest.raises(FileNotFoundError):
        entries.train(spark, str(roads / "train"), str(tmp_path / "other"))


def test_prepare_image(spark, tmp_path):
    rgba = np.zeros((10, 20, 4), np.uint8)
    rgba[:] = (10, 20, 30, 255)
    x = triage.prepare_image(spark, png(rgba), (224, 112))
    assert x.shape == (112, 224, 3) and x.dtype == np.float32 and np.allclose(x, [10, 20, 30], atol=1e-3)
    assert np.allclose(pixels.rescaled(x), np.array([10, 20, 30]) / 255, atol=1e-5) and np.allclose(pixels.centred(x), np.array([10, 20, 30]) / 127.5 - 1, atol=1e-5)
    for source, name in ((png(rgba), "road.gif"), (b"text", "road.png"), (b"", None)):
        with pytest.raises(ValueError):
            triage.prepare_image(spark, source, (8, 8), name)


def test_training_stops_early(spark):
    rng = np.random.default_rng(2)
    made = lambda n, noise: spark.createDataFrame([([float(v) for v in r], int(r[0] + noise * rng.standard_normal() > 0)) for r in rng.standard_normal((n, 6))], "features array<double>, y int").cache()
    head, records = training.fit_epochs(made(60, 0.1), made(60, 30.0), training.EpochSettings(epochs=40, patience=3, rate=0.5))
    best = min(range(len(records)), key=lambda k: records[k]["val_loss"])
    assert len(records) == best + 4 < 40 and set(training.MEASURES) < set(records[0])
    with pytest.raises(ValueError):
        training.fit_epochs(made(5, 0.0).where("y = 1"), made(5, 0.0))


def test_first_path_that_is_there(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert files.first_there(spark, str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        files.first_there(spark, str(tmp_path / "a"))


def test_dataset_has_classes_in_order(spark, roads):
    rows, classes = files.dataset(spark, str(roads), "train")
    assert classes == ["Normal", "Pothole"]
    assert {(r["path"].split("/")[-2], r["y"]) for r in rows.collect()} == {("Normal", 0), ("Pothole", 1)} and rows.count() == 24

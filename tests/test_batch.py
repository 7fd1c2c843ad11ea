from __future__ import annotations

import numpy as np
import pytest

from mattelake.plans import batch
from mattelake.sources import images
from mattelake.streaming import incremental


def picture(h=96, w=96):
    return np.full((h, w, 3), 120, np.uint8)


def middle(rgb):
    m = np.zeros(rgb.shape[:2], np.uint8)
    h, w = m.shape
    m[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4] = 255
    return m


def rows(spark, *items):
    return spark.createDataFrame([(n, *(p.shape[:2] if p is not None else (None, None)), p.tobytes() if p is not None else None, None if p is not None else "unreadable") for n, p in items], "source_file string, height int, width int, data binary, error string")


def one(spark, plugins, **more):
    return {r["source_file"]: r for r in batch.run(rows(spark, ("a.jpg", picture()), ("bad.jpg", None)), plugins, **more).collect()}


def box(x1=24, y1=24, x2=72, y2=72, score=0.99, **more):
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "score": score} | more


#: A person of whom the mask shows a third.
COVERED = box(8, 8, 88, 88)


def everything(rgb, boxes):
    return [np.ones(rgb.shape[:2], bool) for _ in boxes], [0.95] * len(boxes)


def agreeing(rgb, boxes):
    return [middle(rgb) > 0 for _ in boxes], [0.95] * len(boxes)


def test_plain_run_and_broken_file(spark):
    got = one(spark, batch.Plugins(middle, device="cpu", precision="fp32"))
    a, bad = got["a.jpg"], got["bad.jpg"]
    assert a["status"] == "READY" and a["sam_result"] == "not_requested" and a["filename"] == "a.png" and a["output_file"] == "ready/a.png"
    assert a["processing_time"] > 0 and (a["device"], a["precision"], a["foreground_refinement"]) == ("cpu", "fp32", "pymatting_ml")
    assert bad["status"] == "FAILED" and bad["error"] == "unreadable" and bad["output_file"] is None and bad["width"] is None and bad["processing_time"] >= 0


def test_full_mask_is_reviewed(spark):
    r = one(spark, batch.Plugins(lambda rgb: np.full(rgb.shape[:2], 255, np.uint8)))["a.jpg"]
    assert r["status"] == "REVIEW" and r["final_review_reasons"] == ["mask_issue"] and r["sam_result"] == "hard_review"
    assert r["review_details"] == ["foreground covers almost the entire image"]


def test_raising_plugin_fails_its_image_only(spark):
    def broken(rgb):
        raise ValueError("no model")

    r = one(spark, batch.Plugins(broken))["a.jpg"]
    assert r["status"] == "FAILED" and r["error"] == "ValueError: no model"


def test_memory_failure_is_tried_again_after_clearing(spark):
    state = []

    def flaky(rgb):
        if "clear" not in state:
            raise RuntimeError("CUDA out of memory")
        return middle(rgb)

    assert one(spark, batch.Plugins(flaky, clear=lambda: state.append("clear")))["a.jpg"]["status"] == "READY"


def test_refiner_must_keep_size_and_mask(spark):
    def other_mask(rgb, mask):
        return rgb, mask // 2

    r = one(spark, batch.Plugins(middle, refine=other_mask))["a.jpg"]
    assert r["error"] == "RuntimeError: Foreground refinement changed portrait alpha"
    assert one(spark, batch.Plugins(middle, refine=lambda rgb, mask: (rgb, mask)))["a.jpg"]["status"] == "READY"
    assert one(spark, batch.Plugins(middle, refine=lambda rgb, mask: rgb[:5]))["a.jpg"]["status"] == "FAILED"


def unsure(rgb, boxes):
    return [middle(rgb) > 0 for _ in boxes], [0.5] * len(boxes)


def boom(rgb, boxes):
    raise ValueError("boom")


@pytest.mark.parametrize(
    ("people", "segment", "result", "status", "reasons"),
    [
        ([box()], boom, "not_requested", "READY", []),
        ([COVERED], agreeing, "confirmed", "READY", []),
        ([COVERED], everything, "disagreement", "REVIEW", ["missing_body_part", "human_mask_disagreement"]),
        ([COVERED], unsure, "incomplete", "REVIEW", ["low_confidence"]),
        ([COVERED], boom, "error", "REVIEW", ["low_confidence"]),
        ([COVERED], None, "unavailable", "REVIEW", ["low_confidence"]),
        ([], boom, "not_requested", "READY", []),
        ([box(score=0.5)], boom, "not_requested", "READY", []),
    ],
)
def test_verifier_outcomes(spark, people, segment, result, status, reasons):
    r = one(spark, batch.Plugins(middle, lambda rgb, mask: people, segment))["a.jpg"]
    assert (r["sam_result"], r["status"], r["final_review_reasons"]) == (result, status, reasons)


def ring(rgb):
    m = np.zeros(rgb.shape[:2], np.uint8)
    m[20:76, 20:76] = 255
    m[36:60, 36:60] = 0
    return m


def test_a_weak_mask_signal_reaches_the_verifier(spark):
    def same(rgb, boxes):
        return [ring(rgb) > 0 for _ in boxes], [0.9] * len(boxes)

    r = one(spark, batch.Plugins(ring, lambda rgb, mask: [box(20, 20, 76, 76)], same))["a.jpg"]
    assert r["verification_triggers"] == ["large_internal_holes"] and r["sam_result"] == "confirmed"
    r = one(spark, batch.Plugins(ring, lambda rgb, mask: []))["a.jpg"]
    assert r["sam_result"] == "unavailable" and r["review_details"] == ["strong verification could not be requested for a suspicious result"]


def test_filtered_boxes_are_counted_where_none_is_left(spark):
    r = one(spark, batch.Plugins(middle, lambda rgb, mask: [box(0, 0, 10, 10, 0.6)]))["a.jpg"]
    assert r["sam_filtered_boxes"] == 1 and r["person_count"] == 1
    assert r["sam_filter_details"] == ["person 1: detector confidence 0.600 below prompt threshold"]


def test_every_model_is_asked_once_an_image_and_no_pixels_move(spark, tmp_path):
    def noted(name, f):
        def call(*a):
            with open(tmp_path / name, "a") as out:
                out.write("x")
            return f(*a)

        return call

    plugins = batch.Plugins(noted("predict", middle), noted("detect", lambda rgb, mask: [COVERED]), noted("segment", agreeing), noted("refine", lambda rgb, mask: rgb))
    done = spark.createDataFrame([("old.jpg",)], "source_file string")
    images_ = rows(spark, *[(f"{k}.jpg", picture()) for k in range(5)], ("old.jpg", picture()))
    out = batch.run(images_, plugins, done=done)
    for f in tmp_path.iterdir():
        f.unlink()
    assert len(batch.run(images_, plugins, done=done).collect()) == 5
    assert {f.name: len(f.read_text()) for f in tmp_path.iterdir()} == {"predict": 5, "detect": 5, "segment": 5, "refine": 5}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 4 and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_large_images_are_scored_at_the_analysis_size():
    from mattelake.config import EdgeRules
    from mattelake.operators import edges
    from mattelake.plans import adapters

    rgb, cut, mask = adapters.leaf(5, 320)
    small = edges.analysed(rgb, cut, mask, EdgeRules(analysis_size=160))[0]
    full, heat = edges.analysed(rgb, cut, mask, heat=True)
    assert small["edge_pixels"] < full["edge_pixels"] and heat.shape == mask.shape and 0 < heat.max() <= 1
    with pytest.raises(ValueError, match="differ"):
        edges.analysed(rgb, cut[:5], mask)


def test_ledger_of_a_run_sums_up(spark, tmp_path):
    from mattelake.operators import ledger
    from mattelake.schemas import LEDGER_COLUMNS
    from mattelake.sinks import reports
    from mattelake.sources import ledgers

    plugins = batch.Plugins(middle, lambda rgb, mask: [COVERED], boom)
    out = batch.run(rows(spark, ("a.jpg", picture()), ("bad.jpg", None)), plugins)
    assert set(out.columns) == set(LEDGER_COLUMNS)
    path = str(tmp_path / "report.csv")
    reports.export_ledger(out, path)
    assert open(path, encoding="utf-8-sig").readline().strip().split(",") == list(LEDGER_COLUMNS)
    back = ledgers.read_ledger(spark, path)
    r = ledger.summary(back).first()
    assert (r["total"], r["review"], r["failed"], r["sam_requests"], r["sam_errors"]) == (2, 1, 1, 1, 1) and r["total_time"] > 0
    a = {x["source_file"]: x for x in back.collect()}["a.jpg"]
    assert a["artifact_total_score"].split(".")[1].__len__() == 4 and a["sam_error"] == "ValueError: boom" and a["person_detector_zero"] == "False"


def test_done_images_are_skipped(spark):
    done = spark.createDataFrame([("a.jpg",)], "source_file string")
    assert set(one(spark, batch.Plugins(middle), done=done)) == {"bad.jpg"}


def write_jpeg(spark, path, rgb, orientation=None):
    """A JPEG by the JVM's own writer, with an EXIF orientation put in if one is given."""
    import struct

    jvm = spark._jvm
    h, w = rgb.shape[:2]
    img = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            img.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(path)))
    if orientation:
        data = path.read_bytes()
        tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
        body = b"Exif\0\0" + tiff
        path.write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:])


def test_photographs_of_all_kinds(spark, tmp_path):
    rgb = np.zeros((16, 24, 3), np.uint8)
    rgb[:8] = (200, 40, 30)
    rgb[8:] = (20, 60, 210)
    (tmp_path / "sub dir").mkdir()
    write_jpeg(spark, tmp_path / "a+b.jpg", rgb)
    write_jpeg(spark, tmp_path / "sub dir" / "ü.JPEG", rgb, 6)
    (tmp_path / "c.png").write_bytes(images.write_png(rgb))
    (tmp_path / "d.webp").write_bytes(b"RIFF" + rgb.tobytes())
    decoders = {".webp": lambda raw: np.frombuffer(raw[4:], np.uint8).reshape(16, 24, 3)}
    got = {r["source_file"]: r for r in images.read_images(spark, str(tmp_path), decoders=decoders).collect()}
    assert set(got) == {"a+b.jpg", "sub dir/ü.JPEG", "c.png", "d.webp"} and all(r["error"] is None for r in got.values())
    pixels = {n: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3).astype(int) for n, r in got.items()}
    # Rows beside the change of colour blend in a JPEG.
    plain = np.r_[0:5, 11:16]
    assert np.abs(pixels["a+b.jpg"] - rgb)[plain].max() < 12 and (pixels["c.png"] == rgb).all() and (pixels["d.webp"] == rgb).all()
    # Orientation 6: the stored top is the right side of the upright picture.
    assert pixels["sub dir/ü.JPEG"].shape == (24, 16, 3) and np.abs(pixels["sub dir/ü.JPEG"][:, -1] - (200, 40, 30)).max() < 12
    status = {r["source_file"]: r["status"] for r in batch.run(images.read_images(spark, str(tmp_path), decoders=decoders), batch.Plugins(middle)).collect()}
    assert "FAILED" not in status.values() and len(status) == 4


def test_png_round_trip_and_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((5, 7, 3), (4, 4, 1), (3, 9, 4)):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (images.read_png(images.write_png(img)) == img).all()
    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "фото.PNG").write_bytes(images.write_png(picture(6, 5)))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_bytes(b"x")
    listed = images.list_files(spark, str(tmp_path))
    assert listed.count() == 2
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.decode(listed.select("path").join(content, "path")).collect()}
    assert (got["фото.PNG"]["height"], got["фото.PNG"]["width"], got["фото.PNG"]["error"]) == (6, 5, None)
    assert got["broken.png"]["error"] == "not a PNG"


@pytest.mark.parametrize("tag", range(1, 9))
def test_orientation_of_corner(tag):
    img = np.arange(6).reshape(2, 3, 1)
    top_left = {1: 0, 2: 2, 3: 5, 4: 3, 5: 0, 6: 3, 7: 5, 8: 2}[tag]
    assert images.orient(img, tag)[0, 0, 0] == top_left


def test_stream_runs_each_file_once(spark, tmp_path):
    from pyspark.sql import functions as F

    inbox, out, state = (tmp_path / n for n in ("in", "ledger", "state"))
    inbox.mkdir()

    def process(files):
        return files.select("source_file", F.lit("READY").alias("status"), F.lit("f").alias("pipeline_fingerprint"))

    for name in ("a.png", "b.png"):
        (inbox / name).write_bytes(images.write_png(picture(4, 4)))
        q = incremental.run_new(incremental.watch(spark, str(inbox)), process, str(out), str(state))
        q.awaitTermination(120)
    rows = spark.read.option("header", True).csv(str(out))
    assert sorted(r["source_file"].rsplit("/", 1)[-1] for r in rows.collect()) == ["a.png", "b.png"]

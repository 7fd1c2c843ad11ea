from __future__ import annotations

import json
import random

from mattelake import config
from mattelake.operators import ledger
from mattelake.plans import adapters  # noqa: F401
from mattelake.schemas import LEDGER_COLUMNS
from mattelake.sinks import reports
from mattelake.sources import ledgers


def test_columns():
    assert len(LEDGER_COLUMNS) == len(set(LEDGER_COLUMNS)) == 59


def test_round_trip_with_line_breaks_and_later_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a/ф.jpg", "READY", ["x", "y"], 'say "hi"\nthere', True), ("b.jpg", "FAILED", [], None, None)], "source_file string, status string, artifact_flags array<string>, error string, touch_top boolean")
    path = str(tmp_path / "ledger.csv")
    reports.export_ledger(rows, path)
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    back = {r["source_file"]: r for r in ledgers.read_ledger(spark, path).collect()}
    assert back["a/ф.jpg"]["error"] == 'say "hi"\nthere' and back["a/ф.jpg"]["artifact_flags"] == "x;y" and back["a/ф.jpg"]["touch_top"] == "True"
    assert set(back) == {"a/ф.jpg", "b.jpg"}


def test_last_row_wins_and_blank_keys_go(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("b", 2, "x"), ("a", 3, "new"), ("", 4, "y"), (None, 5, "z")], "k string, n int, v string")
    got = {r["k"]: (r["v"], r["first_position"]) for r in ledger.last_rows(df, "k", "n").collect()}
    assert got == {"a": ("new", 1), "b": ("x", 2)}


def test_resume_needs_the_output(spark):
    df = spark.createDataFrame([("a", "READY", "out/a.png"), ("b", "READY", "out/b.png"), ("c", "FAILED", None)], "source_file string, status string, output_file string")
    outputs = spark.createDataFrame([("out/a.png",)], "path string")
    done = ledger.reusable(df, outputs)
    assert {r["source_file"] for r in done.collect()} == {"a", "c"}
    assert {r["source_file"] for r in ledger.reusable(df, outputs, retry_failed=True).collect()} == {"a"}
    assert [r["source_file"] for r in ledger.pending(df, done).collect()] == ["b"]


def test_summary_of_nothing(spark):
    r = ledger.summary(spark.createDataFrame([], "status string, processing_time string, sam_requested string, sam_ran string")).first()
    assert r["total"] == 0 and r["p95_time"] == 0 and r["sam_percent"] == 0


def test_summary_reads_text(spark):
    df = spark.createDataFrame([("READY", "1.0", "True", "yes"), ("REVIEW", "3", " 1 ", ""), ("FAILED", "", "no", None)], "status string, processing_time string, sam_requested string, sam_ran string")
    r = ledger.summary(df).first()
    assert (r["ready"], r["review"], r["failed"], r["total_time"], r["median_time"], r["sam_requests"], r["sam_runs"]) == (1, 1, 1, 4.0, 1.0, 2, 1)


def test_sample_matches_the_seed(spark):
    files = spark.createDataFrame([(f"F{k:02d}" if k % 2 else f"f{k:02d}",) for k in range(30)], "path string")
    got = [r["path"] for r in ledger.sample_files(files, 7).orderBy("pick").collect()]
    ordered = sorted((f"F{k:02d}" if k % 2 else f"f{k:02d}" for k in range(30)), key=str.casefold)
    assert got == random.Random(42).sample(ordered, 7)
    assert ledger.sample_files(files, 99).count() == 30


def test_history_keeps_the_newest(tmp_path, spark):
    path = str(tmp_path / "history.json")
    for k in range(105):
        reports.add_history(path, {"timestamp": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}", "total": k})
    rows = json.load(open(path))
    assert len(rows) == 100 and rows[0]["total"] == 104
    assert ledgers.read_history(spark, path).count() == 100
    assert ledgers.read_history(spark, str(tmp_path / "none.json")).count() == 0


def test_colliding_outputs(spark):
    df = spark.createDataFrame([("d/a.jpg",), ("d/a.png",), ("d.x/b",)], "source_file string")
    got = {r["source_file"]: r["filename"] for r in ledger.colliding_outputs(df).collect()}
    assert got == {"d/a.jpg": "d/a.png", "d/a.png": "d/a~2.png", "d.x/b": "d.x/b.png"}


def test_later_runs_win_whatever_their_size(spark, tmp_path):
    path = str(tmp_path / "ledger")
    columns = "source_file string, status string"
    reports.append_ledger(spark.createDataFrame([("a.jpg", "FAILED"), ("b.jpg", "READY")], columns).repartition(2), path)
    many = [(f"{k}.jpg", "READY") for k in range(300)]
    reports.append_ledger(spark.createDataFrame([*many, ("a.jpg", "READY")], columns).repartition(4), path)
    reports.append_ledger(spark.createDataFrame([("b.jpg", "REVIEW")], columns), path)
    got = {r["source_file"]: r["status"] for r in ledgers.read_ledger(spark, path).collect()}
    assert got["a.jpg"] == "READY" and got["b.jpg"] == "REVIEW" and len(got) == 302


def test_columns_go_by_the_header(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text("status,source_file,unknown\nREADY,a.jpg,1\nFAILED,a.jpg,2\n", encoding="utf-8-sig")
    r = ledgers.read_ledger(spark, str(path)).first()
    assert (r["source_file"], r["status"], r["width"]) == ("a.jpg", "FAILED", None) and "unknown" not in r.asDict()


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"qc": {"foreground_threshold": 30, "unknown": 1}, "artifacts": {"hard_residual_max_score": 0.8}, "verification": {"sam_enabled": False}, "extensions": [".JPG"], "nonsense": 2}))
    s = config.load(str(path))
    assert s.mask.foreground == 30 and s.edges.hard_residual == (0.65, 0.8) and not s.verify.enabled and s.extensions == (".jpg",)
    assert config.load(str(tmp_path / "no.json")) == config.Settings() and config.overlay(config.Settings(), config.file_form(config.Settings())) == config.Settings()
    assert config.fingerprint(s) != config.fingerprint(config.Settings()) and len(config.fingerprint(s)) == 64
    assert config.fingerprint(config.overlay(config.Settings(), {"preview": {"width": 7}, "edge": {"enabled": True}})) == config.fingerprint(config.Settings())

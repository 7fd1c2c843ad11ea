"""Ledgers, summaries and histories to disk."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.functions import scalars
from mattelake.operators import ledger
from mattelake.schemas import LEDGER_COLUMNS

DETAILS = ("fast_qc_hard_details", "verification_trigger_details", "review_details", "artifact_hard_details", "sam_filter_details")
#: Columns written with four decimals.
FIXED = ("processing_time", "person_box_coverage_min", "sam_min_recall", "sam_min_iou")


def ledger_rows(rows: DataFrame) -> DataFrame:
    """The ledger's columns as text, in file order: lists joined, missing columns and nulls blank, others left out."""
    have = dict(rows.dtypes)

    def text(name: str):
        if name not in have:
            return F.lit("")
        c = F.col(name)
        if have[name].startswith("array"):
            return F.coalesce(scalars.joined(c, "; " if name in DETAILS else ";"), F.lit(""))
        if have[name] == "boolean":
            return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
        if have[name] == "double" and (name in FIXED or (name.startswith("artifact_") and name.endswith("_score"))):
            return F.coalesce(F.format_string("%.4f", c), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    return rows.select(*[text(c).alias(c) for c in LEDGER_COLUMNS])


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds a run's rows as new part files, with the run's time and row numbers; the committer makes them visible at once."""
    now = datetime.now(UTC).isoformat(timespec="microseconds")
    stamped = ledger_rows(rows).withColumns({"run_at": F.lit(now), "row_no": F.monotonically_increasing_id().cast("string")})
    stamped.write.mode("append").option("header", True).option("escape", '"').csv(path)


def replace_file(path: str, body: bytes | Callable) -> None:
    """Writes a local file through a temporary one beside it, so readers see the old or the new."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(part, "wb") as f:
            if callable(body):
                body(f)
            else:
                f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def export_ledger(rows: DataFrame, path: str) -> None:
    """One local CSV file with a byte-order mark, written row by row; the driver holds one partition at a time."""
    import csv

    def body(f) -> None:
        f.write(b"\xef\xbb\xbf")
        text = io.TextIOWrapper(f, encoding="utf-8", newline="", write_through=True)
        writer = csv.writer(text)
        writer.writerow(LEDGER_COLUMNS)
        writer.writerows(ledger_rows(rows).toLocalIterator())
        text.detach()

    replace_file(path, body)


def write_summary(rows: DataFrame, path: str, **extra) -> dict:
    body = ledger.summary(rows).first().asDict() | {"stopped": False} | extra
    replace_file(path, json.dumps(body, ensure_ascii=False, indent=2).encode())
    return body


def add_history(path: str, entry: dict, limit: int = 100) -> None:
    """Puts a run at the head of a history file of at most ``limit`` runs; an unreadable file starts anew."""
    try:
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    except (OSError, ValueError):
        old = []
    replace_file(path, json.dumps([entry, *(old if isinstance(old, list) else [])][:limit], ensure_ascii=False, indent=2).encode())


def routed(rows: DataFrame, base: str) -> DataFrame:
    """Adds output_file: base, the status in lower case, the image's own folders, its name as PNG; failed rows have none."""
    target = F.concat(F.lit(base.rstrip("/") + "/"), F.lower("status"), F.lit("/"), scalars.png_name(F.col("source_file")))
    return rows.withColumn("output_file", F.when(F.col("status") != "FAILED", target))


def write_images(rows: DataFrame, path: str = "output_file", content: str = "png") -> DataFrame:
    """Writes each row's bytes from its executor, for folders that all executors share; returns path, bytes, error."""

    def run(batches: Iterable):
        import pyarrow as pa

        for b in batches:
            out = []
            for where, body in zip(b.column(path).to_pylist(), b.column(content).to_pylist()):
                try:
                    if where is None or body is None:
                        raise ValueError("nothing to write")
                    replace_file(where.removeprefix("file://"), body)
                    out.append((where, len(body), None))
                except (OSError, ValueError) as e:
                    out.append((where, 0, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "error"])

    return rows.select(path, content).mapInArrow(run, "path string, bytes long, error string")


def listen(spark, tell: Callable[[int, int], None]):
    """A streaming listener that reports (rows so far, rows of the last batch)."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        rows = 0

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            self.rows += event.progress.numInputRows
            tell(self.rows, event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    own = Progress()
    spark.streams.addListener(own)
    return own

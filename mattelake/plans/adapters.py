"""Test devices: the driver's tables reshaped into masks, boxes, ledgers and paths. Not part of a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sample(v, vec_id):
    """8-bit sample of an embedding component; the offset by id makes every rule's branch occur."""
    shift = (vec_id % 11).cast("int") - 5
    return F.rint(F.least(F.greatest((v.cast("double") * 16 + F.lit(0.5) + shift * F.lit(0.8)) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


SAMPLE_SQL = "CAST(round_even(least(greatest((16 * CAST(v AS DOUBLE) + 0.5::DOUBLE + (vec_id % 11 - 5) * 0.8::DOUBLE) * 255::DOUBLE, 0::DOUBLE), 255::DOUBLE), 0) AS INTEGER)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 mask of each embedding: image_id, height, width, alpha."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda v: sample(v, F.col("vec_id"))).alias("alpha"))


#: DuckDB: the pixels of ``rasters``.
PIXELS_SQL = f"""
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT vec_id AS image_id, i, i // 8 AS y, i % 8 AS x, {SAMPLE_SQL} AS a FROM e)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rasters with a row per pixel: image_id, y, x, a."""
    r = rasters(spark, sf_dir).select("image_id", F.posexplode("alpha").alias("i", "a"))
    return r.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "a")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of each order line; the order is the image. Scores and coverages are hundredths."""
    t = table(spark, sf_dir, "lineitem")
    x1, y1 = (F.col("l_partkey") % 80).cast("int"), (F.col("l_suppkey") % 60).cast("int")
    idx = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")
    return t.select(
        F.col("l_orderkey").alias("image_id"), idx.alias("box_idx"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.col("l_quantity").cast("int")).alias("x2"), (y1 + F.col("l_linenumber") * 10).alias("y2"),
        (F.lit(100) - F.rint(F.col("l_discount") * 400).cast("int")).alias("score100"),
        F.rint(F.col("l_tax") * 1000).cast("int").alias("coverage100"),
        F.least(F.lit(100), F.col("l_quantity").cast("int") * 2).alias("center100"),
    ).withColumns({"score": F.col("score100") / 100, "coverage": F.col("coverage100") / 100, "center_coverage": F.col("center100") / 100}).dropDuplicates(["image_id", "box_idx"])


def box_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``boxes`` as one array an image, in the order of box_idx: image_id, idx, boxes."""
    one = F.struct("x1", "y1", "x2", "y2", "score", "coverage", "center_coverage")
    rows = boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", one.alias("b")))).alias("_all"))
    return rows.select("image_id", F.transform("_all", lambda x: x["box_idx"]).alias("idx"), F.transform("_all", lambda x: x["b"]).alias("boxes"))


BOXES_SQL = """
bx AS (SELECT DISTINCT ON (image_id, box_idx) * FROM (
  SELECT l_orderkey AS image_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS box_idx,
    CAST(l_partkey % 80 AS INTEGER) AS x1, CAST(l_suppkey % 60 AS INTEGER) AS y1,
    CAST(l_partkey % 80 AS INTEGER) + CAST(l_quantity AS INTEGER) AS x2, CAST(l_suppkey % 60 AS INTEGER) + l_linenumber * 10 AS y2,
    100 - CAST(round_even(l_discount * 400, 0) AS INTEGER) AS score100,
    CAST(round_even(l_tax * 1000, 0) AS INTEGER) AS coverage100,
    least(100, CAST(l_quantity AS INTEGER) * 2) AS center100
  FROM lineitem))
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger row of each event: source_file, status, processing_time, seq."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "REVIEW").otherwise("READY")
    return e.select(
        F.concat(F.lit("u"), "user_id", F.lit("/"), "event_id", F.lit(".jpg")).alias("source_file"), status.alias("status"), F.col("value").alias("processing_time"),
        F.col("event_id").alias("seq"), "user_id", "event_type", "ts",
        F.when(F.col("event_id") % 3 == 0, F.lit(" True ")).when(F.col("event_id") % 3 == 1, F.lit("no")).alias("sam_requested"),
        F.when(F.col("event_id") % 6 == 0, F.lit("yes")).otherwise("").alias("sam_ran"), F.when(F.col("event_id") % 50 == 0, F.lit("RuntimeError: x")).alias("sam_error"),
    )


LEDGER_SQL = """
lg AS (SELECT 'u' || user_id || '/' || event_id || '.jpg' AS source_file,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REVIEW' ELSE 'READY' END AS status,
  value AS processing_time, event_id AS seq, user_id, event_type, ts,
  CASE WHEN event_id % 3 = 0 THEN ' True ' WHEN event_id % 3 = 1 THEN 'no' END AS sam_requested,
  CASE WHEN event_id % 6 = 0 THEN 'yes' ELSE '' END AS sam_ran, CASE WHEN event_id % 50 = 0 THEN 'RuntimeError: x' END AS sam_error FROM events)
"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of each document, in seven folders and with six kinds of suffix."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(k) for k in (".jpg", ".JPEG", ".png", ".webp", ".txt", ".tar.GZ")])
    return d.select("doc_id", F.concat(F.lit("Dir"), (F.col("doc_id") % 7).cast("string"), F.lit("/file"), F.floor(F.col("doc_id") / 2).cast("string"), F.get(kinds, (F.col("doc_id") % 6).cast("int"))).alias("path"))


PATHS_SQL = """
pt AS (SELECT doc_id, 'Dir' || (doc_id % 7) || '/file' || (doc_id // 2) ||
  ['.jpg', '.JPEG', '.png', '.webp', '.txt', '.tar.GZ'][CAST(doc_id % 6 AS INTEGER) + 1] AS path FROM documents)
"""


def leaf(key: int, side: int = 160) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rgb, cutout, mask) of a four-lobed shape whose edge is as wide, and as tainted by the background, as its key says."""
    y, x = np.indices((side, side)) - (side - 1) / 2
    turn = np.arctan2(y, x)
    away = np.hypot(x, y) - side * (0.31 + 0.05 * np.cos(4 * turn + key))
    alpha = np.clip(0.5 - away / (2 + key % 7 * 3), 0, 1)
    subject = np.array([200.0, 90, 60]) if key % 3 else np.array([70.0, 70, 74])
    back = np.array([40.0, 160, 70]) if key % 3 else np.array([215.0, 214, 212])
    mixed = lambda share: np.rint(subject * share[..., None] + back * (1 - share[..., None])).astype(np.uint8)
    return mixed(alpha >= 0.5), mixed(1 - key % 2 * (1 - alpha) * 0.8), np.rint(alpha * 255).astype(np.uint8)


def leaves(keys: DataFrame, key: str) -> DataFrame:
    """A ``leaf`` for every key: key, height, width, rgb, cutout, mask."""

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                planes = leaf(k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([planes[0].shape[i]], pa.int32()) for i in (0, 1)), *(pa.array([p.tobytes()], pa.binary()) for p in planes)], names=[key, "height", "width", "rgb", "cutout", "mask"])

    return keys.select(F.col(key).cast("long")).mapInArrow(run, f"{key} long, height int, width int, rgb binary, cutout binary, mask binary")

"""Ledgers: one row per processed image. Resuming, merging, counting and summing runs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mattelake.functions import scalars


#: Keys that may be broadcast; at 200 bytes each they take 20 MB.
BROADCAST_ROWS = 100_000


def last_rows(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each non-blank key, with first_position: where the key came first."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    named = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    got = named.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, position).alias("_row"), F.min(position).alias("first_position"))
    return got.select("_row.*", "first_position")


def reusable(rows: DataFrame, outputs: DataFrame, output: str = "output_file", retry_failed: bool = False) -> DataFrame:
    """Rows that need no second run: failed ones, and those whose output is among ``outputs`` (path)."""
    there = rows.join(outputs.select(F.col("path").alias("_path")).distinct(), F.col(output) == F.col("_path"), "left_semi")
    done = there.where("status <> 'FAILED'")
    return done if retry_failed else done.unionByName(rows.where("status = 'FAILED'"))


def with_fingerprint(rows: DataFrame, fingerprint: str | None) -> DataFrame:
    return rows if fingerprint is None else rows.where(F.col("pipeline_fingerprint") == fingerprint)


def pending(sources: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    """Sources not done yet; decided before any image is decoded.

    Keys of up to ``BROADCAST_ROWS`` done sources are sent to the executors, so the sources stay where they
    are; beyond that both sides are dealt by key.
    """
    keys = done.select(key).distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return sources.join(F.broadcast(keys) if few else keys, key, "left_anti")


def merge(resumed: DataFrame, fresh: DataFrame) -> DataFrame:
    return resumed.unionByName(fresh, allowMissingColumns=True)


def colliding_outputs(sources: DataFrame, key: str = "source_file") -> DataFrame:
    """Sources with their output name, numbered where several share one (a.jpg and a.png)."""
    named = sources.withColumn("filename", scalars.png_name(F.col(key)))
    nth = F.row_number().over(Window.partitionBy("filename").orderBy(key))
    return named.withColumn("_nth", nth).withColumn("filename", F.when(F.col("_nth") == 1, F.col("filename")).otherwise(F.concat(F.regexp_replace("filename", r"\.png$", ""), F.lit("~"), F.col("_nth").cast("string"), F.lit(".png")))).drop("_nth")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def _p95(c: Column) -> Column:
    return F.percentile(c, 0.95)


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts by status, timing, verifier use. An empty ledger gives zeros."""
    t = scalars.number(F.col("processing_time").cast("string"))
    asked, ran = scalars.truthy(F.col("sam_requested").cast("string")), scalars.truthy(F.col("sam_ran").cast("string"))
    n = F.count("*")
    errors = F.count_if(F.coalesce(F.col("sam_error"), F.lit("")) != "") if "sam_error" in rows.columns else F.lit(0).cast("long")
    return rows.agg(
        n.alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "REVIEW", "FAILED")],
        F.round(F.coalesce(F.sum(t), F.lit(0.0)), 6).alias("total_time"),
        F.round(F.coalesce(F.avg(t), F.lit(0.0)), 6).alias("average_time"),
        F.round(F.coalesce(F.median(t), F.lit(0.0)), 6).alias("median_time"),
        F.round(F.coalesce(_p95(t), F.lit(0.0)), 6).alias("p95_time"),
        F.count_if(asked).alias("sam_requests"),
        F.count_if(ran).alias("sam_runs"),
        F.round(F.count_if(ran) * 100.0 / F.greatest(n, F.lit(1)), 6).alias("sam_percent"),
        errors.alias("sam_errors"),
    )


def running_mean(rows: DataFrame, group: str, order: str, value: str = "processing_time") -> DataFrame:
    """Adds mean_so_far, by the order within each group (a run)."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean_so_far", F.avg(value).over(so_far))


def newest(history: DataFrame, limit: int = 100) -> DataFrame:
    """The latest runs first; the limit is the history's length."""
    return history.orderBy(F.desc("timestamp"), F.desc("seq")).limit(limit)


def sample_positions(n: int, size: int, seed: int = 42) -> list[int]:
    """Positions that a seeded sample takes of n ordered files, in its order; all in order where n is not larger."""
    return list(range(n)) if n <= size else random.Random(seed).sample(range(n), size)


def sample_files(files: DataFrame, size: int, seed: int = 42, path: str = "path") -> DataFrame:
    """The seeded sample of a listing: files ordered by lower-case path, with position and pick.

    Positions come from counts per range partition, so the sort is never in one task.
    """
    spark = files.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = files.withColumn("_fold", F.lower(path)).repartitionByRange(parts, "_fold", path).sortWithinPartitions("_fold", path)
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    before, base = 0, []
    for part, n in sorted(tuple(r) for r in ordered.groupBy("_part").count().collect()):
        base.append((part, before))
        before += n
    if not base:
        return files.withColumn("position", F.lit(0).cast("long")).withColumn("pick", F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_fold", path)) - 1
    starts = spark.createDataFrame(base, "_part int, _base long")  # a row for each partition
    placed = ordered.withColumn("_in", within).join(F.broadcast(starts), "_part").withColumn("position", F.col("_base") + F.col("_in"))
    picks = spark.createDataFrame([(p, k) for k, p in enumerate(sample_positions(before, size, seed))], "position long, pick int")
    return placed.drop("_fold", "_part", "_in", "_base").join(picks, "position")


def contact_sheet(names: DataFrame, columns: int = 4, name: str = "filename", order: str = "position") -> DataFrame:
    """Cell of every image on the sheet and its caption of 38 code points at most."""
    x, y = scalars.sheet_cell(F.col(order), columns)
    return names.withColumns({"cell_x": x, "cell_y": y, "caption": F.substring(name, 1, 38)})


def stale_outputs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Outputs of an earlier run whose image now goes elsewhere."""
    a, b = previous.alias("a"), current.alias("b")
    return a.join(b, F.col("a.source_file") == F.col("b.source_file")).where("a.output_file <> b.output_file").select("a.source_file", "a.output_file")

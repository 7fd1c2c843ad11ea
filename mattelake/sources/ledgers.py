"""Ledgers and histories on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mattelake.operators import ledger
from mattelake.schemas import HISTORY, LEDGER, LEDGER_COLUMNS, RUN_COLUMNS


def read_ledger(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """The last row of each source file, as text columns; of one fingerprint only if one is given.

    A file or a folder of files: with a header, perhaps a byte-order mark and line breaks in quotes. Columns
    go by the header, whatever their order; those it lacks are null. Of rows of one source file the last
    is that of the latest run (``run_at``, which appended files have), then of the latest file, then the
    last in its file.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = reader.schema(schema).option("enforceSchema", True).csv(path)
    have = {c: F.col(c) if c in header else F.lit(None).cast("string") for c in (*LEDGER_COLUMNS, *RUN_COLUMNS)}
    # A file with line breaks in quotes is read by one task, so this number rises within it.
    place = F.struct(F.coalesce(have["run_at"], F.lit("")), F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id())
    placed = raw.select(*[c.alias(n) for n, c in have.items() if n in LEDGER_COLUMNS], place.alias("_place"))
    return ledger.with_fingerprint(ledger.last_rows(placed, "source_file", "_place"), fingerprint).drop("_place", "first_position")


def read_ledger_or_none(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    try:
        return read_ledger(spark, path, fingerprint)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Past runs; a missing or unreadable file is an empty history."""
    try:
        rows = spark.read.schema(HISTORY).option("multiLine", True).json(path)
        return rows.where("timestamp is not null")
    except AnalysisException:
        return spark.createDataFrame([], HISTORY)


def runtime_facts(spark: SparkSession) -> DataFrame:
    """One row about the session: versions, parallelism, shared folders."""
    c = spark.sparkContext
    facts = (spark.version, c.master, c.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"))
    return spark.createDataFrame([facts], "spark string, master string, parallelism int, shuffle_partitions string, adaptive string")

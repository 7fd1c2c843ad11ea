"""Incremental runs over a growing image folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mattelake.config import Settings
from mattelake.functions import scalars
from mattelake.operators import ledger
from mattelake.sinks.reports import append_ledger
from mattelake.sources.ledgers import read_ledger_or_none

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """The folder's images as a stream of files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    return files.where(scalars.is_image(F.col("path"), settings.extensions)).withColumn("source_file", F.col("path"))


def run_new(files: DataFrame, process: Callable[[DataFrame], DataFrame], ledger_path: str, checkpoint: str, fingerprint: str | None = None, once: bool = True) -> StreamingQuery:
    """Processes files that the ledger does not have, batch by batch, and appends their rows.

    The checkpoint gives each file to one batch; the anti-join makes a repeated batch harmless.
    """

    def batch(new: DataFrame, _: int) -> None:
        done = read_ledger_or_none(new.sparkSession, ledger_path, fingerprint)
        append_ledger(process(ledger.pending(new, done)), ledger_path)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def stop_after_batch(query: StreamingQuery) -> None:
    """Ends a run between batches: what is done stays done."""
    query.processAllAvailable()
    query.stop()

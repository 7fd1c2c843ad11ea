"""Shared helpers: table access, shared-folder tables, document splits."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session that names none gets a temporary one if it is local, where driver and executors are one
    process; on a cluster their folders would be apart and results incomplete, so there it is an error.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='mattelake-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_written: set[str] = set()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and reread it: cuts lineage and survives lost executors.

    The table stays until ``discard``, ``release`` or the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mattelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no plan reads any more."""
    path = getattr(df, "shared_path", None)
    if path in _written:
        _delete(path)


def release() -> None:
    """Delete all tables of ``materialise``; results not written yet can no longer be read."""
    for path in sorted(_written):
        _delete(path)


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        release()


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that no operator uses for its own columns, and the new name of each old one."""
    new = {name: f"c{i}_" for i, name in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def restored(new: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(name) for name, n in new.items()]


def id_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def spread(df: DataFrame, least: int = 0) -> DataFrame:
    """df over at least twice the session's cores, for inputs read from one small file."""
    want = max(least, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 4 else df

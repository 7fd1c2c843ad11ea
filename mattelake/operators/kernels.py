"""Arrow kernels that work out new columns row by row: one image in, one image out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mattelake.schemas import extend


def by_row(rows: DataFrame, extra: str, work: Callable[[dict], dict], start: Callable[[], None] | None = None, together: int = 1) -> DataFrame:
    """rows with the columns of ``extra``; a column that is there already is replaced. ``start`` runs once a task.

    ``together`` rows make a batch: one where rows hold pixels, more where they are narrow.
    """
    own = T.StructType.fromDDL(extra)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in own.fields]
    keep = [c for c in rows.columns if c not in own.names]

    def run(batches):
        if start is not None:
            start()
        for b in batches:
            for lo in range(0, b.num_rows, together):
                part = b.slice(lo, together)
                got = [work(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([g.get(n) for g in got], t) for n, t in kinds)], names=[*keep, *own.names])

    return rows.mapInArrow(run, extend(rows.select(*keep).schema, extra))

"""Small tables that the driver holds."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows as a local relation: its size is known to the planner, and no Python worker has to read it."""
    kind = T.StructType.fromDDL(schema)
    arrow, rows = to_arrow_schema(kind), [tuple(r) for r in rows]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)

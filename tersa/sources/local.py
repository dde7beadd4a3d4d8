"""Small driver-side rows (rule tables, facts, step lists) as a local relation, without Python workers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {
    T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
}


def local_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Rows (tuples or Rows, in schema order) as a DataFrame; simple column types only."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [
        pa.array(list(values), type=_ARROW[type(field.dataType)])
        for field, values in zip(schema, columns)
    ]
    table = pa.Table.from_arrays(arrays, names=[f.name for f in schema])
    return spark.createDataFrame(table)

"""Row functions (one output row per input row) and black-box sources, by name.

A row function gets a tuple of Python values and returns a tuple (or one value for a one-column
result).  It runs Arrow-batched in ``mapInArrow``; a column function takes whole Arrow columns of a batch and
returns one column or a tuple of them; a native alternative takes and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AnalysisFault

SPARK_TYPE = {"INTEGER": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}
_ARROW = {"INTEGER": pa.int64(), "DOUBLE": pa.float64(), "STRING": pa.string(), "BOOLEAN": pa.bool_()}


class Registry:
    def __init__(self):
        self.rows: dict[str, Callable] = {}
        self.columns: dict[str, Callable] = {}
        self.frames: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def row_function(self, name: str, function: Callable) -> Registry:
        self.rows[name] = function
        return self

    def column_function(self, name: str, function: Callable) -> Registry:
        """A UDF over a batch's Arrow columns, without a Python call per row."""
        self.columns[name] = function
        return self

    def frame_function(self, name: str, function: Callable[[DataFrame], DataFrame]) -> Registry:
        """A UDF given as DataFrame operations: stays in the JVM."""
        self.frames[name] = function
        return self

    def source(self, path: str, function: Callable[[SparkSession], DataFrame]) -> Registry:
        self.sources[path] = function
        return self

    def apply(self, name: str, df: DataFrame, types: list[str], relation: str) -> DataFrame:
        out = [f"{relation}_{i}" for i in range(len(types))]
        if name in self.frames:
            return self.frames[name](df).toDF(*out)
        whole = name in self.columns
        if not whole and name not in self.rows:
            raise AnalysisFault(f"no function {name!r} is registered")
        function, kinds = (self.columns if whole else self.rows)[name], [_ARROW[t] for t in types]

        def run(batches):
            for batch in batches:
                if whole:
                    made = function(*batch.columns)
                    made = made if isinstance(made, tuple) else (made,)
                    yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made, kinds, strict=True)], names=out)
                    continue
                rows = [function(r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                rows = [r if isinstance(r, tuple) else (r,) for r in rows]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=out)

        return df.mapInArrow(run, T.StructType([T.StructField(c, SPARK_TYPE[t]) for c, t in zip(out, types, strict=True)]))

    def make(self, key: str, spark: SparkSession, types: list[str], relation: str) -> DataFrame:
        if key not in self.sources:
            raise AnalysisFault(f"no source {key!r} is registered")
        df = self.sources[key](spark)
        if len(df.columns) != len(types):
            raise AnalysisFault(f"source {key!r} makes {len(df.columns)} columns, {len(types)} are declared")
        names = [f"{relation}_{i}" for i in range(len(types))]
        df = df.toDF(*names)
        return df.select(*[df[c].cast(SPARK_TYPE[t]).alias(c) for c, t in zip(names, types, strict=True)])

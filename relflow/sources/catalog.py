"""Binding relations to data: parquet tables, space-separated text, DataFrames; and leaf sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AnalysisFault
from ..functions.registry import SPARK_TYPE

_KIND = {T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "DOUBLE", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BooleanType: "BOOLEAN"}


def types_of(df: DataFrame) -> list[str]:
    out = []
    for f in df.schema:
        if type(f.dataType) not in _KIND:
            raise AnalysisFault(f"column {f.name!r} is {f.dataType.simpleString()}, which the language has no type for; leave it out")
        out.append(_KIND[type(f.dataType)])
    return out


class Catalog:
    """Relation name -> DataFrame.  Text folders are found by name when ``input_dir`` is given."""

    def __init__(self, spark: SparkSession, input_dir: str | None = None, separator: str = " "):
        self.spark, self.input_dir, self.separator = spark, input_dir, separator
        self.frames: dict[str, DataFrame] = {}

    def frame(self, name: str, df: DataFrame) -> Catalog:
        types_of(df)
        self.frames[name] = df
        return self

    def parquet(self, name: str, path: str, columns: list[str] | None = None) -> Catalog:
        df = self.spark.read.parquet(path)
        return self.frame(name, df.select(*columns) if columns else df)

    def text(self, name: str, path: str, types: list[str], separator: str | None = None) -> Catalog:
        schema = T.StructType([T.StructField(f"{name}_{i}", SPARK_TYPE[t]) for i, t in enumerate(types)])
        return self.frame(name, self.spark.read.schema(schema).option("sep", separator or self.separator).option("mode", "FAILFAST").csv(path))

    def resolve(self, name: str, types: list[str]) -> DataFrame:
        """The data of a declared relation, checked against its declaration."""
        if name not in self.frames:
            if self.input_dir is None:
                raise AnalysisFault(f"relation {name!r} has no data bound to it")
            self.text(name, f"{self.input_dir}/{name}", types)
        have = types_of(self.frames[name])
        if have != types:
            raise AnalysisFault(f"relation {name!r} is declared as {types}, its data are {have}")
        return self.frames[name]


def save(df: DataFrame, path: str, form: str = "text", separator: str = " ", mode: str = "overwrite") -> None:
    """A leaf to a folder of separated lines or of parquet files."""
    if form == "parquet":
        df.write.mode(mode).parquet(path)
    elif form == "text":
        df.write.mode(mode).option("sep", separator).option("quote", "").option("escapeQuotes", "false").csv(path)
    else:
        raise AnalysisFault(f"no sink {form!r}: text or parquet")

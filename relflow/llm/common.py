"""Shared plumbing: table access, lineage cuts in the shared folder, row locators, joins on skewed keys.

A row's locator is its parquet file and its place in it.  What a later step decides about rows goes
back to them by locator, as a bitmap per 32,768 rows of a file that is broadcast: the rows' texts are
read again but never shuffled.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the word rule, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Executors would not see one of the driver's own, so there is no fallback."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/relflow-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter exits
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._relflow_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``cut`` with a layout: rows lie by hash of ``key``, so joins and groups on it need no shuffle of this side."""
    spark, path, table = df.sparkSession, scratch(df.sparkSession, name), f"relflow_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    if path := getattr(df, "_relflow_path", None):
        remove(df.sparkSession, path)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """The frame with columns c0, c1 ... , so that no name of its own can clash, and the new names of ``names``."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *(f"c{docs.columns.index(n)}" for n in names)


#: Rows a bitmap covers, and the bytes of bitmaps that one broadcast may hold.
BITMAP_ROWS = 32_768
BITMAP_BYTES = 64 << 20
_PLAIN_NODES = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def anchored(docs: DataFrame) -> DataFrame:
    """The rows with columns ``__file`` and ``__row``; a frame that does not read files plainly is written first."""

    def plain(node) -> bool:
        below = node.children()
        return node.nodeName().split(" ")[0] in _PLAIN_NODES and below.size() <= 1 and all(plain(below.apply(i)) for i in range(below.size()))

    if docs.inputFiles() and plain(docs._jdf.queryExecution().analyzed()) and "_metadata" not in docs.columns:
        try:
            return docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        except AnalysisException:  # files of another format have no row numbers
            pass
    names = [f"__c{i}" for i in range(len(docs.columns))]  # any names, repeated ones too, can be written
    kept = cut(docs.toDF(*names), "anchor")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def flagged(rows: DataFrame, hits: DataFrame, name: str = "__hit", most: int = BITMAP_BYTES) -> DataFrame:
    """``rows`` (anchored) with a boolean column: whether (__file, __row) is among ``hits``.

    Bitmaps of over ``most`` bytes together go in batches of files, each read and flagged by itself.
    """
    page = F.floor(F.col("__row") / BITMAP_ROWS)
    placed = hits.select(F.col("__file").alias("b_file"), page.alias("b_page"), (F.col("__row") % BITMAP_ROWS).alias("b_bit"))
    # dealt by page first: a partial bitmap per task would be larger than the places it holds
    maps = cut(placed.repartition("b_file", "b_page").groupBy("b_file", "b_page").agg(F.bitmap_construct_agg("b_bit").alias("b_map")), "bitmaps")
    count = maps.count()
    if not count:
        return rows.withColumn(name, F.lit(False))
    batches = -(-count * (BITMAP_ROWS // 8) // most)
    bit = F.col("__row") % BITMAP_ROWS
    octet = F.conv(F.hex(F.substring("b_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = (F.col("__file") == F.col("b_file")) & (page == F.col("b_page"))
    out = None
    for n in range(batches):
        part, own = rows, maps
        if batches > 1:
            part, own = (df.filter(F.pmod(F.xxhash64(c), F.lit(batches)) == n) for df, c in ((rows, "__file"), (maps, "b_file")))
        got = part.join(F.broadcast(own), on, "left").select(*_all(rows), F.coalesce(F.getbit(octet, (bit % 8).cast("int")) == 1, F.lit(False)).alias(name))
        out = got if out is None else out.unionByName(got)
    return out


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


#: A key with over 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them, which bounds their broadcast.
HOT_SHARE = 1_000
HOT_LEAST = 1_000


def join_skewed(rows: DataFrame, values: DataFrame, key: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per key; ``weight``: the rows that have it, which goes).

    Hot keys' values are broadcast, so their rows stay where they are; all others meet by shuffle.
    """
    limit = max(total // HOT_SHARE, HOT_LEAST)
    fields = [c for c in values.columns if c not in key and c != weight]
    hot = values.filter(F.col(weight) > limit).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(f).alias(f"__v{i}") for i, f in enumerate(fields)], F.lit(True).alias("__hot"))
    same = None
    for i, k in enumerate(key):
        on = F.col(k) == F.col(f"__k{i}")
        same = on if same is None else same & on
    tagged = rows.join(F.broadcast(hot), same, "left")
    a = tagged.filter("__hot").select(*_all(rows), *[F.col(f"__v{i}").alias(f) for i, f in enumerate(fields)])
    b = tagged.filter("__hot is null").select(*_all(rows)).join(values.filter(F.col(weight) <= limit).select(*key, *fields), key, how).select(*_all(rows), *fields)
    return a.unionByName(b)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about ``size`` in the jobs run inside, so that long texts do not make huge ones."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same batches; when they end, the worker gives freed memory back, as it stays for later tasks and stages."""

    def out(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
                trim(0)

    return out


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let value in body``: a lambda variable, so that no rule inlines ``value`` per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t\\n\\v\\f\\r; none for blank text."""
    for c in _SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")

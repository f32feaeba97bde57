"""Exact deduplication over keyed streaming state.

One pass writes *arrivals*: a slim row per document with the digest of its normalised text and its
content locator (parquet file and row).  A stream over the arrivals keeps, per digest, the number
of rows and the best row's order key, stable identifier and content locator, in a RocksDB state
store without watermark or expiry; a later run on the same checkpoint folder goes on from there.
Copies are combined before the shuffle, so a group of any size costs a row per task.  The finished
state is read back as a table.

Digest hits, also those on rows of earlier runs, are then compared byte for byte: the hit rows'
texts are fetched by their locators (bitmaps of rows per file, so no other text is shuffled), and per
digest the smallest and the largest normalised text must be the same string, combined before the
shuffle.  Digests that fail are regrouped by the texts themselves, over the rows of all runs, so the
result is exact for any digest.  Files that hold arrivals of earlier runs must still be there; a frame
that is not read from parquet files is written below the checkpoint folder first.

Skew: hot digests' groups are broadcast, within the bound of ``join_skewed``; all else meets by digest.

Defined results: null text counts as empty; all blank texts form one group.  Of equal texts the
row with most code points stays, then the smallest doc_id (null last), then the first run's, then that
of the first file and row, so of wholly repeated rows exactly one stays.  An empty table gives an
empty result; other columns never enter, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE_CHARS, anchored, cut, flagged, join_skewed, numbered, remove, scratch, table, text_of

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store holds 4 MB or more of empty files
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store costs memory only while its task runs
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    for c in _SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the (anchored) documents' slim rows to the folder that the stream reads; the rows of this run."""
    t, run = text_of(text), time.time_ns()
    slim = docs.select(
        F.lit(run).alias("run"),  # tells the arrivals of later runs on the same state apart
        F.col(key).alias("doc_id"),
        digest(normalised(t)).alias("digest"),
        F.length(t).alias("points"),
        "__file",
        "__row",
    )
    slim.write.mode("append").parquet(folder)
    return docs.sparkSession.read.schema(slim.schema).parquet(folder).filter(F.col("run") == run)


_LOCATOR = ["run", "__file", "__row"]


def _best() -> Column:
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("void"), "doc_id", *_LOCATOR))


def run_state(arrived: DataFrame, folder: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Feed the folder's new files through the keyed state; (digest, best, n) of everything seen so far."""
    spark = arrived.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        state = stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress is None and not _has_state(spark, checkpoint):
            return arrived.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))  # no row yet
        kept = spark.read.format("statestore").load(checkpoint)
        values = kept.schema["value"].dataType.names
        return kept.select(F.col("key")[kept.schema["key"].dataType.names[0]].alias("digest"), F.col("value")[values[0]].alias("best"), F.col("value")[values[1]].alias("n"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _has_state(spark: SparkSession, checkpoint: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _decide(arrived: DataFrame, groups: DataFrame) -> DataFrame:
    """Each arrival with its group's best row and size."""
    fields = [*_LOCATOR, "doc_id", "digest", "points"]
    return join_skewed(arrived, groups.select("digest", "best", "n", F.col("n").alias("w")), ["digest"], "w", arrived.count()).select(*fields, "best", "n")


def _texts(docs: DataFrame, hits: DataFrame, run: int, key: str, text: str) -> DataFrame:
    """run, __file, __row, t (normalised) of the hit rows: this run's from ``docs``, earlier ones' from their files."""
    spark = docs.sparkSession
    mine = flagged(docs.select("__file", "__row", F.col(text).alias("t")), hits.filter(F.col("run") == run)).filter("__hit")
    out = mine.select(F.lit(run).alias("run"), "__file", "__row", normalised(text_of("t")).alias("t"))
    before = hits.filter(F.col("run") != run)
    for earlier, files in before.groupBy("run").agg(F.collect_set("__file")).collect():  # names of files, as a reader holds them
        read = anchored(spark.read.parquet(*map(unquote, files)))
        old = flagged(read.select("__file", "__row", F.col(text).alias("t")), before.filter(F.col("run") == earlier)).filter("__hit")
        out = out.unionByName(old.select(F.lit(earlier).alias("run"), "__file", "__row", normalised(text_of("t")).alias("t")))
    return out


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """run, __file, __row, doc_id, digest, points, best, n: one row per document of this run.

    With ``checkpoint`` the state of earlier runs on that folder counts: n and best cover them too.
    """
    spark = docs.sparkSession
    root = checkpoint or scratch(spark, "state")
    docs = _lasting(docs, root) if checkpoint else docs if "__file" in docs.columns else anchored(docs)
    folder = f"{root}/arrivals"
    arrived = arrivals(docs, folder, digest, key, text)
    groups = cut(run_state(arrived, folder, f"{root}/progress", files_per_batch), "groups")
    if checkpoint is None:
        remove(spark, f"{root}/progress")
    decided = cut(_decide(arrived, groups), "decided")
    hits = decided.filter("n > 1").select(*_LOCATOR, "doc_id", "digest", "points")
    mine = decided.agg(F.max("run")).first()[0]
    if mine is None:
        return decided
    if checkpoint:  # the rows of earlier runs that share a digest with one of this
        seen = hits.select("digest").distinct()
        old = spark.read.schema(arrived.schema).parquet(folder).filter(F.col("run") < mine).join(seen, "digest", "left_semi")
        hits = cut(hits.unionByName(old.select(*hits.columns)), "hits")
    texts = _texts(docs, hits, mine, key, text)
    false_hits = cut(texts.groupBy(digest(F.col("t")).alias("digest")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("digest"), "hits")
    if false_hits.isEmpty():
        return decided
    rows = hits.join(false_hits, "digest", "left_semi")
    rows = cut(rows.join(_texts(docs, rows, mine, key, text), _LOCATOR), "regroup")
    per_text = rows.groupBy("t").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    again = join_skewed(rows, per_text.withColumn("w", F.col("n")), ["t"], "w", rows.count()).filter(F.col("run") == mine)
    return decided.join(false_hits, "digest", "left_anti").select(*decided.columns).unionByName(again.withColumn("digest", sha256(F.col("t"))).select(*decided.columns))


def _lasting(docs: DataFrame, root: str) -> DataFrame:
    """The anchored documents; those that no parquet file holds are written where the state is kept."""
    own = anchored(docs)
    if not any("/relflow-anchor-" in f for f in own.inputFiles()):
        return own
    path = f"{root}/content-{time.time_ns()}"
    docs.write.parquet(path)
    return anchored(docs.sparkSession.read.parquet(path))


def stays() -> Column:
    """Whether a row of ``decisions`` is its group's best."""
    return (F.col("run") == F.col("best.run")) & (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, columns unchanged; no text is shuffled for it."""
    own, key, text = numbered(docs, key, text)
    rows = anchored(own)
    gone = decisions(rows, key, text).filter(~stays())
    return flagged(rows, gone).filter("not __hit").select(*own.columns).toDF(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays().alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

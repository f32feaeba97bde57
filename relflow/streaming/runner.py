"""Run a workflow on every micro-batch of a stream bound to one of its relations.

The language has no notion of time or state across batches, so each micro-batch is one run of
the workflow: the stream's rows under ``relation``, all other relations as in the catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.registry import Registry
from ..sources.catalog import Catalog
from ..workflow import Workflow


def start(workflow: Workflow, stream: DataFrame, relation: str, catalog: Catalog, sink: Callable[[str, DataFrame, int], None], checkpoint: str, registry: Registry | None = None, once: bool = False) -> StreamingQuery:
    """``sink(leaf name, rows, batch id)`` gets every leaf of every micro-batch; it must be idempotent per batch id."""

    def each(rows: DataFrame, batch: int) -> None:
        own = Catalog(catalog.spark, catalog.input_dir, catalog.separator)
        own.frames = dict(catalog.frames)
        own.frame(relation, rows)
        for name, df in workflow.run(own, registry).items():
            sink(name, df, batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Plan to DataFrames.  Each node is lowered once per run; Catalyst sees the whole lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import AnalysisFault
from ..functions.registry import Registry
from ..plans import nodes as n
from . import relational as r
from .loop import run_loop

_UNARY = {n.Project: r.project, n.Arithmetic: r.arithmetic, n.Aggregate: r.aggregate, n.Count: r.count, n.Extreme: r.extreme, n.Distinct: r.distinct, n.Sort: r.sort, n.Rename: r.rename}
_BINARY = {n.Join: r.join, n.Cross: r.cross, n.SetOperation: r.set_operation}


class Lowering:
    """inputs: relation name -> DataFrame for every Input (and, in a loop, every Bound) node."""

    def __init__(self, spark: SparkSession, inputs: dict[str, DataFrame], registry: Registry | None = None):
        self.spark, self.inputs, self.registry = spark, inputs, registry or Registry()
        self.done: dict[int, DataFrame] = {}
        self.loops: dict[int, dict[str, DataFrame]] = {}

    def frame(self, node: n.Node) -> DataFrame:
        if id(node) not in self.done:
            self.done[id(node)] = self._make(node)
        return self.done[id(node)]

    def _make(self, node: n.Node) -> DataFrame:
        kind = type(node)
        if kind in _UNARY:
            return _UNARY[kind](node, self.frame(node.child))
        if kind in _BINARY:
            return _BINARY[kind](node, self.frame(node.left), self.frame(node.right))
        if kind in (n.Input, n.Bound):
            df = self.inputs.get(node.name)
            if df is None:
                raise AnalysisFault(f"relation {node.name!r} has no data bound to it")
            if len(df.columns) != len(node.types):
                raise AnalysisFault(f"relation {node.name!r} has {len(df.columns)} columns, {len(node.types)} are declared")
            return r.named(df, node.name)
        if kind is n.RowFunction:
            return self.registry.apply(node.function, self.frame(node.child), node.types, node.name)
        if kind is n.Source:
            return self.registry.make(node.key, self.spark, node.types, node.name)
        if kind is n.LoopResult:
            key = id(node.loop)
            if key not in self.loops:
                outer = {k: self.frame(v) for k, v in node.loop.outer.items()}
                self.loops[key] = run_loop(node.loop, outer, self.spark, lambda inputs: Lowering(self.spark, {**self.inputs, **inputs}, self.registry))
            return self.loops[key][node.name]
        raise AnalysisFault(f"no lowering for {kind.__name__}")

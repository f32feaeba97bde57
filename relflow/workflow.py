"""Running workflows: text or API plans over bound data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisFault
from .functions.registry import Registry
from .operators.lower import Lowering
from .plans import nodes as n
from .plans.analyzer import Program, analyze
from .sources.catalog import Catalog, save


class Workflow:
    """A typed program; ``run`` gives lazy DataFrames of its results."""

    def __init__(self, program: Program | str, legacy_const_swap: bool = False):
        self.program = analyze(program, legacy_const_swap) if isinstance(program, str) else program

    def _lowering(self, catalog: Catalog, registry: Registry | None) -> Lowering:
        inputs = {}

        def walk(node):
            if isinstance(node, n.Input) and node.name not in inputs:
                inputs[node.name] = catalog.resolve(node.name, node.types)
            for c in node.children:
                walk(c)

        for leaf in self.program.leaves().values():
            walk(leaf)
        return Lowering(catalog.spark, inputs, registry)

    def run(self, catalog: Catalog, registry: Registry | None = None) -> dict[str, DataFrame]:
        """Every leaf relation by name."""
        lower = self._lowering(catalog, registry)
        return {name: lower.frame(node) for name, node in self.program.leaves().items()}

    def relation(self, name: str, catalog: Catalog, registry: Registry | None = None) -> DataFrame:
        """One relation of the program, leaf or not."""
        if name not in self.program.env:
            raise AnalysisFault(f"the program has no relation {name!r}")
        node = self.program.env[name]
        lower = self._lowering(catalog, registry)
        for k, v in catalog.frames.items():
            lower.inputs.setdefault(k, v)
        return lower.frame(node)

    def save(self, catalog: Catalog, output_dir: str, form: str = "text", registry: Registry | None = None) -> list[str]:
        out = []
        for name, df in self.run(catalog, registry).items():
            save(df, f"{output_dir}/{name}", form)
            out.append(name)
        return out


def query(spark: SparkSession, source: str, tables: dict[str, DataFrame], result: str, labels: list[str] | None = None, registry: Registry | None = None, legacy_const_swap: bool = False) -> DataFrame:
    """Run a program over DataFrames and give one relation, its columns labelled."""
    catalog = Catalog(spark)
    for name, df in tables.items():
        catalog.frame(name, df)
    out = Workflow(source, legacy_const_swap).relation(result, catalog, registry)
    return out.toDF(*labels) if labels else out

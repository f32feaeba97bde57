"""``python -m relflow.cli run FILE --input-dir DIR --output-dir DIR [--format parquet] | explain FILE [--dot]``

``--param name=value`` fills ``{{name}}`` in the file, ``--registry module:attribute`` names a Registry of functions
and sources, ``--input-format parquet`` reads a parquet folder per relation, ``--separator`` sets that of text.
"""

from __future__ import annotations

import argparse
import importlib
import re

from .errors import AnalysisFault
from .plans import nodes as n
from .plans.analyzer import Program, analyze
from .plans.explain import graphviz, tree


def filled(source: str, values: dict[str, str]) -> str:
    """The text with ``{{name}}`` replaced; a name without a value is an error."""

    def value(m):
        if m[1] not in values:
            raise AnalysisFault(f"the workflow's parameter {m[1]!r} has no value")
        return values[m[1]]

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", value, source)


def inputs(program: Program) -> set[str]:
    """Names of the relations whose rows come from outside."""
    out, todo = set(), [node for _, node in program.steps]
    while todo:
        node = todo.pop()
        todo += node.children
        if isinstance(node, n.Input):
            out.add(node.name)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="relflow")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("file")
    run.add_argument("--input-dir", required=True)
    run.add_argument("--output-dir", required=True)
    run.add_argument("--format", choices=("text", "parquet"), default="text")
    run.add_argument("--input-format", choices=("text", "parquet"), default="text")
    run.add_argument("--separator", default=" ")
    run.add_argument("--registry")
    explain = sub.add_parser("explain")
    explain.add_argument("file")
    explain.add_argument("--dot", action="store_true")
    for command in (run, explain):
        command.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    a = p.parse_args(argv)
    with open(a.file) as f:
        program = analyze(filled(f.read(), dict(x.split("=", 1) for x in a.param)))
    if a.command == "explain":
        print(graphviz(program) if a.dot else tree(program))
        return 0
    from pyspark.sql import SparkSession

    from .sources.catalog import Catalog
    from .workflow import Workflow

    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark, a.input_dir, a.separator)
    if a.input_format == "parquet":
        for name in sorted(inputs(program)):
            catalog.parquet(name, f"{a.input_dir}/{name}")
    registry = None
    if a.registry:
        module, _, attribute = a.registry.partition(":")
        registry = getattr(importlib.import_module(module), attribute or "registry")
    for name in Workflow(program).save(catalog, a.output_dir, a.format, registry):
        print(f"{a.output_dir}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

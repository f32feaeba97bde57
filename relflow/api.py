"""A fluent query API over the same plan nodes as the language.

    q = relation("ratings", "INTEGER", "INTEGER", "DOUBLE")
    best = q.where(q[2] > 3).group_by([0], "MAX", [2]).to(spark, ratings=df)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisFault
from .functions.registry import Registry
from .operators.lower import Lowering
from .plans import nodes as n
from .plans.analyzer import Analyzer

_names = iter(range(10**12))


class Expr:
    """An operand or a condition: compare with < <= == != > >=, combine with & | ~, compute with + - * /."""

    def __init__(self, node):
        self.node = node

    def _test(self, op, other):
        return Expr(n.Test(op, self.node, _operand(other)))

    def __lt__(self, o):
        return self._test("<", o)

    def __le__(self, o):
        return self._test("<=", o)

    def __gt__(self, o):
        return self._test(">", o)

    def __ge__(self, o):
        return self._test(">=", o)

    def __eq__(self, o):
        return self._test("=", o)

    def __ne__(self, o):
        return self._test("<>", o)

    __hash__ = None

    def __and__(self, o):
        return Expr(n.Both(self.node, o.node))

    def __or__(self, o):
        return Expr(n.Either(self.node, o.node))

    def __invert__(self):
        return Expr(n.Not(self.node))

    def _row(self, op, o, swap=False):
        a, b = self.node, _operand(o)
        return (op, b, a) if swap else (op, a, b)

    def __add__(self, o):
        return self._row("SUM", o)

    def __sub__(self, o):
        return self._row("SUB", o)

    def __mul__(self, o):
        return self._row("MUL", o)

    def __truediv__(self, o):
        return self._row("DIV", o)

    def __radd__(self, o):
        return self._row("SUM", o, True)

    def __rsub__(self, o):
        return self._row("SUB", o, True)

    def __rmul__(self, o):
        return self._row("MUL", o, True)

    def __rtruediv__(self, o):
        return self._row("DIV", o, True)


def _operand(x):
    return x.node if isinstance(x, Expr) else n.Lit(x)


class Query:
    """An immutable plan; every method gives a new query."""

    def __init__(self, node: n.Node):
        self.node = node

    def __getitem__(self, ordinal: int) -> Expr:
        if not 0 <= ordinal < len(self.node.types):
            raise AnalysisFault(f"ordinal {ordinal} is out of range for {self.node.types}")
        return Expr(n.Col(ordinal))

    def _name(self) -> str:
        return f"q{next(_names)}"

    def _cols(self, cols) -> list[int]:
        for c in cols:
            self[c]
        return list(cols)

    def select(self, *columns: int, compute=None) -> Query:
        """Columns in any order and number; ``compute`` (an arithmetic of two operands) is applied before."""
        child = self if compute is None else self.compute(compute)
        cols = self._cols(columns)
        return Query(n.Project(self._name(), [child.node.types[c] for c in cols], child.node, cols))

    def compute(self, arithmetic: tuple) -> Query:
        op, a, b = arithmetic
        return Query(Analyzer().arithmetic(op, self._name(), self.node, a, b))

    def where(self, condition: Expr) -> Query:
        return Query(n.Project(self._name(), list(self.node.types), self.node, list(range(len(self.node.types))), condition.node))

    def select_many(self) -> Query:
        """Relations hold no collections, so there is nothing to flatten."""
        return self

    def concat(self, other: Query) -> Query:
        return Query(Analyzer().set_operation("UNION", self._name(), self.node, other.node))

    def union(self, other: Query) -> Query:
        return self.concat(other).distinct()

    def intersect(self, other: Query) -> Query:
        return Query(Analyzer().set_operation("INTERSECT", self._name(), self.node, other.node))

    def except_(self, other: Query) -> Query:
        return Query(Analyzer().set_operation("DIFFERENCE", self._name(), self.node, other.node))

    def distinct(self) -> Query:
        return Query(n.Distinct(self._name(), list(self.node.types), self.node))

    def group_by(self, keys, reducer: str, columns) -> Query:
        """reducer: MIN, MAX, COUNT, PLUS, MINUS, MULTIPLY or DIVIDE."""
        keys, cols = self._cols(keys), self._cols(columns)
        a = Analyzer()
        heads = a.key_types(self.node, keys)
        if reducer == "COUNT":
            return Query(n.Count(self._name(), heads + [n.INTEGER], self.node, keys))
        if reducer in ("MIN", "MAX"):
            return Query(n.Extreme(self._name(), heads + [self.node.types[c] for c in cols], self.node, reducer == "MAX", cols, keys))
        ops = {"PLUS": "+", "MINUS": "-", "MULTIPLY": "*", "DIVIDE": "/"}
        if reducer not in ops:
            raise AnalysisFault(f"no reducer {reducer!r}")
        return Query(a.aggregate(ops[reducer], self._name(), self.node, cols, keys))

    def join(self, other: Query, left_keys, right_keys) -> Query:
        return Query(Analyzer().join(self._name(), self.node, other.node, self._cols(left_keys), other._cols(right_keys)))

    def cross(self, other: Query) -> Query:
        return Query(n.Cross(self._name(), self.node.types + other.node.types, self.node, other.node))

    def order_by(self, column: int, ascending: bool = True) -> Query:
        self[column]
        return Query(n.Sort(self._name(), list(self.node.types), self.node, column, ascending))

    def count(self) -> Query:
        """One row, one column."""
        return Query(n.Count(self._name(), [n.INTEGER], self.node, [], None, label=False))

    def min(self, *columns: int) -> Query:
        """The smallest value of the first column with the others of its row, after the constant ALL."""
        return self.group_by([], "MIN", columns)

    def max(self, *columns: int) -> Query:
        return self.group_by([], "MAX", columns)

    def apply(self, function: str, *types: str) -> Query:
        return Query(n.RowFunction(self._name(), list(types), self.node, function))

    def iterate(self, body: Callable[[Query], Query], passes: int) -> Query:
        """``body`` applied ``passes`` times to this query's rows."""
        state, counter = self._name(), self._name()
        bound = Query(n.Bound(state, list(self.node.types)))
        out = body(bound).node
        if [t in n.NUMERIC for t in out.types] != [t in n.NUMERIC for t in self.node.types]:
            raise AnalysisFault("an iteration's body must keep its types")
        step = Analyzer().arithmetic("SUM", counter, n.Bound(counter, [n.INTEGER]), n.Col(0), n.Lit(1))
        start = n.Input(f"{counter}_start", [n.INTEGER])
        loop = n.Loop("iterate", [], n.Test("<", n.Col(0, counter), n.Lit(passes)), [(state, out), (counter, step)], {state: self.node, counter: start})
        return Query(n.LoopResult(state, list(out.types), loop))

    def to(self, spark: SparkSession, registry: Registry | None = None, **tables: DataFrame) -> DataFrame:
        """The rows, over the DataFrames named after the relations."""
        inputs = dict(tables)

        def starts(node):
            if isinstance(node, n.Input) and node.name.endswith("_start") and node.name not in inputs:
                inputs[node.name] = spark.createDataFrame([(0,)], "c int")
            for c in node.children:
                starts(c)

        starts(self.node)
        return Lowering(spark, inputs, registry).frame(self.node)


def relation(name: str, *types: str) -> Query:
    return Query(n.Input(name, list(types)))

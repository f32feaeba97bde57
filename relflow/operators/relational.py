"""One function per operator: DataFrames in, a DataFrame out, named ``<relation>_<ordinal>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as n

_COMPARE = {"<": "__lt__", "<=": "__le__", "=": "__eq__", "<>": "__ne__", ">": "__gt__", ">=": "__ge__"}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: The largest whole number up to which a double product is exact.
_EXACT = 2**53


def named(df: DataFrame, relation: str) -> DataFrame:
    return df.toDF(*[f"{relation}_{i}" for i in range(len(df.columns))])


def col(df: DataFrame, ordinal: int) -> Column:
    return F.col(f"`{df.columns[ordinal]}`")


def value(df: DataFrame, x) -> Column:
    return F.lit(x.value) if isinstance(x, n.Lit) else col(df, x.ordinal)


def predicate(df: DataFrame, c) -> Column:
    if isinstance(c, n.Not):
        return ~predicate(df, c.part)
    if isinstance(c, n.Both):
        return predicate(df, c.left) & predicate(df, c.right)
    if isinstance(c, n.Either):
        return predicate(df, c.left) | predicate(df, c.right)
    return getattr(value(df, c.left), _COMPARE[c.op])(value(df, c.right))


def where(df: DataFrame, c) -> DataFrame:
    return df if c is None else df.filter(predicate(df, c))


def project(node: n.Project, df: DataFrame) -> DataFrame:
    df = where(df, node.where)
    return df.select(*[col(df, c).alias(f"{node.name}_{i}") for i, c in enumerate(node.columns)])


def _is_whole(df: DataFrame, x) -> bool:
    if isinstance(x, n.Lit):
        return isinstance(x.value, int)
    return isinstance(df.schema[x.ordinal].dataType, _WHOLE)


def arithmetic(node: n.Arithmetic, df: DataFrame) -> DataFrame:
    """The result overwrites the target column.  Whole numbers divide truncating towards zero."""
    df = where(df, node.where)
    a, b = value(df, node.a), value(df, node.b)
    whole = _is_whole(df, node.a) and _is_whole(df, node.b)
    if node.op == "DIV":
        # ANSI arithmetic: division by zero and overflow raise rather than wrap
        out = F.call_function("div", a, b) if whole else a.cast("double") / b.cast("double")
    else:
        out = {"SUM": a + b, "SUB": a - b, "MUL": a * b}[node.op]
    if whole:
        out = out.cast(df.schema[node.target].dataType)
    return df.select(*[(out if i == node.target else col(df, i)).alias(f"{node.name}_{i}") for i in range(len(df.columns))])


def _groups(df: DataFrame, keys: list[int]):
    """Grouping keys; without any, the constant ``ALL``, so that no rows give no group."""
    return df.groupBy(*([col(df, k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit("ALL").alias("k0")]))


def _product(df: DataFrame, c: int) -> Column:
    p = F.product(col(df, c))
    if isinstance(df.schema[c].dataType, _WHOLE):
        return F.when(F.abs(p) <= _EXACT, p.cast("long")).otherwise(F.raise_error(F.lit("the product of whole numbers is over 2^53")))
    return p


def aggregate(node: n.Aggregate, df: DataFrame) -> DataFrame:
    """``-`` is minus the sum and ``/`` one over the product: one meaning in any order of rows."""
    df = where(df, node.where)
    outs = []
    for i, c in enumerate(node.columns):
        whole = isinstance(df.schema[c].dataType, _WHOLE)
        if node.op in "+-":
            out = F.sum(col(df, c))
            out = -out if node.op == "-" else out
        elif node.op == "*":
            out = _product(df, c)
        else:
            p = _product(df, c)
            out = F.call_function("div", F.lit(1), p) if whole else 1.0 / p
        outs.append(out.alias(f"a{i}"))
    return named(_groups(df, node.keys).agg(*outs), node.name)


def count(node: n.Count, df: DataFrame) -> DataFrame:
    df = where(df, node.where)
    if node.keys:
        return named(_groups(df, node.keys).agg(F.count(F.lit(1)).alias("n")), node.name)
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return named(one.select(F.lit("ALL").alias("k"), "n") if node.label else one, node.name)


def extreme(node: n.Extreme, df: DataFrame) -> DataFrame:
    """The extreme value with the columns carried from its row; ties go by the carried columns.

    Null values are passed over, as in SQL; a group of nulls only gives nulls.
    """
    df = where(df, node.where)
    row = F.when(col(df, node.columns[0]).isNotNull(), F.struct(*[col(df, c).alias(f"c{i}") for i, c in enumerate(node.columns)]))
    best = _groups(df, node.keys).agg((F.max if node.largest else F.min)(row).alias("best"))
    keys = [F.col(f"k{i}") for i in range(max(1, len(node.keys)))]
    return named(best.select(*keys, *[F.col(f"best.c{i}").alias(f"c{i}") for i in range(len(node.columns))]), node.name)


def join(node: n.Join, left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner equi-join, keys paired in the order listed; right keys are dropped."""
    left = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    right = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    on = [F.col(f"l{a}") == F.col(f"r{b}") for a, b in zip(node.left_keys, node.right_keys, strict=True)]
    keep = [c for i, c in enumerate(right.columns) if i not in node.right_keys]
    return named(left.join(right, on).select(*left.columns, *keep), node.name)


def cross(node: n.Cross, left: DataFrame, right: DataFrame) -> DataFrame:
    left = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    return named(left.crossJoin(right.toDF(*[f"r{i}" for i in range(len(right.columns))])), node.name)


def set_operation(node: n.SetOperation, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION keeps all rows; INTERSECT and DIFFERENCE keep left rows with their multiplicity."""
    kinds = [f.dataType for f in left.schema]
    if node.op == "UNION":
        return named(left.toDF(*[f"c{i}" for i in range(len(kinds))]).union(right), node.name)
    left = left.toDF(*[f"l{i}" for i in range(len(kinds))])
    right = right.toDF(*[f"r{i}" for i in range(len(kinds))])
    same = [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(kinds))]
    return named(left.join(right, same, "left_semi" if node.op == "INTERSECT" else "left_anti"), node.name)


def distinct(node: n.Distinct, df: DataFrame) -> DataFrame:
    return named(df.distinct(), node.name)


def sort(node: n.Sort, df: DataFrame) -> DataFrame:
    df = named(where(df, node.where), node.name)
    c = col(df, node.column)
    return df.orderBy(c.asc() if node.ascending else c.desc())


def rename(node: n.Rename, df: DataFrame) -> DataFrame:
    return named(df, node.name)

"""WHILE: a pre-test loop over DataFrames with short plans.

A loop whose condition tests a counter that its body only steps by a constant is counted in
Python: the start is read once and no pass costs a job.  Otherwise the condition reads row one
of each relation it names, one small job a pass.  Loop-carried relations are written to the
shared checkpoint folder (reliable, so lost executors cost nothing) whenever the condition reads
data, and every ``PASSES_PER_CUT`` passes otherwise: in between Catalyst plans several passes as
one query and reuses their exchanges.  Relations the body reads but never writes are persisted
where they are results of operators rather than plain inputs.
"""

from __future__ import annotations

import operator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..errors import WorkflowFault
from ..plans import nodes as n
from ..plans.analyzer import bound_names

PASSES_PER_CUT = 4
MAX_PASSES = 100_000
_TEST = {"<": operator.lt, "<=": operator.le, "=": operator.eq, "<>": operator.ne, ">": operator.gt, ">=": operator.ge}


def cut(df: DataFrame) -> DataFrame:
    """Truncate the plan by a reliable checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise WorkflowFault("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def tests(c) -> list[n.Test]:
    if isinstance(c, n.Test):
        return [c]
    return tests(c.part) if isinstance(c, n.Not) else tests(c.left) + tests(c.right)


def relations(c) -> set[str]:
    return {x.relation for t in tests(c) for x in (t.left, t.right) if isinstance(x, n.Col)}


def holds(c, rows: dict) -> bool:
    if isinstance(c, n.Not):
        return not holds(c.part, rows)
    if isinstance(c, n.Both):
        return holds(c.left, rows) and holds(c.right, rows)
    if isinstance(c, n.Either):
        return holds(c.left, rows) or holds(c.right, rows)
    a, b = (x.value if isinstance(x, n.Lit) else rows[x.relation][x.ordinal] for x in (c.left, c.right))
    return _TEST[c.op](a, b)


def only_row(df: DataFrame, name: str) -> list:
    got = df.take(2)
    if len(got) != 1:
        raise WorkflowFault(f"a loop's condition reads {name!r}, which must have exactly one row")
    return list(got[0])


def counters(loop: n.Loop) -> dict[str, tuple[str, float, int]] | None:
    """relation -> (op, step, column) if all relations of the condition are plain counters."""
    out = {}
    for name in relations(loop.condition):
        writes = [node for k, node in loop.body if k == name]
        if not writes:  # constant throughout the loop
            out[name] = ("SUM", 0, 0)
            continue
        w = writes[0]
        plain = len(writes) == 1 and isinstance(w, n.Arithmetic) and w.op in ("SUM", "SUB") and w.where is None and isinstance(w.child, n.Bound) and w.child.name == name
        if not plain or not (isinstance(w.a, n.Col) and isinstance(w.b, n.Lit) or w.op == "SUM" and isinstance(w.a, n.Lit)):
            return None
        out[name] = (w.op, w.b.value if isinstance(w.b, n.Lit) else w.a.value, w.target)
    return out


def run_loop(loop: n.Loop, outer: dict[str, DataFrame], spark: SparkSession, lowering) -> dict[str, DataFrame]:
    written = {name for name, _ in loop.body}
    read = {m for _, node in loop.body for m in bound_names(node)}
    carried = [k for k in outer if k in written]
    env = dict(outer)
    for k in outer:
        if k in read and k not in written and _is_derived(outer[k]):
            env[k] = outer[k].persist(StorageLevel.MEMORY_AND_DISK)
    counted = counters(loop)
    rows = {k: only_row(env[k], k) for k in relations(loop.condition)}
    passes = 0
    while holds(loop.condition, rows):
        if passes >= MAX_PASSES:
            raise WorkflowFault(f"a loop ran {MAX_PASSES} passes")
        step = lowering(env)
        made = {name: step.frame(node) for name, node in loop.body}
        env = env | made
        passes += 1
        if counted is None or passes % PASSES_PER_CUT == 0:
            for k in carried:
                env[k] = cut(env[k])
        if counted is None:
            rows = {k: only_row(env[k], k) for k in rows}
        else:
            for k, (op, by, at) in counted.items():
                rows[k][at] = rows[k][at] + by if op == "SUM" else rows[k][at] - by
    missing = written - set(env)
    if missing:
        raise WorkflowFault(f"the loop made no pass, so {', '.join(sorted(missing))} has no rows or types")
    return env


def _is_derived(df: DataFrame) -> bool:
    """Whether recomputing the relation would shuffle."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(k in plan for k in ("Join", "Aggregate", "Distinct", "Sort"))

"""Gather/apply/scatter vertex programs, expanded to the relational plan nodes.

Each pass: edges join the vertices on the source; ``scatter`` computes a message per edge from the
source's value, the edge's value and the source's out-degree; ``gather`` combines messages by
target; ``apply`` is a chain of row operations on the combined value.  With ``keep`` the vertices'
present values take part in the gathering (as in shortest paths); else a vertex without incoming
edges leaves the relation, as the inner join and grouping say.
"""

from __future__ import annotations

from .api import Query
from .errors import AnalysisFault
from .plans import nodes as n

NODEVAL, EDGEVAL, OUTNUM = "NODEVAL", "EDGEVAL", "OUTNUM"
_GATHER = {"+": "PLUS", "-": "MINUS", "*": "MULTIPLY", "min": "MIN", "max": "MAX", "count": "COUNT"}


def vertex_program(edges: Query, vertices: Query, passes: int, gather: str = "+", scatter: tuple | list = (), apply: list | tuple = (), keep: bool = False) -> Query:
    """edges: (source, target[, value]); vertices: (id, value).

    ``scatter``: steps (op, operand) on the source's value, op one of SUM SUB MUL DIV, operand a number,
    EDGEVAL or OUTNUM.  ``apply``: steps (op, number) on the gathered value.
    """
    if gather not in _GATHER:
        raise AnalysisFault(f"no gather {gather!r}: {', '.join(_GATHER)}")
    if len(edges.node.types) not in (2, 3) or len(vertices.node.types) != 2:
        raise AnalysisFault("edges are (source, target[, value]) and vertices (id, value)")
    weighted = len(edges.node.types) == 3
    steps = [scatter] if scatter and isinstance(scatter[0], str) else list(scatter)
    degree_at = None
    if any(s[1] == OUTNUM for s in steps):
        degree_at = len(edges.node.types)
        edges = edges.join(edges.group_by([0], "COUNT", []), [0], [0])
    value_at = len(edges.node.types)

    def one_pass(state: Query) -> Query:
        q = edges.join(state, [0], [0])
        for op, x in steps:
            if x == EDGEVAL and not weighted:
                raise AnalysisFault("these edges have no value")
            operand = n.Col(2) if x == EDGEVAL else n.Col(degree_at) if x == OUTNUM else n.Lit(x)
            q = q.compute((op, n.Col(value_at), operand))
        q = q.select(1, value_at)
        if keep:
            q = q.concat(state)
        q = q.group_by([0], _GATHER[gather], [1])
        for op, x in apply:
            q = q.compute((op, n.Col(1), n.Lit(x)))
        return q

    return vertices.iterate(one_pass, passes)

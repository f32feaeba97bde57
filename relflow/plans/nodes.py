"""Logical plan nodes.  Columns are ordinals of the child; types are the language's four."""

from __future__ import annotations

from dataclasses import dataclass, field

INTEGER, DOUBLE, STRING, BOOLEAN = "INTEGER", "DOUBLE", "STRING", "BOOLEAN"
NUMERIC = (INTEGER, DOUBLE)


@dataclass(frozen=True)
class Col:
    """An ordinal of the input; in a loop's condition, of the relation named."""

    ordinal: int
    relation: str | None = None


@dataclass(frozen=True)
class Lit:
    value: int | float | str | bool


@dataclass(frozen=True)
class Test:
    op: str
    left: Col | Lit
    right: Col | Lit


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(eq=False)
class Node:
    name: str = ""
    types: list[str] = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [c for c in (getattr(self, "child", None), getattr(self, "left", None), getattr(self, "right", None)) if isinstance(c, Node)]


@dataclass(eq=False)
class Input(Node):
    """A declared relation, bound to data when the workflow runs."""


@dataclass(eq=False)
class Bound(Node):
    """A relation of the enclosing environment, by name: what a loop's body reads."""


@dataclass(eq=False)
class Project(Node):
    child: Node = None
    columns: list[int] = field(default_factory=list)
    where: object = None


@dataclass(eq=False)
class Arithmetic(Node):
    child: Node = None
    op: str = "SUM"
    a: Col | Lit = None
    b: Col | Lit = None
    target: int = 0
    where: object = None


@dataclass(eq=False)
class Aggregate(Node):
    child: Node = None
    op: str = "+"
    columns: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    where: object = None


@dataclass(eq=False)
class Count(Node):
    child: Node = None
    keys: list[int] = field(default_factory=list)
    where: object = None
    label: bool = True


@dataclass(eq=False)
class Extreme(Node):
    child: Node = None
    largest: bool = True
    columns: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    where: object = None


@dataclass(eq=False)
class Join(Node):
    left: Node = None
    right: Node = None
    left_keys: list[int] = field(default_factory=list)
    right_keys: list[int] = field(default_factory=list)


@dataclass(eq=False)
class Cross(Node):
    left: Node = None
    right: Node = None


@dataclass(eq=False)
class SetOperation(Node):
    left: Node = None
    right: Node = None
    op: str = "UNION"


@dataclass(eq=False)
class Distinct(Node):
    child: Node = None


@dataclass(eq=False)
class Sort(Node):
    child: Node = None
    column: int = 0
    ascending: bool = True
    where: object = None


@dataclass(eq=False)
class Rename(Node):
    """The child under a new relation name, its columns labelled for output."""

    child: Node = None
    labels: list[str] | None = None


@dataclass(eq=False)
class RowFunction(Node):
    child: Node = None
    function: str = ""


@dataclass(eq=False)
class Source(Node):
    """A black box: a registered callable that makes the relation."""

    key: str = ""


@dataclass(eq=False)
class Loop(Node):
    """A pre-test loop.  ``body`` binds names in order; ``reads`` are the outer relations it uses."""

    condition: object = None
    body: list[tuple[str, Node]] = field(default_factory=list)
    outer: dict[str, Node] = field(default_factory=dict)


@dataclass(eq=False)
class LoopResult(Node):
    loop: Loop = None

    @property
    def children(self) -> list[Node]:
        return list(self.loop.outer.values())

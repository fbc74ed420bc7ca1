"""Algebra of queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from .terms import Term, Var

Node = Term | Var


class Refused(ValueError):
    """A form that the engine does not take, or a query that is wrong."""


# expressions


@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or built-in by name: ``&& || ! = != < > <= >= + - * / neg``, or a function in capitals."""

    name: str
    args: tuple


@dataclass(frozen=True)
class In:
    value: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    """``arg`` is None for ``*``."""

    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


Expr = Const | Ref | Call | In | Aggregate


# property paths


@dataclass(frozen=True)
class Link:
    iri: Term


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    left: object
    right: object


@dataclass(frozen=True)
class Alternative:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """``*``, ``+`` or ``?``."""

    path: object
    how: str


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# patterns


@dataclass
class Bgp:
    triples: list[tuple[Node, Node, Node]]


@dataclass
class PathPattern:
    subject: Node
    path: object
    object: Node


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: Expr | None = None


@dataclass
class Filter:
    condition: Expr
    inner: object


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Graph:
    name: Node
    inner: object


@dataclass
class Extend:
    inner: object
    name: str
    expr: Expr


@dataclass
class Values:
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Group:
    inner: object
    keys: list[tuple[str, Expr]]
    aggregates: list[tuple[str, Aggregate]]


@dataclass
class Project:
    inner: object
    names: list[str]


@dataclass
class Distinct:
    inner: object


@dataclass
class OrderBy:
    inner: object
    keys: list[tuple[Expr, bool]]


@dataclass
class Slice:
    inner: object
    offset: int
    limit: int | None


@dataclass
class Dataset:
    default: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)

    @property
    def given(self) -> bool:
        return bool(self.default or self.named)


@dataclass
class Query:
    """``form`` is select, ask, construct or describe; ``explain`` empty, text or json."""

    form: str
    pattern: object
    names: list[str]
    dataset: Dataset
    template: list[tuple[Node, Node, Node]] = field(default_factory=list)
    targets: list[Node] = field(default_factory=list)
    explain: str = ""
    disabled: tuple[str, ...] = ()


Quad = tuple[Node | None, Node, Node, Node]


@dataclass
class Modify:
    delete: list[Quad]
    insert: list[Quad]
    pattern: object
    dataset: Dataset
    with_graph: str | None = None


@dataclass
class Data:
    insert: bool
    quads: list[Quad]


@dataclass
class Manage:
    """clear, drop, create; ``target`` is an IRI, or default, named or all in capitals."""

    verb: str
    target: str
    silent: bool


@dataclass
class Transfer:
    """add, move, copy; None is the default graph."""

    verb: str
    source: str | None
    to: str | None
    silent: bool


@dataclass
class Load:
    source: str
    into: str | None
    silent: bool


def variables(node: object) -> list[str]:
    """Variables in scope, in order of appearance. Names of blank nodes and of helpers begin with a dot."""
    seen: dict[str, None] = {}

    def add(*nodes: object) -> None:
        for n in nodes:
            if isinstance(n, Var):
                seen[n.name] = None

    def walk(n: object) -> None:
        if isinstance(n, Bgp):
            for t in n.triples:
                add(*t)
        elif isinstance(n, PathPattern):
            add(n.subject, n.object)
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, (Filter, Distinct, OrderBy, Slice)):
            walk(n.inner)
        elif isinstance(n, Graph):
            add(n.name)
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            seen[n.name] = None
        elif isinstance(n, Values):
            seen.update(dict.fromkeys(n.names))
        elif isinstance(n, Group):
            seen.update(dict.fromkeys([k for k, _ in n.keys] + [k for k, _ in n.aggregates]))
        elif isinstance(n, Project):
            seen.update(dict.fromkeys(n.names))

    walk(node)
    return list(seen)


def mentioned(expr: object) -> set[str]:
    """Variables that an expression uses."""
    if isinstance(expr, Ref):
        return {expr.name}
    if isinstance(expr, Call):
        return set().union(*map(mentioned, expr.args)) if expr.args else set()
    if isinstance(expr, In):
        return mentioned(expr.value).union(*map(mentioned, expr.items))
    if isinstance(expr, Aggregate):
        return mentioned(expr.arg) if expr.arg else set()
    return set()

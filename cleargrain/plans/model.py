"""Logical plans: a validated directed acyclic graph of nodes, its canonical JSON and fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, deque
from dataclasses import dataclass, field, fields, is_dataclass

from cleargrain.errors import Category, fail, secret_key, secret_value
from cleargrain.functions import expressions
from cleargrain.functions.expressions import Expr, Lit, guard
from cleargrain.plans.types import LogicalField, LogicalType, simple, timestamp

#: Fixed limits of plans.
PLAN_VERSION, MAX_NODES, MAX_RULES, MAX_BYTES, MAX_KEYS = 1, 64, 256, 4 << 20, 64


# --- rules


class Rule:
    pass


@dataclass(frozen=True)
class Rename(Rule):
    column: str
    to: str


@dataclass(frozen=True)
class CastColumn(Rule):
    column: str
    type: LogicalType
    on_failure: str = "error"  # or set_null


@dataclass(frozen=True)
class Trim(Rule):
    column: str


@dataclass(frozen=True)
class ReplaceLiteral(Rule):
    column: str
    old: Expr
    new: Expr


@dataclass(frozen=True)
class FillNull(Rule):
    column: str
    value: Expr


@dataclass(frozen=True)
class DropColumn(Rule):
    column: str


@dataclass(frozen=True)
class DeriveColumn(Rule):
    id: str
    name: str
    type: LogicalType
    expression: Expr
    nullable: bool = True


@dataclass(frozen=True)
class FilterRows(Rule):
    predicate: Expr


@dataclass(frozen=True)
class Deduplicate(Rule):
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Validate(Rule):
    predicate: Expr
    severity: str  # warning or error
    message: str


# --- nodes


class Node:
    """A node names its inputs in `inputs`."""


@dataclass(frozen=True)
class Scan(Node):
    asset: str
    projection: tuple[str, ...]
    predicate: Expr | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return ()


@dataclass(frozen=True)
class Project(Node):
    inputs: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Filter(Node):
    inputs: tuple[str, ...]
    predicate: Expr


@dataclass(frozen=True)
class ApplyRules(Node):
    inputs: tuple[str, ...]
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Join(Node):
    inputs: tuple[str, ...]
    how: str
    keys: tuple[tuple[Expr, Expr], ...]


@dataclass(frozen=True)
class Union(Node):
    inputs: tuple[str, ...]


@dataclass(frozen=True)
class Materialize(Node):
    inputs: tuple[str, ...]
    label: str


JOINS = ("inner", "left", "right", "full", "semi", "anti")


@dataclass(frozen=True)
class Plan:
    nodes: dict[str, Node]
    root: str
    version: int = PLAN_VERSION
    order: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if self.version != PLAN_VERSION:
            fail(Category.INVALID_PLAN, "no such plan version")
        if self.root not in self.nodes:
            fail(Category.INVALID_PLAN, "the root isn't a node")
        if len(self.nodes) > MAX_NODES:
            fail(Category.LIMIT_EXCEEDED, "the plan has too many nodes")
        for node in self.nodes.values():
            _check(node, self.nodes)
        object.__setattr__(self, "order", _sorted(self.nodes))
        if len(self.canonical()) > MAX_BYTES:
            fail(Category.LIMIT_EXCEEDED, "the plan is too large")

    def canonical(self) -> bytes:
        body = {"version": self.version, "root": self.root, "nodes": {k: _json(v) for k, v in self.nodes.items()}}
        return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()

    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical()).hexdigest()


    @staticmethod
    def from_json(text: str | bytes) -> Plan:
        """A plan from its canonical JSON; what isn't one is an invalid plan."""
        if len(text) > MAX_BYTES:
            fail(Category.LIMIT_EXCEEDED, "the plan is too large")
        try:
            body = json.loads(text)
            return Plan({k: _parsed(v) for k, v in body["nodes"].items()}, body["root"], body["version"])
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            return fail(Category.INVALID_PLAN, "the plan can't be read")


def _parsed(value: object, depth: int = 0) -> object:
    """What `_json` made, back as objects of the kinds that a plan may hold."""
    if depth > 4 * MAX_NODES:
        fail(Category.LIMIT_EXCEEDED, "the plan is nested too deeply")
    if isinstance(value, list):
        return tuple(_parsed(v, depth + 1) for v in value)
    if not isinstance(value, dict):
        return value
    kind = _KINDS[value["kind"]]
    if kind is Lit:
        return Lit(value["value"], value["literal"])
    made = {}
    for f in fields(kind):
        made[f.name] = _parsed_type(value[f.name]) if f.type == "LogicalType" else _parsed(value[f.name], depth + 1)
    return kind(**made)


def _parsed_type(value: object) -> LogicalType:
    if isinstance(value, str):
        return simple(value)
    if "timestamp" in value:
        return timestamp(value["timestamp"]["unit"], value["timestamp"]["timezone"])
    if "list" in value:
        return LogicalType("list", item=_parsed_type(value["list"]))
    return LogicalType("struct", fields=tuple(LogicalField(f["id"], f["name"], _parsed_type(f["type"]), f["nullable"], tuple(f["metadata"].items())) for f in value["struct"]))


def _json(value: object) -> object:
    if isinstance(value, LogicalType):
        return value.json()
    if is_dataclass(value):
        return {f.name: _json(getattr(value, f.name)) for f in fields(value)} | ({"literal": value.kind} if isinstance(value, Lit) else {}) | {"kind": type(value).__name__}
    if isinstance(value, (tuple, list)):
        return [_json(v) for v in value]
    return value


def _sorted(nodes: dict[str, Node]) -> tuple[str, ...]:
    """Inputs before what reads them; a cycle leaves nodes over."""
    waiting = {k: len(set(n.inputs)) for k, n in nodes.items()}
    readers: dict[str, list[str]] = {}
    for k, n in nodes.items():
        for i in set(n.inputs):
            readers.setdefault(i, []).append(k)
    ready, out = deque(sorted(k for k, n in waiting.items() if not n)), []
    while ready:
        out.append(at := ready.popleft())
        for k in sorted(readers.get(at, ())):
            waiting[k] -= 1
            if not waiting[k]:
                ready.append(k)
    if len(out) < len(nodes):
        fail(Category.INVALID_PLAN, "the plan has a cycle")
    return tuple(out)


def _unique(values: tuple[str, ...], what: str) -> None:
    if not values:
        fail(Category.INVALID_PLAN, f"{what} needs a column")
    if max(Counter(values).values()) > 1:
        fail(Category.INVALID_PLAN, f"{what} names a column twice")


def _check(node: Node, nodes: dict[str, Node]) -> None:
    if any(i not in nodes for i in node.inputs):
        fail(Category.INVALID_PLAN, "an input isn't a node")
    arity = {Scan: (0, 0), Join: (2, 2), Union: (2, MAX_NODES)}.get(type(node), (1, 1))
    if not arity[0] <= len(node.inputs) <= arity[1]:
        fail(Category.INVALID_PLAN, f"{type(node).__name__} has the wrong number of inputs")
    match node:
        case Scan(asset=asset, projection=projection, predicate=p):
            if not asset:
                fail(Category.INVALID_PLAN, "a scan needs an asset")
            _unique(projection, "a scan")
            if p is not None:
                guard(p)
        case Project(columns=columns):
            _unique(columns, "a projection")
        case Filter(predicate=p):
            guard(p)
        case ApplyRules(rules=rules):
            if not rules or len(rules) > MAX_RULES:
                fail(Category.INVALID_PLAN, "a rule node has too few or too many rules")
            for rule in rules:
                check_rule(rule)
        case Join(how=how, keys=keys):
            if how not in JOINS or not keys:
                fail(Category.INVALID_PLAN, "a join needs a type and keys")
            for pair in keys:
                for e in pair:
                    guard(e)
        case Materialize(label=label):
            if not label.strip() or secret_key(label) or secret_value(label):
                fail(Category.INVALID_PLAN, "an output needs a label that is no secret")


def check_rule(rule: Rule) -> None:
    match rule:
        case Rename(to=to):
            if not to.strip():
                fail(Category.INVALID_PLAN, "a column name is blank")
        case CastColumn(on_failure=policy):
            if policy not in ("error", "set_null"):
                fail(Category.INVALID_PLAN, "no such cast policy")
        case ReplaceLiteral(old=a, new=b):
            guard(a), guard(b)
        case FillNull(value=v):
            guard(v)
        case DeriveColumn(name=name, expression=e):
            if not name.strip():
                fail(Category.INVALID_PLAN, "a column name is blank")
            guard(e)
        case FilterRows(predicate=p):
            guard(p)
        case Deduplicate(keys=keys):
            _unique(keys, "deduplication")
            if len(keys) > MAX_KEYS:
                fail(Category.LIMIT_EXCEEDED, "deduplication has too many keys")
        case Validate(predicate=p, severity=severity, message=message):
            guard(p)
            if severity not in ("warning", "error") or not message.strip() or secret_value(message):
                fail(Category.INVALID_PLAN, "validation needs a severity and a message that is no secret")


_KINDS = {
    k.__name__: k
    for k in (
        Scan, Project, Filter, ApplyRules, Join, Union, Materialize, Rename, CastColumn, Trim, ReplaceLiteral, FillNull, DropColumn, DeriveColumn, FilterRows, Deduplicate, Validate,
        expressions.Col, Lit, expressions.Unary, expressions.Binary, expressions.IsNull, expressions.Cast, expressions.Coalesce,
    )
}

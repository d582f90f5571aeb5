"""Operator trees of Scan, Filter, Project, Cross and Sort: a fluent builder and the JSON wire format."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

#: Operators and literal kinds of the wire format.
OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")
KINDS = ("I32", "I64", "F32", "F64", "String")


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    kind: str
    value: Any

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown literal kind {self.kind}")
        bits = {"I32": 31, "I64": 63}.get(self.kind)
        if bits:
            if isinstance(self.value, bool) or not isinstance(self.value, int) or not -(2**bits) <= self.value < 2**bits:
                raise ValueError(f"{self.value!r} is no {self.kind}")
        elif self.kind == "String":
            if not isinstance(self.value, str):
                raise ValueError(f"{self.value!r} is no String")
        else:
            value = float(self.value)
            if self.kind == "F32":
                value = struct.unpack("f", struct.pack("f", value))[0]
            object.__setattr__(self, "value", value)


def i32(value: int) -> Lit:
    return Lit("I32", value)


def i64(value: int) -> Lit:
    return Lit("I64", value)


def f32(value: float) -> Lit:
    return Lit("F32", value)


def f64(value: float) -> Lit:
    return Lit("F64", value)


def text(value: str) -> Lit:
    return Lit("String", value)


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Col | Lit

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown comparison {self.operator}")


class Plan:
    """A node; the methods put another node on top of it."""

    def filter(self, column: str, operator: str, value: Col | Lit) -> Filter:
        return Filter((Predicate(column, operator, value),), self)

    def filter_multiple(self, predicates: Iterable[Predicate | tuple]) -> Filter:
        return Filter(tuple(p if isinstance(p, Predicate) else Predicate(*p) for p in predicates), self)

    def project(self, source: str, name: str | None = None) -> Project:
        return Project(((source, name or source),), self)

    def project_multiple(self, columns: Iterable[tuple[str, str] | str]) -> Project:
        return Project(tuple((c, c) if isinstance(c, str) else tuple(c) for c in columns), self)

    def cross(self, right: Plan) -> Cross:
        return Cross(self, right)

    def sort(self, column: str, ascending: bool = True) -> Sort:
        return Sort(((column, ascending),), self)

    def sort_multiple(self, keys: Iterable[tuple[str, bool] | str]) -> Sort:
        return Sort(tuple((k, True) if isinstance(k, str) else tuple(k) for k in keys), self)

    def build(self) -> str:
        return to_json(self)


@dataclass(frozen=True)
class Scan(Plan):
    table: str


@dataclass(frozen=True)
class Filter(Plan):
    predicates: tuple[Predicate, ...]
    child: Plan


@dataclass(frozen=True)
class Project(Plan):
    columns: tuple[tuple[str, str], ...]
    child: Plan


@dataclass(frozen=True)
class Cross(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Sort(Plan):
    keys: tuple[tuple[str, bool], ...]
    child: Plan


def scan(table: str) -> Scan:
    return Scan(table)


def tables_of(plan: Plan) -> list[str]:
    """The tables that a tree scans, each once."""
    if isinstance(plan, Scan):
        return [plan.table]
    if isinstance(plan, Cross):
        return list(dict.fromkeys(tables_of(plan.left) + tables_of(plan.right)))
    return tables_of(plan.child)


def to_dict(plan: Plan) -> dict:
    """The tagged form of one node and all below it."""
    if isinstance(plan, Scan):
        return {"Scan": {"table_id": plan.table}}
    if isinstance(plan, Filter):
        shown = [{"column_name": p.column, "operator": p.operator, "value": {"Column": p.value.name} if isinstance(p.value, Col) else {p.value.kind: p.value.value}} for p in plan.predicates]
        return {"Filter": {"predicates": shown, "underlying": to_dict(plan.child)}}
    if isinstance(plan, Project):
        return {"Project": {"column_name_map": [list(c) for c in plan.columns], "underlying": to_dict(plan.child)}}
    if isinstance(plan, Cross):
        return {"Cross": {"left": to_dict(plan.left), "right": to_dict(plan.right)}}
    if isinstance(plan, Sort):
        return {"Sort": {"sort_specs": [{"column_name": c, "ascending": a} for c, a in plan.keys], "underlying": to_dict(plan.child)}}
    raise TypeError(f"not a plan: {plan!r}")


def from_dict(node: dict) -> Plan:
    if not isinstance(node, dict) or len(node) != 1:
        raise ValueError("a node is an object with one tag")
    (tag, body), *_ = node.items()
    if tag == "Scan":
        return Scan(body["table_id"])
    if tag == "Filter":
        return Filter(tuple(_predicate(p) for p in body["predicates"]), from_dict(body["underlying"]))
    if tag == "Project":
        return Project(tuple((a, b) for a, b in body["column_name_map"]), from_dict(body["underlying"]))
    if tag == "Cross":
        return Cross(from_dict(body["left"]), from_dict(body["right"]))
    if tag == "Sort":
        return Sort(tuple((k["column_name"], bool(k["ascending"])) for k in body["sort_specs"]), from_dict(body["underlying"]))
    raise ValueError(f"unknown node {tag}")


def _predicate(p: dict) -> Predicate:
    (kind, value), *_ = p["value"].items()
    return Predicate(p["column_name"], p["operator"], Col(value) if kind == "Column" else Lit(kind, value))


def to_json(plan: Plan) -> str:
    return json.dumps({"root": to_dict(plan)}, ensure_ascii=False)


def from_json(source: str | dict) -> Plan:
    found = json.loads(source) if isinstance(source, str) else source
    return from_dict(found["root"])

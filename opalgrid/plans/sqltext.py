"""Operator trees as SQL text, for other engines and as oracles.

The same scopes as in compilation: unique names inside, visible names at the root.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from .tree import Col, Cross, Filter, Plan, Project, Scan, Sort

SQL_OPERATORS = {"EQ": "=", "NE": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}
SQL_TYPES = {"I32": "INTEGER", "I64": "BIGINT", "F32": "REAL", "F64": "DOUBLE", "String": "VARCHAR"}


@dataclass
class _Query:
    text: str
    scope: list[tuple[str, str]]

    def name(self, visible: str) -> str:
        return next(i for v, i in self.scope if v == visible)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _literal(kind: str, value) -> str:
    if kind == "String":
        return "'" + value.replace("'", "''") + "'"
    shown = repr(value)
    if kind in ("F32", "F64") and not math.isfinite(value):
        shown = f"'{value}'"
    return f"CAST({shown} AS {SQL_TYPES[kind]})"


def to_sql(plan: Plan, columns: dict[str, list[str]], derived: dict[str, str] | None = None) -> str:
    """SQL of a tree; ``columns`` lists the columns of each table, ``derived`` has the SQL of tables that are none."""
    names = count()

    def walk(p: Plan) -> _Query:
        if isinstance(p, Scan):
            scope = [(c, f"k{next(names)}") for c in columns[p.table]]
            source = (derived or {}).get(p.table, _quoted(p.table))
            return _Query("SELECT " + ", ".join(f"{_quoted(c)} AS {i}" for c, i in scope) + f" FROM {source} t{next(names)}", scope)
        if isinstance(p, Cross):
            a, b = walk(p.left), walk(p.right)
            return _Query(f"SELECT * FROM ({a.text}) q{next(names)}, ({b.text}) q{next(names)}", a.scope + b.scope)
        below = walk(p.child)
        inner = f"({below.text}) q{next(names)}"
        if isinstance(p, Filter):
            tests = [f"{below.name(x.column)} {SQL_OPERATORS[x.operator]} {below.name(x.value.name) if isinstance(x.value, Col) else _literal(x.value.kind, x.value.value)}" for x in p.predicates]
            return _Query(f"SELECT * FROM {inner}" + (" WHERE " + " AND ".join(tests) if tests else ""), below.scope)
        if isinstance(p, Project):
            scope = [(to, f"k{next(names)}") for _, to in p.columns]
            return _Query("SELECT " + ", ".join(f"{below.name(a)} AS {i}" for (a, _), (_, i) in zip(p.columns, scope, strict=True)) + f" FROM {inner}", scope)
        assert isinstance(p, Sort)
        keys = ", ".join(f"{below.name(c)} {'ASC' if up else 'DESC'}" for c, up in p.keys)
        return _Query(f"SELECT * FROM {inner}" + (f" ORDER BY {keys}" if keys else ""), below.scope)

    q = walk(plan)
    return "SELECT " + ", ".join(f"{i} AS {_quoted(v)}" for v, i in q.scope) + f" FROM ({q.text}) root"

"""Compilation of operator trees to DataFrames.

Inside, every column has a unique name, and a scope lists the visible names in order. A name means its
left-most occurrence, so duplicate and dotted names and self-joins need no quoting; the visible names
return at the root. Errors of names and types are raised here, before any job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare
from ..sources.catalog import Catalog
from .tree import Col, Cross, Filter, Plan, Predicate, Project, Scan, Sort


class UnknownName(LookupError):
    """A table or column that does not exist."""


@dataclass(frozen=True)
class Field:
    visible: str
    internal: str
    dtype: T.DataType


@dataclass(frozen=True)
class Compiled:
    frame: DataFrame
    scope: tuple[Field, ...]

    def field(self, name: str) -> Field:
        for f in self.scope:
            if f.visible == name:
                return f
        raise UnknownName(f"unknown column {name}; there are {', '.join(f.visible for f in self.scope)}")

    def result(self) -> DataFrame:
        return self.frame.toDF(*[f.visible for f in self.scope])


class Compiler:
    """``strict_nan``: a predicate that meets NaN fails, instead of Spark's order with NaN above all numbers."""

    def __init__(self, catalog: Catalog, strict_nan: bool = False) -> None:
        self.catalog, self.strict_nan, self._names = catalog, strict_nan, count()

    def _fresh(self) -> str:
        return f"c{next(self._names)}"

    def compile(self, plan: Plan) -> Compiled:
        if isinstance(plan, Scan):
            frame = self.catalog.table(plan.table)
            scope = tuple(Field(f.name, self._fresh(), f.dataType) for f in frame.schema.fields)
            return Compiled(frame.toDF(*[f.internal for f in scope]), scope)
        if isinstance(plan, Filter):
            below = self.compile(plan.child)
            if not plan.predicates:
                return below
            return Compiled(below.frame.where(reduce(lambda a, b: a & b, [self._predicate(p, below) for p in plan.predicates])), below.scope)
        if isinstance(plan, Project):
            below = self.compile(plan.child)
            taken = [(below.field(source), name) for source, name in plan.columns]
            scope = tuple(Field(name, self._fresh(), f.dtype) for f, name in taken)
            return Compiled(below.frame.select(*[F.col(f.internal).alias(g.internal) for (f, _), g in zip(taken, scope, strict=True)]), scope)
        if isinstance(plan, Cross):
            left, right = self.compile(plan.left), self.compile(plan.right)
            return Compiled(left.frame.crossJoin(right.frame), left.scope + right.scope)
        if isinstance(plan, Sort):
            below = self.compile(plan.child)
            keys: dict[str, Column] = {}
            for name, ascending in plan.keys:
                f = below.field(name)
                keys.setdefault(f.internal, F.col(f.internal).asc() if ascending else F.col(f.internal).desc())
            return Compiled(below.frame.orderBy(*keys.values()), below.scope) if keys else below
        raise TypeError(f"not a plan: {plan!r}")

    def _predicate(self, p: Predicate, below: Compiled) -> Column:
        left = below.field(p.column)
        if isinstance(p.value, Col):
            right = below.field(p.value.name)
            out = compare.with_column(p.operator, F.col(left.internal), left.dtype, F.col(right.internal), right.dtype)
            floats = [f for f in (left, right) if isinstance(f.dtype, compare.FLOATS)]
        else:
            out = compare.with_literal(p.operator, F.col(left.internal), left.dtype, p.value.kind, p.value.value)
            floats = [left] if isinstance(left.dtype, compare.FLOATS) else []
        if self.strict_nan and floats:
            nan = reduce(lambda a, b: a | b, [F.isnan(f.internal) for f in floats])
            out = F.when(nan, F.raise_error(F.lit("NaN in a predicate"))).otherwise(out)
        return out


def compile_plan(plan: Plan, catalog: Catalog, strict_nan: bool = False, by_statistics: bool = False) -> DataFrame:
    """The lazy result of a tree; ``by_statistics`` puts its joins into the order that the catalog's statistics, or else the sizes of its tables, call for."""
    if by_statistics:
        # estimates are made of trees, and import them
        from .joins import SizedEstimator, order_joins

        plan = order_joins(plan, SizedEstimator(catalog))
    return Compiler(catalog, strict_nan).compile(plan).result()

"""Comparisons with strict types, and exact ones between integers and floating-point numbers.

All of them are built-in expressions. A literal is adapted to the type of its column on the driver, so that the
column stays bare and the predicate reaches the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: What a literal of each kind has for a type.
LITERAL_TYPES = {"I32": T.IntegerType(), "I64": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "String": T.StringType()}

_TOP = 2.0**63


class IncomparableTypes(TypeError):
    """A comparison between types that have no order in common."""


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"EQ": a == b, "NE": a != b, "GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op]


def flip(op: str) -> str:
    return {"GT": "LT", "GTE": "LTE", "LT": "GT", "LTE": "GTE"}.get(op, op)


def check(left: T.DataType, right: T.DataType) -> None:
    """Raise unless the two types are comparable: numbers, strings, or times with times and strings."""

    def family(t: T.DataType) -> str | None:
        return "number" if isinstance(t, INTEGERS + FLOATS) else "string" if isinstance(t, T.StringType) else "time" if isinstance(t, TIMES) else None

    a, b = family(left), family(right)
    if not a or not b or (a != b and {a, b} != {"time", "string"}):
        raise IncomparableTypes(f"{left.simpleString()} and {right.simpleString()} are incomparable types")


def _always(column: Column, holds: bool) -> Column:
    return column.isNotNull() if holds else F.lit(False)


def _long_with_float(op: str, column: Column, value: float) -> Column:
    """A BIGINT column against a floating-point literal, as one against an integer literal."""
    if math.isnan(value):  # sorts above every number
        return _always(column, op in ("NE", "LT", "LTE"))
    if value >= _TOP or value < -_TOP:
        return _always(column, op == "NE" or (op in ("LT", "LTE")) == (value > 0) and op != "EQ")
    if value == int(value):
        return _apply(op, column, F.lit(int(value)).cast("long"))
    if op in ("EQ", "NE"):
        return _always(column, op == "NE")
    low = F.lit(math.floor(value)).cast("long")
    return column > low if op in ("GT", "GTE") else column <= low


def _float_with_int(op: str, column: Column, value: int) -> Column:
    """A DOUBLE (or FLOAT) column against an integer that no double may equal."""
    near = float(value)
    if int(near) == value:
        return _apply(op, column, F.lit(near))
    if op in ("EQ", "NE"):
        return _always(column, op == "NE")
    below = near if int(near) < value else math.nextafter(near, -math.inf)
    # no double lies between `below` and the literal
    return column > F.lit(below) if op in ("GT", "GTE") else column <= F.lit(below)


def with_literal(op: str, column: Column, dtype: T.DataType, kind: str, value) -> Column:
    """``column op literal``; the literal has one of the five kinds."""
    check(dtype, LITERAL_TYPES[kind])
    if kind == "String":
        return _apply(op, column, F.lit(value))
    if kind in ("F32", "F64"):
        if isinstance(dtype, INTEGERS):
            if isinstance(dtype, T.LongType):
                return _long_with_float(op, column, value)
            return _apply(op, column, F.lit(float(value)))  # 32 bits are exact in a double
        # FLOAT columns against F32 stay bare; other pairs widen, which is exact
        return _apply(op, column, F.lit(value).cast("float") if kind == "F32" and isinstance(dtype, T.FloatType) else F.lit(float(value)))
    if isinstance(dtype, FLOATS):
        return _float_with_int(op, column, value)
    return _apply(op, column, F.lit(value).cast("int" if kind == "I32" else "long"))


def _long_float_columns(op: str, whole: Column, real: Column) -> Column:
    """Exact comparison of a BIGINT with a DOUBLE.

    Rounding to double is monotone, so where the rounded values differ their order is right. Where they
    agree the double is integral; 2**63 has no BIGINT and is above all of them.
    """
    rounded, real = whole.cast("double"), real.cast("double")
    exact = F.when(rounded != real, _apply(op, rounded, real)).when(real >= F.lit(_TOP), F.lit(op in ("LT", "LTE", "NE"))).otherwise(_apply(op, whole, real.cast("long")))
    # the first conjunct gives an equi-join a key
    return (rounded == real) & exact if op == "EQ" else exact


def with_column(op: str, left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """``left op right`` for two columns."""
    check(left_type, right_type)
    if isinstance(left_type, T.LongType) and isinstance(right_type, FLOATS):
        return _long_float_columns(op, left, right)
    if isinstance(right_type, T.LongType) and isinstance(left_type, FLOATS):
        return _long_float_columns(flip(op), right, left)
    if isinstance(left_type, INTEGERS) != isinstance(right_type, INTEGERS) and isinstance(left_type, INTEGERS + FLOATS):
        return _apply(op, left.cast("double"), right.cast("double"))
    return _apply(op, left, right)

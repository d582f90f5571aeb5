import itertools
import math

import pytest
from opalgrid.plans import Col, compile_plan, scan
from opalgrid.plans.tree import f32, f64, i32, i64, text
from opalgrid.sources.catalog import Catalog, of_frame

LONGS = [0, 1, -1, 42, 2**53, 2**53 + 1, -(2**53) - 1, 2**63 - 1, -(2**63), 10, 11]
DOUBLES = [0.0, -0.0, 0.5, 41.5, 42.0, 10.5, -0.5, float(2**53), float(2**53 + 2), 2.0**63, -(2.0**63), 1e300, -1e300, math.inf, -math.inf]
TESTS = {"EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b}


@pytest.fixture(scope="module")
def catalog(spark):
    longs = spark.createDataFrame([(x,) for x in LONGS], "l long")
    doubles = spark.createDataFrame([(x,) for x in DOUBLES], "d double")
    mixed = spark.createDataFrame([(i, float(f), f) for i, f in zip([1, 2, 3], [0.05, 0.5, 16777217.0], strict=True)], "i int, f float, d double")
    return Catalog([of_frame("longs", longs), of_frame("doubles", doubles), of_frame("mixed", mixed), of_frame("words", spark.createDataFrame([("Z",), ("a",), ("é",), ("z",), ("",)], "s string"))])


@pytest.mark.parametrize("op", TESTS)
def test_long_and_double_columns_compare_exactly(op, catalog):
    for plan in (scan("longs").cross(scan("doubles")).filter("l", op, Col("d")), scan("doubles").cross(scan("longs")).filter("d", op, Col("l"))):
        swapped = plan.predicates[0].column == "d"
        got = sorted(str((r.l, r.d)) for r in compile_plan(plan, catalog).collect())
        want = sorted(str((a, b)) for a, b in itertools.product(LONGS, DOUBLES) if (TESTS[op](b, a) if swapped else TESTS[op](a, b)))
        assert got == want


@pytest.mark.parametrize("op", TESTS)
def test_literals_compare_exactly(op, catalog):
    for v in DOUBLES:
        got = sorted(r.l for r in compile_plan(scan("longs").filter("l", op, f64(v)), catalog).collect())
        assert got == sorted(x for x in LONGS if TESTS[op](x, v)), v
    for v in LONGS:
        got = sorted(str(r.d) for r in compile_plan(scan("doubles").filter("d", op, i64(v)), catalog).collect())
        assert got == sorted(str(x) for x in DOUBLES if TESTS[op](x, v)), v


def test_literals_keep_the_column_bare(catalog, spark, tmp_path):
    spark.createDataFrame([(1,)], "l long").write.parquet(f"{tmp_path}/t")
    one = Catalog([of_frame("t", spark.read.parquet(f"{tmp_path}/t"))])
    plan = compile_plan(scan("t").filter("l", "LTE", f64(10.5)), one)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l,10)" in plan


def test_float_literals_widen_exactly(catalog):
    assert compile_plan(scan("mixed").filter("f", "EQ", f32(0.05)), catalog).count() == 1
    assert compile_plan(scan("mixed").filter("f", "EQ", f64(0.05)), catalog).count() == 0
    assert compile_plan(scan("mixed").filter("d", "EQ", f32(0.05)), catalog).count() == 0
    assert compile_plan(scan("mixed").filter("i", "GTE", f64(1.5)), catalog).count() == 2
    assert compile_plan(scan("mixed").filter("d", "EQ", i32(16777217)), catalog).count() == 1
    assert compile_plan(scan("mixed").filter("f", "EQ", i32(16777217)), catalog).count() == 0


def test_strings_compare_by_bytes(catalog):
    assert sorted(r.s for r in compile_plan(scan("words").filter("s", "GT", text("a")), catalog).collect()) == ["z", "é"]


def test_joins_of_integral_floats_and_signed_zeros(spark, catalog):
    a = of_frame("a", spark.createDataFrame([(0,), (42,)], "x long"))
    b = of_frame("b", spark.createDataFrame([(-0.0,), (42.0,), (42.5,)], "y double"))
    rows = compile_plan(scan("a").cross(scan("b")).filter("x", "EQ", Col("y")), Catalog([a, b])).collect()
    assert sorted((r.x, r.y) for r in rows) == [(0, -0.0), (42, 42.0)]


def test_nan(spark):
    t = Catalog([of_frame("t", spark.createDataFrame([(math.nan, 1), (1.0, 2)], "d double, l long"))])
    assert compile_plan(scan("t").filter("d", "GT", f64(0.5)), t).count() == 2
    assert compile_plan(scan("t").filter("l", "LT", f64(math.nan)), t).count() == 2
    assert compile_plan(scan("t").filter("l", "LT", Col("d")), t).count() == 1
    with pytest.raises(Exception, match="NaN in a predicate"):
        compile_plan(scan("t").filter("d", "GT", f64(0.5)), t, strict_nan=True).collect()

import json

import pytest
from conftest import same_as_duck
from opalgrid.operators.diskcost import Disk, access_costs
from opalgrid.operators.estimate import Estimator, string_position
from opalgrid.operators.profile import column_stats, histogram, physically_ordered, profile, string_histogram
from opalgrid.plans import Col, compile_plan, scan
from opalgrid.plans import workload as w
from opalgrid.plans.runner import SuiteQuery, dump_suite, load_suite, record_expected, run_suite, starter_suite
from opalgrid.plans.tree import f64, i32, text, to_json
from opalgrid.sources.blocks import decode_block, encode_blocks, read_blocks, write_blocks
from opalgrid.sources.catalog import Catalog, CatalogError, ColumnInfo, TableInfo, of_frame
from opalgrid.sources.sqlite import write_sqlite
from opalgrid.sources.text import ResultMismatch, discover, lines, parse_schema, read_text, same_rows, validate_lines, write_lines
from opalgrid.streaming import follow
from pyspark.sql import types as T


def test_schema_files():
    found = parse_schema("a|b|c|d|e|\ni32|I64|float32|FLOAT64|String|\n")
    assert [f.dataType.simpleString() for f in found.fields] == ["int", "bigint", "float", "double", "string"]
    for bad in ("a|b\nI32", "a\nDATE", "a"):
        with pytest.raises(CatalogError):
            parse_schema(bad)


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1|x "y"|2.5|\n2||-1|\n3|z|1e3\n')
    (tmp_path / "t.schema").write_text("k|s|d\nI32|STRING|FLOAT64\n")
    (tmp_path / "lone.csv").write_text("1\n")
    catalog, skipped = discover(spark, str(tmp_path))
    assert skipped == ["lone.csv"]
    rows = [tuple(r) for r in catalog.table("t").orderBy("k").collect()]
    assert rows == [(1, 'x "y"', 2.5), (2, "", -1.0), (3, "z", 1000.0)]
    (tmp_path / "bad.csv").write_text("x\n")
    with pytest.raises(Exception):
        read_text(spark, f"{tmp_path}/bad.csv", parse_schema("k\nI32")).collect()


def test_block_files(spark, tmp_path):
    types = ["int", "bigint", "float", "double", "string"]
    rows = [(i, -(2**40) * i, 0.5 * i, 1 / (i + 1), "é" * (i % 40)) for i in range(500)]
    packed = list(encode_blocks(rows, types, 256))
    assert {len(b) for b in packed} == {256}
    assert [r for b in packed for r in decode_block(b, types)] == rows
    assert not list(encode_blocks([], types, 256))
    with pytest.raises(ValueError):
        list(encode_blocks([(1, "x" * 300)], ["int", "string"], 256))
    frame = spark.createDataFrame(rows, "a int, b long, c float, d double, e string").repartition(3)
    write_blocks(frame, f"{tmp_path}/blocks", 256)
    back = read_blocks(spark, f"{tmp_path}/blocks", frame.schema, 256)
    assert same_rows(back, frame)
    assert back.where("a = 7").count() == 1


def test_result_lines(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 2.5), (2, None, -1.0)], "k int, s string, d double").orderBy("k")
    assert lines(frame) == ["1|a|2.5|", "2||-1.0|"] and lines(frame.select(frame.k, frame.k)) == ["1|1|", "2|2|"]
    write_lines(frame, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["1|a|2.5|", "2||-1.0|"]
    validate_lines(["a|", "b| "], [" b|", "a|"], in_order=False)
    for got, want, order in ((["a|", "b|"], ["b|", "a|"], True), (["a|"], ["a|", "b|"], False), (["a|", "a|"], ["a|", "b|"], False), (["", "a|"], ["a|", "b|"], False)):
        with pytest.raises(ResultMismatch):
            validate_lines(got, want, order)
    assert not same_rows(frame, frame.union(frame.limit(1)))


def test_numbers_as_text(spark):
    """The digits of floats as written by the shortest form, plain from 0.0001 to 10**16."""
    cases = {0.5: "0.5", 100.0: "100.0", -2.25: "-2.25", 1e7: "10000000.0", 12345678.9: "12345678.9", 1.5e15: "1500000000000000.0", 1e16: "1e16", -1.25e20: "-1.25e20", 0.001: "0.001", 0.00025: "0.00025", 0.0001: "0.0001", 2.5e-5: "2.5e-5", 1e-7: "1e-7", -0.0: "-0.0", 123456789012345.6: "123456789012345.6", 1e300: "1e300"}
    frame = spark.createDataFrame([(x,) for x in [*cases, float("nan"), float("inf"), float("-inf"), None]], "v double")
    assert lines(frame) == [f"{x}|" for x in [*cases.values(), "NaN", "inf", "-inf", ""]]
    single = spark.createDataFrame([(1e7,), (0.1,), (1e-4,), (3e38,)], "v float")
    assert lines(single) == ["10000000.0|", "0.1|", "0.0001|", "3e38|"]


def test_results_as_streams(spark, tmp_path):
    from opalgrid.sources.text import read_lines, stream_lines, validate_bags

    frame = spark.range(200).selectExpr("id", "concat('x', id) s").repartition(5).orderBy("id")
    got = list(stream_lines(frame))
    assert got[-1] == "!" and got[:-1] == [f"{i}|x{i}|" for i in range(200)]
    write_lines(frame, f"{tmp_path}/out", end=True)
    assert list(read_lines(spark, f"{tmp_path}/out")) == got
    text_ = spark.read.text(f"{tmp_path}/out")
    validate_bags(text_.repartition(3), text_)
    for other in (text_.where("value <> '!'"), text_.unionByName(text_.limit(1))):
        with pytest.raises(ResultMismatch):
            validate_bags(other, text_)
    with pytest.raises(ResultMismatch):
        validate_lines(iter(got), iter(got[:-1]), True)
    with pytest.raises(ResultMismatch):
        validate_lines(iter(got[:-1]), iter(got), True)


def test_memory_limits_are_settings(spark):
    from opalgrid.plans.runner import within_memory

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    with within_memory(spark, 64):
        assert int(spark.conf.get(key)) == 8 << 20
    assert spark.conf.get(key) == before


def test_fixed_width_blocks(spark, tmp_path):
    frame = spark.range(5000).selectExpr("cast(id as int) a", "id b", "cast(id as float) c", "id / 3 as d")
    write_blocks(frame.repartition(2), f"{tmp_path}/b", 128)
    assert same_rows(read_blocks(spark, f"{tmp_path}/b", frame.schema, 128), frame)


def test_sqlite_gives_the_same_results(spark, tiny, tmp_path):
    """A third engine: the workload's SQL on exported tables."""
    import sqlite3

    catalog = Catalog.from_dir(spark, tiny, ["region", "nation", "supplier", "customer"])
    path = str(tmp_path / "t.db")
    assert write_sqlite(catalog, path, ["region", "nation", "customer"])["customer"] == 150
    con = sqlite3.connect(path)
    for q in w.WORKLOAD + w.FEATURES:
        if q.name in ("join_sort_q46", "filter_q11", "sort_q20", "cross_q31", "theta_join", "self_join_renamed"):
            got = sorted(str(tuple(r)) for r in compile_plan(q.plan, catalog).collect())
            assert got == sorted(map(str, con.execute(q.sql()).fetchall())), q.name


def test_suite(spark, tiny, tmp_path):
    catalog = Catalog.from_dir(spark, tiny)
    suite = []
    for q in w.WORKLOAD[:3] + [x for x in w.WORKLOAD if x.name == "join_sort_q43"]:
        (tmp_path / q.name).write_text("".join(x + "\n" for x in lines(compile_plan(q.plan, catalog))))
        suite.append(SuiteQuery(q.name, q.plan, str(tmp_path / q.name), sort_before_check=not q.ordered))
    again = load_suite(dump_suite(suite))
    assert again == suite and set(run_suite(spark, again, catalog)) == {q.name for q in suite}
    suite[0].disabled = True
    assert suite[0].name not in run_suite(spark, suite, catalog)
    (tmp_path / suite[1].name).write_text("nothing|\n")
    with pytest.raises(ResultMismatch, match=suite[1].name):
        run_suite(spark, suite, catalog)
    starter = starter_suite(catalog, str(tmp_path / "expected"))
    assert len(starter) == 2 and run_suite(spark, starter, catalog) == {}
    record_expected(starter, catalog)
    for q in starter:
        q.disabled = False
    assert len(run_suite(spark, starter, catalog)) == 2
    with pytest.raises(ValueError):
        SuiteQuery("x", scan("nation"), "f", memory_limit_mb=32)
    with pytest.raises(ValueError):
        load_suite(json.dumps({"query_configs": [json.loads(dump_suite(suite[:1]))["query_configs"][0]] * 2}))


@pytest.mark.parametrize("table", w.PROFILED)
def test_column_stats_equal_sql(table, spark, tiny, duck):
    same_as_duck(column_stats(spark.read.parquet(f"{tiny}/{table}.parquet")), duck, w.stats_sql(table))


def test_histograms(spark):
    frame = spark.range(1000).selectExpr("cast(id as double) v", "concat('w', id % 7) s")
    rows = histogram(frame, "v").orderBy("bucket").collect()
    assert len(rows) == 10 and sum(r.frequency for r in rows) == 1000
    assert all(90 <= r.frequency <= 110 for r in rows) and all(a.upper_bound < b.lower_bound for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r.frequency for r in string_histogram(frame, "s").collect()) == 1000
    assert histogram(frame.selectExpr("1.0 as v"), "v").collect()[0].frequency == 1000
    assert histogram(frame.where("v < 0"), "v").count() == 0


def test_bounds_of_histograms_are_exact(spark, monkeypatch):
    """Against sorting: distinct values, heavy ones, nulls, NaN and infinite ones, whatever the sketches' accuracy and the rows of a gap."""
    import math
    import random

    from opalgrid.operators import profile as p

    rng = random.Random(8)
    kinds = {
        "distinct": lambda: rng.uniform(-1e6, 1e6),
        "heavy": lambda: float(rng.choice([1, 2, 2, 2, 2, 2, rng.randrange(10_000)])),
        "odd": lambda: rng.choice([None, math.nan, math.inf, -math.inf, rng.gauss(0, 1), 10 ** rng.uniform(-300, 300), 0.0]),
        "none": lambda: None,
    }
    rows = [tuple(f() for f in kinds.values()) for _ in range(5003)]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in kinds)).repartition(5)
    want = {}
    for j, name in enumerate(kinds):
        values = sorted((r[j] for r in rows if r[j] is not None), key=lambda x: (math.isnan(x), x))
        bounds = {values[max(1, -(-b * len(values) // 10)) - 1] for b in range(1, 10)} if values else set()
        above = [sum(v > b or (math.isnan(v) and not math.isnan(b)) for b in bounds) for v in values]
        want |= {(name, b): above.count(b) for b in above}
    for accuracy, gap in ((10_000, 100_000), (100, 100), (10_000, 0)):
        monkeypatch.setattr(p, "GAP_ROWS", gap)
        got = p.histograms(frame, list(kinds), accuracy=accuracy).collect()
        assert {(r.column_name, r.bucket): r.frequency for r in got} == want


@pytest.mark.parametrize("table", ["lineitem"])
def test_registered_histograms_equal_their_sql_where_prices_are_many(table, spark, duck, tmp_path):
    column = w.HISTOGRAMS[table]
    spark.range(0, 2_000_000, 1, 8).selectExpr(f"900 + rand(5) * 1e5 as {column}").write.parquet(f"{tmp_path}/{table}.parquet")
    con = duck.cursor()
    con.sql(f"create temp view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert same_as_duck(w.queries()[f"stats_histogram_{table}"](spark, str(tmp_path)), con, w.oracle_sql()[f"stats_histogram_{table}"]) == 10


def test_physical_order(spark, tmp_path):
    spark.range(100).selectExpr("id", "-id as down", "id div 10 as steps", "id % 10 as saw").coalesce(1).write.parquet(f"{tmp_path}/o")
    found = {r.column_name: r.ordered for r in physically_ordered(spark.read.parquet(f"{tmp_path}/o")).collect()}
    assert found == {"id": True, "down": False, "steps": True, "saw": False}
    two = spark.range(0, 10, 1, 2)
    assert physically_ordered(two).first().ordered
    assert not physically_ordered(two.union(spark.range(5))).first().ordered


def test_physical_order_of_several_files(spark, tmp_path):
    """Files are in the order of their names, not in that in which a scan packs them: the largest first."""
    for folder, parts in (("o", [(0, 10), (10, 200_000), (200_000, 200_005)]), ("x", [(10, 200_000), (0, 10)])):
        for i, (lo, hi) in enumerate(parts):
            spark.range(lo, hi).coalesce(1).write.parquet(f"{tmp_path}/{folder}-{i}")
            (found,) = (tmp_path / f"{folder}-{i}").glob("part-*.parquet")
            (tmp_path / folder).mkdir(exist_ok=True)
            found.rename(tmp_path / folder / f"part-{i}.parquet")
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            frame = spark.read.parquet(f"{tmp_path}/o")
            assert physically_ordered(frame).first().ordered and not physically_ordered(spark.read.parquet(f"{tmp_path}/x")).first().ordered
            assert physically_ordered(frame.select("id")).first().ordered
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert physically_ordered(spark.read.parquet(f"{tmp_path}/o").where("id < 0")).first().ordered


def test_stats_of_columns_with_few_and_many_values(spark, monkeypatch):
    from opalgrid.operators import profile as p

    monkeypatch.setattr(p, "EXACT_LIMIT", 50)
    frame = spark.range(1000).selectExpr("id", "id % 7 as few", "cast(null as string) as none", "if(id < 10, null, id % 40) as some")
    exact = {r.column_name: r.cardinality for r in column_stats(frame).collect()}
    assert exact == {"id": 1000, "few": 7, "none": 0, "some": 40}
    rough = {r.column_name: r.cardinality for r in column_stats(frame, exact=None).collect()}
    assert rough["few"] == 7 and rough["some"] == 40 and abs(rough["id"] - 1000) < 80
    assert string_histogram(frame.selectExpr("cast(id as string) s"), "s").count() == 0


def test_disk_costs_over_ranges(spark):
    """Cut into ranges and disks, against one after the other."""
    import random

    rng = random.Random(4)
    rows = [(d, i * 3, rng.randrange(10**6), rng.randrange(0, 5)) for d in "ab" for i in range(150)]
    frame = spark.createDataFrame(rows, "disk string, seq long, start_block long, num_blocks long").repartition(5)
    one = {(r.disk, r.seq): r.total_us for r in access_costs(frame, by=["disk"], parts=1).collect()}
    for parts in (3, 40):
        assert {(r.disk, r.seq): r.total_us for r in access_costs(frame, by=["disk"], parts=parts).collect()} == one
    at, got = {"a": 0, "b": 0}, {}
    for d, i, start, n in rows:
        if n:
            got[d, i] = 0.0 if start == at[d] + 1 else 0.5 * 60_000 / 7200 * 1000
            at[d] = start + n - 1
    assert {(r.disk, r.seq): r.rotation_us for r in access_costs(frame, by=["disk"], parts=7).collect()} == pytest.approx(got)


def test_profile(spark):
    p = profile(spark.range(100).selectExpr("id", "concat('x', id % 3) s", "cast(id as double) / 3 d").coalesce(1))
    assert (p["id"].rows, p["id"].cardinality, p["id"].density, p["id"].ordered) == (100, 100, 1.0, True)
    assert p["s"].lower is None and p["s"].cardinality == 3 and len(p["s"].histogram) <= 3
    stats = p["id"].stats()
    assert stats[0] == "IsPhysicallyOrdered" and stats[1] == {"RangeStat": {"lower_bound": {"Int64": 0}, "upper_bound": {"Int64": 99}}}
    assert profile(spark.range(0).toDF("a"))["a"].stats() == []


def test_rows_of_a_profile_are_exact(spark):
    """Whether distinct values are sketched, above or below their number, or few among many rows."""
    from opalgrid.operators.estimate import Stats

    for rows, values in ((30_000, ["id", "cast(id as string) s", "id div 2 as half", "-id as down"]), (20_000_003, ["id % 3 as few", "id % 7 as more"])):
        found = profile(spark.range(rows).selectExpr(*values), with_order=False, with_histogram=False)
        assert {k: Stats(p.stats()).rows for k, p in found.items()} == dict.fromkeys(found, rows)
        assert all(p.density <= 1.0 and p.cardinality <= rows for p in found.values())


def known(name, rows, columns):
    """A table with statistics: {column: (type, distinct, low, high)}."""
    out = []
    for c, (dtype, distinct, low, high) in columns.items():
        stats = [{"CardinalityStat": distinct}, {"DensityStat": distinct / rows}]
        if low is not None:
            kind = "String" if isinstance(low, str) else "Int64"
            stats.append({"RangeStat": {"lower_bound": {kind: low}, "upper_bound": {kind: high}}})
        out.append(ColumnInfo(c, dtype, stats))
    return TableInfo(name, f"{name}.bin", out)


def test_estimates():
    big = known("big", 1000, {"k": (T.LongType(), 1000, 0, 999), "g": (T.LongType(), 10, 0, 9), "s": (T.StringType(), 20, "a", "z")})
    small = known("small", 10, {"j": (T.LongType(), 10, 0, 9), "t": (T.StringType(), 10, None, None)})
    bare = TableInfo("bare", "bare.bin", [ColumnInfo("x", T.LongType())])
    e = Estimator(Catalog([big, small, bare]))
    assert e.rows(scan("big")) == 1000 and e.rows(scan("bare")) == (2**64 - 1) // 4
    assert e.rows(scan("big").filter("g", "EQ", i32(3))) == 100
    assert e.rows(scan("big").filter("g", "NE", i32(3))) == 900
    assert e.rows(scan("big").filter("k", "LT", i32(250))) == 250
    assert e.rows(scan("big").filter("k", "GT", f64(-5.0))) == 950  # within the limits of ranges
    assert e.rows(scan("big").filter("k", "EQ", Col("g"))) == 100
    assert e.rows(scan("big").filter("s", "GTE", text("a"))) == 950
    assert e.rows(scan("big").project("g", "h").filter("h", "EQ", i32(1))) == 100
    join = scan("big").cross(scan("small"))
    assert e.rows(join) == 10_000
    assert e.rows(join.filter("g", "EQ", Col("j"))) == 1000
    assert e.rows(join.filter_multiple([("g", "EQ", Col("j")), ("k", "LT", Col("j"))])) == 250
    assert e.rows(join.filter("k", "LT", Col("j"))) == 2500
    assert e.distinct(scan("big").filter("g", "EQ", i32(3)), "k") == 100
    assert e.distinct(join, "t") == 10 and e.distinct(scan("big"), "zz") is None
    assert e.row_bytes(scan("big")) == 24 + 3 * 24 + 8 + 8 + 64
    assert e.rows(scan("big").sort("k")) == 1000
    assert string_position("a", "c", "b") == 0.5


def test_disk_costs(spark):
    disk = Disk()
    requests = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 4096 * 5, 4097), (3, 0, 0)], "seq int, start_block long, num_blocks long")
    a, b, c = access_costs(requests).orderBy("seq").collect()
    turn = 0.5 * 60 / 7200 * 1e6
    assert (a.cylinders, a.seek_us, a.rotation_us) == (0, 0, turn)
    assert (b.cylinders, b.seek_us, b.rotation_us) == (0, 0, 0)
    assert c.cylinders == 6 and abs(c.seek_us - ((0.8 + 17.2 * (5 / disk.total_cylinders) ** 0.5) + 0.8) * 1000) < 1e-6
    assert abs(c.transfer_us - 4097 * 4096 / 150e6 * 1e6) < 1e-6


def test_streams(spark, tmp_path):
    folder = f"{tmp_path}/events"
    spark.range(0, 50).selectExpr("id as k", "id % 3 as g").write.parquet(folder)
    static = Catalog([of_frame("t", spark.read.parquet(folder)), of_frame("names", spark.createDataFrame([(0, "zero"), (1, "one")], "j long, name string"))])
    plan = scan("t").cross(scan("names")).filter_multiple([("g", "EQ", Col("j")), ("k", "GTE", i32(10))]).project_multiple(["k", "name"])
    query = follow(spark, plan, "t", folder, static).writeStream.format("memory").queryName("followed").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert same_rows(spark.table("followed"), compile_plan(plan, static))
        spark.range(100, 130).selectExpr("id as k", "id % 3 as g").write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert same_rows(spark.table("followed"), compile_plan(plan, static.__class__([of_frame("t", spark.read.parquet(folder)), static.find("names")])))
    finally:
        query.stop()


def test_command_line(spark, tiny, tmp_path, capsys):
    from opalgrid.__main__ import main

    (tmp_path / "q.json").write_text(to_json(scan("region").filter("r_regionkey", "LT", i32(2)).project("r_name")))
    main(["run", "--folder", tiny, "--file", str(tmp_path / "q.json"), "--out", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    main(["explain", "--folder", tiny, "--file", str(tmp_path / "q.json")])
    assert "estimated rows" in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("1|a|\n2|b|\n")
    (tmp_path / "in" / "t.schema").write_text("k|s\nI64|STRING\n")
    main(["ingest", "--folder", str(tmp_path / "in"), "--out", str(tmp_path / "tables")])
    declared = capsys.readouterr().out
    assert Catalog.from_json(declared).find("t").columns[0].stats[0] == "IsPhysicallyOrdered"
    assert spark.read.parquet(str(tmp_path / "tables" / "t.parquet")).count() == 2


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "o_orderdate", "o_orderpriority"]
    assert set(e.oracle_sql()) <= set(e.queries())

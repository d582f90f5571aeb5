"""Queries over the tools around operator trees: sources, sinks, estimates, checks and costs, each with its SQL."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diskcost import Disk, access_costs
from ..operators.profile import column_stats, physically_ordered, profile
from ..sources import scratch
from ..sources.blocks import read_blocks, write_blocks
from ..sources.catalog import SCHEMA_TYPES, Catalog, ColumnInfo, TableInfo
from ..sources.sqlite import write_sqlite
from ..sources.text import END, as_lines, discover, same_rows, write_lines
from . import workload as w
from .compiler import compile_plan
from .normalize import optimize
from .runner import SuiteQuery, dump_suite, load_suite, record_expected, run_suite
from .tree import Col, Plan, f64, i32, scan, text, to_json


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def block_files(spark: SparkSession, folder: str) -> DataFrame:
    """Customers through block files: written, and read by ranges of blocks."""
    frame, place = _table(spark, folder, "customer"), scratch.fresh(spark, "blocks")
    write_blocks(frame.repartition(3), place)
    return read_blocks(spark, place, frame.schema)


def text_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Parts through a pipe-separated file and its schema, found in their folder."""
    frame, place = _table(spark, folder, "part"), scratch.fresh(spark, "text")
    write_lines(frame, f"{place}/part.csv")
    kinds = {v: k for k, v in SCHEMA_TYPES.items()}
    lines = ["|".join(frame.columns), "|".join(kinds[f.dataType] for f in frame.schema.fields)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{place}/part.schema")
    catalog, _ = discover(spark, place)
    return catalog.table("part")


def sqlite_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers through a SQLite file on the driver."""
    catalog = Catalog.from_dir(spark, folder, ["supplier"])
    with tempfile.TemporaryDirectory() as place:
        path = os.path.join(place, "t.db")
        write_sqlite(catalog, path)
        rows = sqlite3.connect(path).execute("SELECT * FROM supplier").fetchall()
    return spark.createDataFrame(rows, catalog.table("supplier").schema)


def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as result lines, with the mark that ends a result."""
    frame = _table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") / 1024).alias("small"), F.lit(None).cast("string").alias("none"))
    place = scratch.fresh(spark, "lines")
    write_lines(frame, place, end=True)
    return spark.read.text(place)


def catalog_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A join of three over a catalog that went through its JSON form."""
    names = ["customer", "nation", "region"]
    declared = Catalog.from_dir(spark, folder, names).to_json()
    catalog = Catalog.from_json(declared, lambda t: spark.read.parquet(f"{folder}/{t.file_id}"))
    return compile_plan(_named("join_sort_q46").plan, catalog)


def _named(name: str) -> w.Query:
    return next(q for q in w.WORKLOAD if q.name == name)


def profiled(spark: SparkSession, folder: str, names: list[str], exact: bool | None = None) -> Catalog:
    """A catalog with statistics of tables; numbers of distinct values as profiles count them, or all exactly."""
    out = []
    for t in Catalog.from_dir(spark, folder, names).tables:
        found = profile(t.load(), with_order=False, with_histogram=False, exact=exact)
        out.append(TableInfo(t.name, t.file_id, [ColumnInfo(c.name, c.dtype, found[c.name].stats()) for c in t.columns], t.load, found[t.columns[0].name].rows))
    return Catalog(out)


def _estimates(plans: dict[str, Plan], names: list[str], what: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        from ..operators.estimate import Estimator

        e = Estimator(profiled(spark, folder, names, exact=True))
        return spark.createDataFrame([(k, int(what(e, p))) for k, p in plans.items()], "plan string, value long")

    return run


_CUSTOMER, _NATION, _PART = scan("customer"), scan("nation"), scan("part")
_JOIN = _CUSTOMER.cross(_NATION)


def string_range(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated share of customers below a segment, from a range of segments that was written by hand."""
    from ..operators.estimate import Estimator

    table = _table(spark, folder, "customer")
    low, high, n = table.agg(F.min("c_mktsegment"), F.max("c_mktsegment"), F.count(F.lit(1))).first()
    stats = [{"CardinalityStat": n}, {"DensityStat": 1.0}, {"RangeStat": {"lower_bound": {"String": low}, "upper_bound": {"String": high}}}]
    e = Estimator(Catalog([TableInfo("customer", "c", [ColumnInfo("c_mktsegment", table.schema["c_mktsegment"].dataType, stats)])]))
    return spark.createDataFrame([(s, e.rows(_CUSTOMER.filter("c_mktsegment", "LT", text(s)))) for s in ("FURNITURE", "HOUSEHOLD")], "segment string, value long")


def validator(spark: SparkSession, folder: str) -> DataFrame:
    """Whether multisets of rows are told apart: the same in another order, one row twice, one row changed."""
    frame = _table(spark, folder, "customer")
    twice = frame.unionByName(frame.where("c_custkey = 1"))
    changed = frame.withColumn("c_name", F.when(F.col("c_custkey") == 1, "x").otherwise(F.col("c_name")))
    rows = [("same", same_rows(frame.repartition(7), frame)), ("twice", same_rows(twice, frame)), ("changed", same_rows(changed, frame))]
    return spark.createDataFrame(rows, "kind string, equal boolean")


def suite(spark: SparkSession, folder: str) -> DataFrame:
    """A suite of queries, recorded and run again from its JSON; the rows that each expected file has."""
    names = ["join_q36", "join_sort_q43", "sort_q18"]
    catalog, place = Catalog.from_dir(spark, folder), scratch.fresh(spark, "suite")
    queries_ = [SuiteQuery(n, _named(n).plan, f"{place}/{n}", sort_before_check=not _named(n).ordered) for n in names]
    record_expected(queries_, catalog)
    passed = run_suite(spark, load_suite(dump_suite(queries_)), catalog)
    return spark.createDataFrame([(n, spark.read.text(f"{place}/{n}").count()) for n in names if n in passed], "query string, n long")


def disk_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests made of events, at the cost of a rotating disk."""
    requests = _table(spark, folder, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 977 % 2_000_000).alias("start_block"), (F.col("event_id") % 5000).alias("num_blocks"))
    out = access_costs(requests)
    return out.select("seq", "cylinders", *[F.round(c, 3).alias(c) for c in ("seek_us", "rotation_us", "transfer_us", "total_us")])


def normal_form(spark: SparkSession, folder: str) -> DataFrame:
    """A join of six in its normal form: filters and columns pushed to the scans."""
    return compile_plan(optimize(_named("bench_4").plan, w.TABLE_COLUMNS), Catalog.from_dir(spark, folder))


def join_order(spark: SparkSession, folder: str) -> DataFrame:
    """The join of nine in the order that statistics call for."""
    catalog = profiled(spark, folder, ["customer", "orders", "lineitem", "part", "supplier", "nation", "region"])
    return compile_plan(_named("bench_10").plan, catalog, by_statistics=True)


def command_line(spark: SparkSession, folder: str) -> DataFrame:
    """A tree run by the command, which writes its lines."""
    from ..__main__ import main

    place = scratch.fresh(spark, "command")
    spark.createDataFrame([(to_json(_named("join_sort_q43").plan),)], "value string").coalesce(1).write.text(f"{place}/plan")
    main(["run", "--folder", folder, "--file", f"{place}/plan", "--out", f"{place}/lines"])
    return spark.read.text(f"{place}/lines")


def order_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Physical order of a table of several files, the last of which are the largest."""
    place, frame = scratch.fresh(spark, "files"), _table(spark, folder, "orders")
    last = frame.agg(F.max("o_orderkey")).first()[0]
    part = F.floor(F.log2(F.col("o_orderkey") * 62 / max(1, last) + 1)).cast("int")
    frame.repartitionById(6, part).sortWithinPartitions("o_orderkey").write.parquet(place)
    return physically_ordered(spark.read.parquet(place), ["o_orderkey", "o_custkey"])


def sketch_first(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of lineitem: exact numbers of distinct values where there are 10,000 at most."""
    found = column_stats(_table(spark, folder, "lineitem"), exact=None)
    return found.select("column_name", "row_count", (F.col("cardinality") <= 10_000).alias("exact"), F.when(F.col("cardinality") <= 10_000, F.col("cardinality")).alias("cardinality"))


_E2 = {"customer.c_custkey": _CUSTOMER, "customer.c_custkey of nation 3": _CUSTOMER.filter("c_nationkey", "EQ", i32(3)), "renamed": _CUSTOMER.project("c_custkey")}
_E3 = {"eq": _PART.filter("p_size", "EQ", i32(7)), "ne": _PART.filter("p_size", "NE", i32(7)), "gt": _PART.filter("p_retailprice", "GT", f64(950.0)), "lte": _PART.filter("p_retailprice", "LTE", f64(950.0)), "limit": _PART.filter("p_retailprice", "GT", f64(-1.0)), "column": _PART.filter("p_partkey", "LT", Col("p_size"))}
_E5 = {"cross": _JOIN, "equi": _JOIN.filter("c_nationkey", "EQ", Col("n_nationkey")), "theta": _JOIN.filter("c_custkey", "LT", Col("n_nationkey")), "both": _JOIN.filter_multiple([("c_nationkey", "EQ", Col("n_nationkey")), ("c_custkey", "GT", Col("n_regionkey"))])}
_E6 = {"nation": _NATION, "customer": _CUSTOMER, "join": _JOIN.project_multiple(["c_name", "n_name", "c_acctbal"])}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "source_block_files": block_files,
        "source_text_tables": text_tables,
        "sink_sqlite": sqlite_tables,
        "sink_result_lines": result_lines,
        "catalog_round_trip": catalog_round_trip,
        "estimate_rows": _estimates({"customer": _CUSTOMER, "nation": _NATION, "sorted": _PART.sort("p_size")}, ["customer", "nation", "part"], lambda e, p: e.rows(p)),
        "estimate_distinct": _estimates(_E2, ["customer"], lambda e, p: e.distinct(p, "c_custkey")),
        "estimate_selectivity": _estimates(_E3, ["part"], lambda e, p: e.rows(p)),
        "estimate_string_range": string_range,
        "estimate_join": _estimates(_E5, ["customer", "nation"], lambda e, p: e.rows(p)),
        "estimate_row_bytes": _estimates(_E6, ["customer", "nation"], lambda e, p: e.row_bytes(p)),
        "validator": validator,
        "runner_suite": suite,
        "disk_costs": disk_costs,
        "normal_form_bench_4": normal_form,
        "join_order_bench_10": join_order,
        "command_line": command_line,
        "stats_order_multi_file": order_of_files,
        "stats_sketch_first_lineitem": sketch_first,
    }


def _position(value: str) -> str:
    """The share of a range that lies below a string, by eight bytes of each."""
    wide = lambda a, b: f"CAST(CAST(CAST('0x' || hex(left({a}, 8)) AS UBIGINT) AS HUGEINT) - CAST(CAST('0x' || hex(left({b}, 8)) AS UBIGINT) AS HUGEINT) AS DOUBLE)"
    return f"greatest(0.05, least(0.95, {wide(value, 'lo')} / {wide('hi', 'lo')}))"


def oracle_sql() -> dict[str, str]:
    d = Disk()
    per = d.blocks_per_track * d.heads_per_cylinder
    lines = "SELECT n_name || '|' || r_name || '|' AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"
    counts = {q: f"SELECT '{q}' AS query, count(*) AS n FROM ({_named(q).sql()})" for q in ("join_q36", "join_sort_q43", "sort_q18")}
    rounded = lambda x: f"CAST(greatest(1, floor({x} + 0.5)) AS BIGINT)"
    part = "(SELECT count(*) AS n, count(DISTINCT p_size) AS d, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)"
    at = "greatest(0, least(1, (950.0::DOUBLE - lo) / (hi - lo)))"
    below = f"greatest(0.05, least(0.95, {at}))"
    above = f"greatest(0.05, least(0.95, 1 - {at}))"
    both = "(SELECT (SELECT count(*) FROM customer) AS l, (SELECT count(*) FROM nation) AS r, (SELECT count(DISTINCT c_nationkey) FROM customer) AS d, (SELECT count(DISTINCT n_nationkey) FROM nation) AS e)"
    return {
        "source_block_files": "SELECT * FROM customer",
        "source_text_tables": "SELECT * FROM part",
        "sink_sqlite": "SELECT * FROM supplier",
        "sink_result_lines": f"SELECT o_orderkey || '|' || o_orderstatus || '|' || CAST(o_totalprice AS VARCHAR) || '|' || CAST(o_totalprice / 1024 AS VARCHAR) || '||' AS value FROM orders UNION ALL SELECT '{END}'",
        "catalog_round_trip": _named("join_sort_q46").sql(),
        "estimate_rows": "SELECT 'customer' AS plan, count(*) AS value FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'sorted', count(*) FROM part",
        "estimate_distinct": f"WITH c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS d, count(DISTINCT c_nationkey) AS k FROM customer) SELECT 'customer.c_custkey' AS plan, d AS value FROM c UNION ALL SELECT 'renamed', d FROM c UNION ALL SELECT 'customer.c_custkey of nation 3', CAST(ceil(d * {rounded('n * (1.0::DOUBLE / k)')} / n) AS BIGINT) FROM c",
        "estimate_selectivity": " UNION ALL ".join(f"SELECT '{k}' AS plan, {rounded(v)} AS value FROM {part}" for k, v in {"eq": "n * (1.0::DOUBLE / d)", "ne": "n * (1 - 1.0::DOUBLE / d)", "gt": f"n * {above}", "lte": f"n * {below}", "limit": "n * 0.95::DOUBLE", "column": "n * 0.5"}.items()),
        "estimate_string_range": " UNION ALL ".join(f"SELECT '{s}' AS segment, {rounded('n * ' + _position(chr(39) + s + chr(39)))} AS value FROM (SELECT min(c_mktsegment) AS lo, max(c_mktsegment) AS hi, count(*) AS n FROM customer)" for s in ("FURNITURE", "HOUSEHOLD")),
        "estimate_join": " UNION ALL ".join(f"SELECT '{k}' AS plan, {v} AS value FROM {both}" for k, v in {"cross": "l * r", "equi": "l * r // greatest(d, e)", "theta": rounded("l * r * 0.25"), "both": rounded("(l * r // greatest(d, e)) * 0.25")}.items()),
        "estimate_row_bytes": "SELECT * FROM (VALUES ('nation', 24 + 3 * 24 + 4 + 64 + 4), ('customer', 24 + 5 * 24 + 8 + 64 + 4 + 8 + 64), ('join', 24 + 3 * 24 + 64 + 64 + 8)) t(plan, value)".replace("SELECT *", "SELECT plan, CAST(value AS BIGINT) AS value"),
        "validator": "SELECT * FROM (VALUES ('same', true), ('twice', false), ('changed', false)) t(kind, equal)",
        "runner_suite": " UNION ALL ".join(counts.values()),
        "disk_costs": (
            f"WITH r AS (SELECT event_id AS seq, user_id * 977 % 2000000 AS start_block, event_id % 5000 AS num_blocks FROM events WHERE event_id % 5000 > 0), "
            f"e AS (SELECT *, start_block + num_blocks - 1 AS last, coalesce(lag(start_block + num_blocks - 1) OVER (ORDER BY seq), 0) AS before FROM r), "
            f"c AS (SELECT *, abs(start_block // {per} - before // {per}) AS far, last // {per} - start_block // {per} AS crossed FROM e), "
            f"t AS (SELECT seq, far + crossed AS cylinders, (CASE WHEN far = 0 THEN 0.0::DOUBLE WHEN far = 1 THEN {d.track_to_track_ms}::DOUBLE ELSE {d.track_to_track_ms}::DOUBLE + ({d.full_stroke_ms}::DOUBLE - {d.track_to_track_ms}::DOUBLE) * sqrt(least(1.0::DOUBLE, far / {d.total_cylinders}::DOUBLE)) END + crossed * {d.track_to_track_ms}::DOUBLE) * 1000 AS seek_us, "
            f"CASE WHEN start_block = before + 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * 60000 / {d.rpm} * 1000 END AS rotation_us, num_blocks * {d.block_size} / 1e6::DOUBLE / {d.transfer_mb_s}::DOUBLE * 1000 * 1000 AS transfer_us FROM c) "
            f"SELECT seq, cylinders, round(seek_us, 3) AS seek_us, round(rotation_us, 3) AS rotation_us, round(transfer_us, 3) AS transfer_us, round(seek_us + rotation_us + transfer_us, 3) AS total_us FROM t"
        ),
        "normal_form_bench_4": _named("bench_4").sql(),
        "join_order_bench_10": _named("bench_10").sql(),
        "command_line": lines,
        "stats_order_multi_file": "SELECT 'o_orderkey' AS column_name, true AS ordered UNION ALL SELECT 'o_custkey', NOT coalesce(bool_or(before > o_custkey), false) FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders)",
        "stats_sketch_first_lineitem": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) <= 10000 AS exact, CASE WHEN count(DISTINCT {c}) <= 10000 THEN count(DISTINCT {c}) END AS cardinality FROM lineitem" for c in w.TABLE_COLUMNS["lineitem"]),
    }

"""The workload: sixty select-project-join-sort queries over TPC-H-like tables, and one query per operator feature.

Each is declared once, as relations, predicates, sort keys and output, and gives a tree; the SQL of its
oracle is printed from the tree. Literals fit the test tables; ``partsupp`` is derived from ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..sources.catalog import PARTSUPP_SQL, Catalog
from .compiler import compile_plan
from .sqltext import to_sql
from .tree import Col, Plan, Predicate, f32, f64, from_json, i32, i64, scan, tables_of, text, to_json

#: The columns of the test tables, in order.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "partsupp": "ps_partkey ps_suppkey ps_availqty ps_supplycost",
}
TABLE_COLUMNS = {k: v.split() for k, v in COLUMNS.items()}

_SYMBOLS = {"=": "EQ", "<>": "NE", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE"}


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    ordered: bool = False

    def sql(self) -> str:
        return to_sql(self.plan, TABLE_COLUMNS, {"partsupp": PARTSUPP_SQL})


def predicate(source: str | Predicate) -> Predicate:
    """``column op value``: a number is I32, with a point F64, quoted String, anything else a column."""
    if isinstance(source, Predicate):
        return source
    column, op, value = source.split(" ", 2)
    if value[0] == "'":
        operand = text(value[1:-1])
    elif value.lstrip("-")[0].isdigit():
        operand = f64(float(value)) if "." in value else i32(int(value))
    else:
        operand = Col(value)
    return Predicate(column, _SYMBOLS[op], operand)


def spj(tables: str, out: str, where: tuple = (), order: str = "", below: dict[str, tuple] | None = None) -> Plan:
    """Crossed scans, one filter, a sort and a projection; ``below`` has filters of single tables under the cross.

    Sort keys are names, with ``-`` in front for descending.
    """
    plan: Plan | None = None
    for t in tables.split():
        one: Plan = scan(t)
        if below and t in below:
            one = one.filter_multiple([predicate(p) for p in below[t]])
        plan = one if plan is None else plan.cross(one)
    assert plan is not None
    if where:
        plan = plan.filter_multiple([predicate(p) for p in where])
    if order:
        plan = plan.sort_multiple([(k.lstrip("-"), not k.startswith("-")) for k in order.split()])
    return plan.project_multiple(out.split())


def renamed(table: str, prefix: str, columns: str) -> Plan:
    return scan(table).project_multiple([(c, f"{prefix}.{c}") for c in columns.split()])


def _self_join() -> Plan:
    first, second = renamed("lineitem", "l1", "l_orderkey l_suppkey l_linenumber l_discount l_tax"), renamed("lineitem", "l2", "l_orderkey l_suppkey l_linenumber")
    joined = scan("supplier").cross(first).cross(second).cross(scan("orders")).cross(scan("nation"))
    where = ("s_suppkey = l1.l_suppkey", "o_orderkey = l1.l_orderkey", "o_orderstatus = 'F'", "l1.l_discount > l1.l_tax", "l2.l_orderkey = l1.l_orderkey", "l2.l_suppkey <> l1.l_suppkey", "s_nationkey = n_nationkey", "n_name = 'NATION_20'")
    order = ["s_name", "l1.l_orderkey", "l1.l_linenumber", "l2.l_orderkey", "l2.l_linenumber"]
    return joined.filter_multiple([predicate(p) for p in where]).sort_multiple(order).project_multiple(["s_name", "l1.l_orderkey", "l1.l_suppkey"])


def _nine_way() -> Plan:
    plan: Plan = scan("customer").cross(scan("orders")).cross(scan("lineitem")).cross(scan("part")).cross(scan("supplier"))
    plan = plan.cross(renamed("nation", "cn", "n_nationkey n_name n_regionkey")).cross(renamed("nation", "sn", "n_nationkey n_name n_regionkey"))
    plan = plan.cross(renamed("region", "cr", "r_regionkey r_name")).cross(renamed("region", "sr", "r_regionkey r_name"))
    where = ("c_custkey = o_custkey", "o_orderkey = l_orderkey", "l_partkey = p_partkey", "l_suppkey = s_suppkey", "c_nationkey = cn.n_nationkey", "s_nationkey = sn.n_nationkey", "cn.n_regionkey = cr.r_regionkey", "sn.n_regionkey = sr.r_regionkey", "c_mktsegment = 'BUILDING'", "p_size >= 1", "p_size <= 5", "cr.r_name = 'ASIA'", "sr.r_name = 'EUROPE'")
    out = "c_custkey c_name o_orderkey o_orderdate l_linenumber l_partkey l_suppkey p_name s_name cn.n_name sn.n_name"
    return plan.filter_multiple([predicate(p) for p in where]).sort_multiple(["c_custkey", "o_orderdate", "o_orderkey", "l_linenumber"]).project_multiple(out.split())


def _workload() -> list[Query]:
    out: list[Query] = []

    def q(name: str, tables: str, columns: str, *where, order: str = "", below: dict[str, tuple] | None = None) -> None:
        out.append(Query(name, spj(tables, columns, where, order, below), bool(order)))

    q("scan_project_q1", "nation", "n_nationkey n_name n_regionkey")
    q("scan_project_q2", "region", "r_regionkey r_name")
    q("scan_project_q3", "part", "p_partkey p_name p_brand p_type")
    q("scan_project_q4", "supplier", "s_suppkey s_name s_acctbal")
    q("scan_project_q5", "customer", "c_custkey c_name c_mktsegment")
    q("filter_q6", "nation", "n_name", "n_regionkey = 1")
    q("filter_q7", "region", "r_name", "r_name <> 'AFRICA'")
    q("filter_q8", "part", "p_name p_size", "p_size > 25")
    q("filter_q9", "part", "p_partkey p_retailprice", "p_retailprice >= 950.0")
    q("filter_q10", "supplier", "s_name s_acctbal", "s_acctbal < 0.0")
    q("filter_q11", "customer", "c_name c_mktsegment", "c_mktsegment = 'AUTOMOBILE'")
    q("filter_q12", "orders", "o_orderkey o_totalprice", "o_orderstatus = 'O'")
    q("filter_q13", "lineitem", "l_orderkey l_linenumber", "l_quantity <= 10")
    q("filter_q14", "partsupp", "ps_partkey ps_suppkey", "ps_availqty > 50")
    q("filter_q15", "lineitem", "l_orderkey l_discount", "l_discount >= 0.05", "l_discount <= 0.07")
    q("sort_q16", "nation", "n_name", order="n_name n_nationkey")
    q("sort_q17", "region", "r_name", order="-r_name r_regionkey")
    q("sort_q18", "part", "p_brand p_size", order="p_brand -p_size p_partkey")
    q("sort_q19", "supplier", "s_acctbal s_name", order="-s_acctbal s_suppkey")
    q("sort_q20", "customer", "c_mktsegment c_acctbal", order="c_mktsegment -c_acctbal c_custkey")
    q("filter_sort_q21", "nation", "n_name", "n_regionkey = 3", order="-n_name n_nationkey")
    q("filter_sort_q22", "part", "p_name", "p_size < 10", order="p_name p_partkey")
    q("filter_sort_q23", "supplier", "s_name s_acctbal", "s_acctbal > 5000.0", order="-s_acctbal s_suppkey")
    q("filter_sort_q24", "customer", "c_name", "c_mktsegment = 'HOUSEHOLD'", order="c_name c_custkey")
    q("filter_sort_q25", "orders", "o_orderkey o_totalprice", "o_orderstatus = 'F'", order="-o_totalprice o_orderkey")
    q("filter_sort_q26", "lineitem", "l_orderkey l_quantity", "l_shipdate > '1998-01-01'", order="-l_quantity l_orderkey l_linenumber")
    q("filter_sort_q27", "partsupp", "ps_suppkey", "ps_availqty < 10", order="ps_suppkey ps_partkey")
    q("filter_sort_q28", "lineitem", "l_extendedprice", "l_returnflag = 'R'", "l_linestatus = 'F'", order="-l_extendedprice l_orderkey l_linenumber")
    q("filter_sort_q29", "customer", "c_name", "c_acctbal < 0.0", order="c_name c_custkey")
    q("filter_sort_q30", "part", "p_brand", "p_type = 'PROMO'", order="p_brand p_partkey")
    q("cross_q31", "nation region", "n_name r_name")
    q("cross_q32", "supplier region", "s_name r_name")
    q("cross_q33", "customer nation", "c_name n_name", below={"customer": ("c_custkey = 1",)})
    q("cross_q34", "part partsupp", "p_name ps_availqty", below={"part": ("p_partkey = 10",), "partsupp": ("ps_suppkey = 10",)})
    q("cross_q35", "orders lineitem", "o_orderkey l_linenumber", below={"orders": ("o_orderkey = 5",), "lineitem": ("l_orderkey = 5",)})
    q("join_q36", "nation region", "n_name r_name", "n_regionkey = r_regionkey")
    q("join_q37", "customer nation", "c_name n_name", "c_nationkey = n_nationkey")
    q("join_q38", "supplier nation", "s_name n_name", "s_nationkey = n_nationkey")
    q("join_q39", "part partsupp", "p_name ps_availqty", "p_partkey = ps_partkey")
    q("join_q40", "supplier partsupp", "s_name ps_availqty", "s_suppkey = ps_suppkey")
    q("join_sort_q41", "customer orders", "c_name o_totalprice", "c_custkey = o_custkey", "c_mktsegment = 'MACHINERY'", order="-o_totalprice c_custkey o_orderkey")
    q("join_sort_q42", "orders lineitem", "o_orderdate l_quantity", "o_orderkey = l_orderkey", "o_orderstatus = 'P'", order="o_orderdate l_orderkey l_linenumber")
    q("join_sort_q43", "nation region", "n_name r_name", "n_regionkey = r_regionkey", "r_name = 'EUROPE'", order="n_name n_nationkey")
    q("join_sort_q44", "supplier nation", "s_name n_name", "s_nationkey = n_nationkey", "s_acctbal > 1000.0", order="-s_acctbal s_suppkey")
    q("join_sort_q45", "part partsupp", "p_name ps_supplycost", "p_partkey = ps_partkey", "p_size = 50", order="-ps_supplycost p_partkey ps_suppkey")
    q("join_sort_q46", "customer nation region", "c_name n_name", "c_nationkey = n_nationkey", "n_regionkey = r_regionkey", "r_name = 'ASIA'", order="c_name c_custkey")
    q("join_sort_q47", "part supplier partsupp", "p_brand s_name", "p_partkey = ps_partkey", "s_suppkey = ps_suppkey", "p_size < 5", order="p_brand s_name p_partkey s_suppkey")
    q("join_sort_q48", "orders customer", "o_orderkey c_mktsegment", "o_custkey = c_custkey", "o_totalprice > 50000.0", order="-o_totalprice o_orderkey")
    q("join_sort_q49", "lineitem part", "l_linenumber p_name", "l_partkey = p_partkey", "l_quantity > 45", order="p_name l_orderkey l_linenumber")
    q("join_sort_q50", "supplier part partsupp", "s_name p_name", "s_suppkey = ps_suppkey", "p_partkey = ps_partkey", "ps_availqty = 1", order="s_name p_name s_suppkey p_partkey")
    q("join_sort_q50_empty", "supplier part partsupp", "s_name p_name", "s_suppkey = ps_suppkey", "p_partkey = ps_partkey", "ps_availqty = 0", order="s_name p_name s_suppkey p_partkey")

    by_line = "l_orderkey l_linenumber"
    q("bench_1", "lineitem", "l_returnflag l_linestatus l_quantity l_extendedprice l_discount l_tax", "l_shipdate <= '1998-11-30'", order=f"l_returnflag l_linestatus {by_line}")
    q("bench_2", "part supplier partsupp nation region", "s_acctbal s_name n_name p_partkey ps_supplycost", "p_partkey = ps_partkey", "s_suppkey = ps_suppkey", "p_size = 15", "s_nationkey = n_nationkey", "n_regionkey = r_regionkey", "r_name = 'EUROPE'", order="-s_acctbal n_name s_name p_partkey ps_suppkey")
    q("bench_3", "customer orders lineitem", "l_orderkey o_orderdate o_orderpriority", "c_mktsegment = 'BUILDING'", "c_custkey = o_custkey", "l_orderkey = o_orderkey", "o_orderdate < '1995-03-15'", "l_shipdate > '1995-03-15'", order=f"o_orderdate {by_line}")
    q("bench_4", "customer orders lineitem supplier nation region", "n_name l_extendedprice l_discount", "c_custkey = o_custkey", "l_orderkey = o_orderkey", "l_suppkey = s_suppkey", "c_nationkey = s_nationkey", "s_nationkey = n_nationkey", "n_regionkey = r_regionkey", "r_name = 'ASIA'", "o_orderdate >= '1996-01-01'", "o_orderdate < '1997-01-01'", order=f"-l_extendedprice -l_discount {by_line}")
    q("bench_5", "lineitem", "l_extendedprice l_discount", "l_shipdate >= '1996-01-01'", "l_shipdate < '1997-01-01'", "l_discount > 0.05", "l_discount < 0.07", "l_quantity < 24", order=by_line)
    q("bench_6", "customer orders lineitem nation", "c_custkey c_name l_extendedprice l_discount c_acctbal n_name", "c_custkey = o_custkey", "l_orderkey = o_orderkey", "o_orderdate >= '1995-10-01'", "o_orderdate < '1996-10-01'", "l_returnflag = 'R'", "c_nationkey = n_nationkey", order=f"-l_extendedprice -l_discount {by_line}")
    q("bench_7", "partsupp supplier nation", "ps_partkey ps_supplycost ps_availqty", "ps_suppkey = s_suppkey", "s_nationkey = n_nationkey", "n_name = 'NATION_7'", order="-ps_availqty ps_partkey ps_suppkey")
    q("bench_8", "supplier nation partsupp part lineitem", "s_name s_suppkey ps_partkey ps_availqty l_quantity", "s_nationkey = n_nationkey", "n_name = 'NATION_3'", "s_suppkey = ps_suppkey", "ps_partkey = p_partkey", "l_partkey = ps_partkey", "l_suppkey = ps_suppkey", order=f"s_name {by_line}")
    out.append(Query("bench_9", _self_join(), True))
    out.append(Query("bench_10", _nine_way(), True))
    return out


def _features() -> list[Query]:
    """Every comparison with every kind of operand, and the corners of each operator."""
    out: list[Query] = []
    operands = {
        "i32": ("part", "p_size", i32(25), "p_partkey p_size"),
        "i64": ("orders", "o_custkey", i64(700), "o_orderkey o_custkey"),
        "f32": ("lineitem", "l_quantity", f32(25.0), "l_orderkey l_quantity"),
        "f64": ("lineitem", "l_discount", f64(0.05), "l_orderkey l_discount"),
        "string": ("customer", "c_mktsegment", text("FURNITURE"), "c_custkey c_mktsegment"),
        "column": ("lineitem", "l_discount", Col("l_tax"), "l_orderkey l_discount l_tax"),
    }
    for kind, (table, column, value, shown) in operands.items():
        for op in _SYMBOLS.values():
            out.append(Query(f"pred_{op.lower()}_{kind}", scan(table).filter(column, op, value).project_multiple(shown.split())))
    nation, region = scan("nation"), scan("region")
    extra = {
        "pred_long_vs_fraction": scan("orders").filter("o_orderkey", "LTE", f64(1000.5)).project("o_orderkey"),
        "pred_long_column_vs_double": scan("lineitem").filter("l_partkey", "EQ", Col("l_quantity")).project_multiple(["l_orderkey", "l_partkey", "l_quantity"]),
        "project_rename": nation.project_multiple([("n_name", "name"), ("n_nationkey", "key")]),
        "project_duplicate_source": nation.project_multiple([("n_name", "a"), ("n_name", "b"), ("n_nationkey", "a.b")]),
        "project_chain": nation.project_multiple([("n_name", "x"), ("n_regionkey", "y")]).project_multiple([("y", "x"), ("x", "y")]),
        "filter_empty_predicates": region.filter_multiple([]),
        "filter_above_filter": scan("part").filter("p_size", "GT", i32(10)).filter("p_size", "LTE", i32(12)).project("p_partkey"),
        "filter_above_sort": scan("part").sort("p_size", False).filter("p_size", "LT", i32(7)).project_multiple(["p_partkey", "p_size"]),
        "filter_above_project": scan("part").project_multiple([("p_size", "s"), ("p_partkey", "k")]).filter("s", "EQ", i32(7)),
        "filter_above_nested_cross": nation.cross(region.cross(scan("supplier"))).filter_multiple([predicate("n_regionkey = r_regionkey"), predicate("s_nationkey = n_nationkey")]).project_multiple(["s_name", "n_name", "r_name"]),
        "filter_between_crosses": nation.cross(region).filter("n_regionkey", "EQ", Col("r_regionkey")).cross(scan("supplier")).filter("s_nationkey", "EQ", Col("n_nationkey")).project_multiple(["s_name", "r_name"]),
        "theta_join": nation.cross(region).filter("n_nationkey", "LT", Col("r_regionkey")).project_multiple(["n_name", "r_name"]),
        "multi_key_join": spj("lineitem partsupp", "l_orderkey l_linenumber ps_availqty", ("l_partkey = ps_partkey", "l_suppkey = ps_suppkey")),
        "equi_plus_residual": spj("customer supplier", "c_custkey s_suppkey", ("c_nationkey = s_nationkey", "c_acctbal < s_acctbal")),
        "self_join_renamed": renamed("nation", "a", "n_nationkey n_regionkey").cross(renamed("nation", "b", "n_nationkey n_regionkey")).filter("a.n_regionkey", "EQ", Col("b.n_regionkey")).project_multiple([("a.n_nationkey", "a.key"), ("b.n_nationkey", "b.key")]),
        "join_under_project": nation.cross(region).project_multiple([("n_regionkey", "x"), ("r_regionkey", "y"), ("n_name", "n")]).filter("x", "EQ", Col("y")).project_multiple(["n", "y"]),
        "join_int_with_long": spj("customer nation", "c_custkey n_name", ("c_custkey = n_nationkey",)),
        "join_int_with_double": spj("nation lineitem", "n_name l_orderkey l_quantity", ("n_nationkey = l_quantity", "n_regionkey = 2")),
        "sort_desc_nonprojected_key": scan("supplier").sort("s_acctbal", False).project("s_name"),
        "sort_duplicate_keys": scan("part").sort_multiple([("p_size", True), ("p_size", False), ("p_partkey", False)]).project_multiple(["p_size", "p_partkey"]),
        "sort_empty_keys": region.sort_multiple([]),
        "cross_three": region.cross(nation).cross(region.project("r_name", "other")).project_multiple(["r_name", "n_name", "other"]),
    }
    return out + [Query(k, v) for k, v in extra.items()]


WORKLOAD = _workload()
FEATURES = _features()

#: Profiled columns per table, and tables.
PROFILED = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")
HISTOGRAMS = {"part": "p_retailprice", "orders": "o_totalprice", "lineitem": "l_extendedprice"}


def _numbers(table: str) -> list[str]:
    words = {"r_name", "n_name", "s_name", "c_name", "c_mktsegment", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderdate", "o_orderpriority", "l_returnflag", "l_linestatus", "l_shipdate"}
    return [c for c in TABLE_COLUMNS[table] if c not in words]


def stats_sql(table: str) -> str:
    """Exact statistics of each column."""
    parts = []
    for c in TABLE_COLUMNS[table]:
        low, high = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if c in _numbers(table) else ("CAST(NULL AS DOUBLE)",) * 2
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS row_count, {low} AS lower_bound, {high} AS upper_bound, count(DISTINCT {c}) AS cardinality, CAST(least(1.0, CAST(count(DISTINCT {c}) AS DOUBLE) / count(*)) AS FLOAT) AS density FROM {table}")
    return " UNION ALL ".join(parts)


def order_sql(table: str) -> str:
    """Whether each column is in file order: rows of a file keep their order in a window without one."""
    parts = [f"SELECT '{c}' AS column_name, NOT coalesce(bool_or(before > {c}), false) AS ordered FROM (SELECT {c}, lag({c}) OVER () AS before FROM {table})" for c in TABLE_COLUMNS[table]]
    return " UNION ALL ".join(parts)


def histogram_sql(table: str, column: str) -> str:
    return (
        f"WITH q AS (SELECT list_distinct(quantile_disc(CAST({column} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM {table}) "
        f"SELECT CAST(len(list_filter(b, lambda x: CAST({column} AS DOUBLE) > x)) AS INT) AS bucket, min(CAST({column} AS DOUBLE)) AS lower_bound, "
        f"max(CAST({column} AS DOUBLE)) AS upper_bound, count(*) AS frequency FROM {table}, q WHERE {column} IS NOT NULL GROUP BY 1"
    )


STRING_HISTOGRAM_SQL = (
    "SELECT bucket, min(v) AS lower_bound, max(v) AS upper_bound, CAST(sum(n) AS BIGINT) AS frequency FROM ("
    "SELECT v, n, CAST(least(floor((sum(n) OVER (ORDER BY v) - n) * 10 / sum(n) OVER ()), 9) AS INT) AS bucket "
    "FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)) GROUP BY bucket"
)


def run_query(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    # only the tables that the tree scans are opened
    return lambda spark, folder: compile_plan(query.plan, Catalog.from_dir(spark, folder, tables_of(query.plan)), by_statistics=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {q.name: run_query(q) for q in WORKLOAD + FEATURES}
    out["json_round_trip"] = run_query(Query("json_round_trip", from_json(to_json(next(q for q in WORKLOAD if q.name == "bench_3").plan))))
    for t in PROFILED:
        out[f"stats_{t}"] = lambda spark, folder, t=t: profile.column_stats(spark.read.parquet(f"{folder}/{t}.parquet"))
        out[f"stats_order_{t}"] = lambda spark, folder, t=t: profile.physically_ordered(spark.read.parquet(f"{folder}/{t}.parquet"))
    for t, c in HISTOGRAMS.items():
        out[f"stats_histogram_{t}"] = lambda spark, folder, t=t, c=c: profile.histogram(spark.read.parquet(f"{folder}/{t}.parquet"), c)
    out["stats_string_histogram_customer"] = lambda spark, folder: profile.string_histogram(spark.read.parquet(f"{folder}/customer.parquet"), "c_mktsegment").withColumn("frequency", F.col("frequency").cast("long"))
    return out


def oracle_sql() -> dict[str, str]:
    out = {q.name: q.sql() for q in WORKLOAD + FEATURES}
    out["json_round_trip"] = out["bench_3"]
    out |= {f"stats_{t}": stats_sql(t) for t in PROFILED}
    out |= {f"stats_order_{t}": order_sql(t) for t in PROFILED}
    out |= {f"stats_histogram_{t}": histogram_sql(t, c) for t, c in HISTOGRAMS.items()}
    out["stats_string_histogram_customer"] = STRING_HISTOGRAM_SQL
    return out

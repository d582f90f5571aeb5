"""Running a suite of queries against expected outputs."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from ..sources.text import END, ResultMismatch, as_lines, read_lines, stream_lines, validate_bags, validate_lines, write_lines
from .compiler import compile_plan
from .tree import Plan, from_json, scan, to_dict


@dataclass
class SuiteQuery:
    """A query of a suite; ``memory_limit_mb`` bounds what a task takes at once, by the settings of ``within_memory``."""

    name: str
    plan: Plan
    expected: str
    disabled: bool = False
    sort_before_check: bool = False
    memory_limit_mb: int = 64

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a query has a blank name")
        if self.memory_limit_mb < 64:
            raise ValueError(f"query {self.name}: the memory limit is at least 64 MB")


def load_suite(source: str) -> list[SuiteQuery]:
    out = []
    for q in json.loads(source)["query_configs"]:
        out.append(SuiteQuery(q["execution_name"], from_json(q["query"]), q["expected_output_file"], q.get("disabled", False), q.get("sort_before_check", False), q["memory_limit_mb"]))
    if len({q.name for q in out}) != len(out):
        raise ValueError("a query name occurs twice")
    return out


def dump_suite(suite: list[SuiteQuery]) -> str:
    return json.dumps({"query_configs": [{"execution_name": q.name, "disabled": q.disabled, "sort_before_check": q.sort_before_check, "query": {"root": to_dict(q.plan)}, "expected_output_file": q.expected, "memory_limit_mb": q.memory_limit_mb} for q in suite]}, indent=2)


def starter_suite(catalog: Catalog, folder: str) -> list[SuiteQuery]:
    """Full scans of the first two tables, disabled: a file to write queries into."""
    return [SuiteQuery(f"scan_{t.name}", scan(t.name), f"{folder}/scan_{t.name}", disabled=True, sort_before_check=True) for t in catalog.tables[:2]]


def record_expected(suite: list[SuiteQuery], catalog: Catalog) -> None:
    """Write the present results of a suite as its expected outputs."""
    for q in suite:
        write_lines(compile_plan(q.plan, catalog), q.expected)


#: Settings by the share of the limit that each may take.
SHARES = {"spark.sql.autoBroadcastJoinThreshold": 8, "spark.sql.adaptive.autoBroadcastJoinThreshold": 8, "spark.sql.files.maxPartitionBytes": 2, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 4}


@contextmanager
def within_memory(spark: SparkSession, megabytes: int) -> Iterator[None]:
    """Keep what is broadcast, read and shuffled into one task within shares of a limit; larger inputs are more tasks, and sorts and joins spill."""
    before = {k: spark.conf.get(k, None) for k in SHARES}
    for k, share in SHARES.items():
        spark.conf.set(k, str((megabytes << 20) // share))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_suite(spark: SparkSession, suite: list[SuiteQuery], catalog: Catalog) -> dict[str, float]:
    """Seconds of each enabled query; the first result that differs from its expected file ends the run.

    Results without an order are compared where they lie, ordered ones line by line as they come.
    """
    took = {}
    for q in suite:
        if q.disabled:
            continue
        began = time.time()
        with within_memory(spark, q.memory_limit_mb):
            frame: DataFrame = compile_plan(q.plan, catalog)
            try:
                if q.sort_before_check:
                    validate_bags(as_lines(frame), spark.read.text(q.expected))
                else:
                    got = stream_lines(frame)
                    validate_lines(takewhile(lambda x: x != END, got), read_lines(spark, q.expected), True)
            except ResultMismatch as e:
                raise ResultMismatch(f"{q.name}: {e}") from None
        took[q.name] = time.time() - began
    return took

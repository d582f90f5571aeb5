"""Scan, Filter and Project trees over a growing folder of Parquet files; crossed tables are static.

The trees compile as for bounded tables: what a stream can't do (a sort, a cross with another stream) fails on start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.compiler import compile_plan
from ..plans.tree import Plan
from ..sources.catalog import Catalog


def follow(spark: SparkSession, plan: Plan, table: str, folder: str, static: Catalog, files_per_batch: int = 16) -> DataFrame:
    """The streaming result of ``plan``, where ``table`` is read from new files of ``folder``."""
    schema = static.table(table).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    others = [t for t in static.tables if t.name != table]
    return compile_plan(plan, Catalog(others).with_table(table, stream))

"""``python -m opalgrid ingest|blocks|profile|sqlite|starter|suite|run|explain``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.estimate import Estimator
from .operators.profile import profile
from .plans import compile_plan, from_json
from .plans.runner import dump_suite, load_suite, run_suite, starter_suite
from .sources.blocks import read_blocks, write_blocks
from .sources.catalog import Catalog
from .sources.sqlite import write_sqlite
from .sources.text import discover, write_lines


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="opalgrid", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    for name, about in (("ingest", "text tables to Parquet and a profiled catalog"), ("blocks", "text tables to block files and a profiled catalog"), ("profile", "the catalog of a folder of text tables, with statistics"), ("sqlite", "Parquet tables to a SQLite file on the driver"), ("starter", "a suite file to begin with"), ("suite", "run a suite file over Parquet tables"), ("run", "run a tree and write its lines"), ("explain", "show the plan and the estimated rows of a tree")):
        p = sub.add_parser(name, help=about)
        p.add_argument("--folder", required=True, help="folder of the tables")
        if name in ("ingest", "blocks", "sqlite", "starter"):
            p.add_argument("--out", required=True)
        if name in ("ingest", "blocks", "profile"):
            p.add_argument("--catalog", help="file for the catalog JSON, which is printed otherwise", default=None)
        if name in ("suite", "run", "explain"):
            p.add_argument("--file", required=True, help="JSON of the suite or tree")
            p.add_argument("--catalog", help="catalog JSON with statistics", default=None)
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--end", action="store_true", help="end the result with a line of its own")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("opalgrid").getOrCreate()
    if a.what in ("ingest", "blocks", "profile"):
        catalog, skipped = discover(spark, a.folder)
        for name in skipped:
            print(f"skipped {name}: it has no schema")
        for t in catalog.tables:
            frame = catalog.table(t.name)
            if a.what == "ingest":
                frame.write.mode("overwrite").parquet(f"{a.out}/{t.name}.parquet")
                frame = spark.read.parquet(f"{a.out}/{t.name}.parquet")
            elif a.what == "blocks":
                write_blocks(frame, f"{a.out}/{t.file_id}")
                frame = read_blocks(spark, f"{a.out}/{t.file_id}", frame.schema)
            found = profile(frame)
            for c in t.columns:
                c.stats, t.rows = found[c.name].stats(), found[c.name].rows
        if a.catalog:
            spark.createDataFrame([(x,) for x in catalog.to_json().splitlines()], "value string").coalesce(1).write.mode("overwrite").text(a.catalog)
        else:
            print(catalog.to_json())
        return
    if a.what == "sqlite":
        print(json.dumps(write_sqlite(Catalog.from_dir(spark, a.folder), a.out)))
        return
    if a.what == "starter":
        print(dump_suite(starter_suite(Catalog.from_dir(spark, a.folder), a.out)))
        return
    content = "\n".join(r.value for r in spark.read.text(a.file).coalesce(1).collect())
    if a.catalog:
        declared = "\n".join(r.value for r in spark.read.text(a.catalog).coalesce(1).collect())
        catalog = Catalog.from_json(declared, lambda t: spark.read.parquet(f"{a.folder}/{t.name}.parquet"))
    else:
        catalog = Catalog.from_dir(spark, a.folder)
    if a.what == "suite":
        print(json.dumps(run_suite(spark, load_suite(content), catalog)))
        return
    plan = from_json(content)
    frame = compile_plan(plan, catalog, by_statistics=a.catalog is not None)
    if a.what == "run":
        write_lines(frame, a.out, a.end)
    else:
        print("estimated rows:", Estimator(catalog).rows(plan))
        frame.explain("formatted")


if __name__ == "__main__":
    main()

"""Tables by name, with declared columns and their statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The five types by the names they have in schema files and in catalogs.
SCHEMA_TYPES = {"I32": T.IntegerType(), "I64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}
CATALOG_TYPES = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType()}

STANDARD_TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")


class CatalogError(ValueError):
    """A catalog that is not well formed."""


@dataclass
class ColumnInfo:
    name: str
    dtype: T.DataType
    stats: list | None = None


@dataclass
class TableInfo:
    name: str
    file_id: str
    columns: list[ColumnInfo]
    load: Callable[[], DataFrame] | None = field(default=None, repr=False)
    #: Rows as a profile counted them; those of tables without rows or values can't be had from the statistics of columns.
    rows: int | None = None

    def to_dict(self) -> dict:
        kinds = {v: k for k, v in CATALOG_TYPES.items()}
        columns = [{"column_name": c.name, "data_type": kinds.get(c.dtype, c.dtype.simpleString()), "stats": c.stats} for c in self.columns]
        out = {"name": self.name, "file_id": self.file_id, "column_specs": columns}
        return out if self.rows is None else out | {"row_count": self.rows}


def validate(tables: Iterable[TableInfo]) -> None:
    """Names are not blank and unique, of tables, files and the columns of a table; no table is without columns."""
    names: set[str] = set()
    files: set[str] = set()
    for t in tables:
        if not t.name.strip():
            raise CatalogError("a table has a blank name")
        if not t.file_id.strip():
            raise CatalogError(f"table {t.name} has a blank file id")
        if not t.columns:
            raise CatalogError(f"table {t.name} has no columns")
        if t.name in names:
            raise CatalogError(f"table {t.name} occurs twice")
        if t.file_id in files:
            raise CatalogError(f"file id {t.file_id} occurs twice")
        names.add(t.name)
        files.add(t.file_id)
        seen: set[str] = set()
        for c in t.columns:
            if not c.name.strip():
                raise CatalogError(f"table {t.name} has a column with a blank name")
            if c.name in seen:
                raise CatalogError(f"column {c.name} of table {t.name} occurs twice")
            seen.add(c.name)


class Catalog:
    """Tables that plans can scan, by name or by file id."""

    def __init__(self, tables: Iterable[TableInfo]) -> None:
        self.tables = list(tables)
        validate(self.tables)

    def find(self, name: str) -> TableInfo:
        for t in self.tables:
            if name in (t.name, t.file_id):
                return t
        raise LookupError(f"unknown table {name}")

    def table(self, name: str) -> DataFrame:
        found = self.find(name)
        if found.load is None:
            raise LookupError(f"table {name} has no data")
        return found.load()

    def with_table(self, name: str, frame: DataFrame, file_id: str | None = None) -> Catalog:
        return Catalog([*self.tables, of_frame(name, frame, file_id)])

    def to_json(self) -> str:
        return json.dumps({"table_specs": [t.to_dict() for t in self.tables]}, indent=2)

    @classmethod
    def from_json(cls, source: str, load: Callable[[TableInfo], DataFrame] | None = None) -> Catalog:
        """Tables as declared; ``load`` gives the rows of a table."""
        out = []
        for t in json.loads(source)["table_specs"]:
            columns = []
            for c in t["column_specs"]:
                if c["data_type"] not in CATALOG_TYPES:
                    raise CatalogError(f"column {c['column_name']} has the unknown type {c['data_type']}")
                columns.append(ColumnInfo(c["column_name"], CATALOG_TYPES[c["data_type"]], c.get("stats")))
            info = TableInfo(t["name"], t["file_id"], columns, rows=t.get("row_count"))
            if load is not None:
                info.load = lambda info=info: load(info)
            out.append(info)
        return cls(out)

    @classmethod
    def from_dir(cls, spark: SparkSession, folder: str, names: Iterable[str] = STANDARD_TABLES) -> Catalog:
        """Parquet tables of a folder; ``partsupp`` is derived from ``lineitem``, and comes with it unless names are given."""
        names = list(names)
        if names == list(STANDARD_TABLES):
            names.append("partsupp")
        tables = [of_frame(n, read_parquet(spark, f"{folder}/{n}.parquet"), f"{n}.parquet") for n in names if n != "partsupp"]
        if "partsupp" in names:
            tables.append(of_frame("partsupp", partsupp(read_parquet(spark, f"{folder}/lineitem.parquet"))))
        return cls(tables)


_schemas: dict[tuple, T.StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from a footer once, as long as the file or folder has the same time and length."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (spark.sparkContext.applicationId, path, found.getModificationTime(), found.getLen())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def of_frame(name: str, frame: DataFrame, file_id: str | None = None) -> TableInfo:
    return TableInfo(name, file_id or f"{name}.derived", [ColumnInfo(f.name, f.dataType) for f in frame.schema.fields], lambda: frame)


PARTSUPP_SQL = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
  CAST(sum(l_quantity) AS INT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def partsupp(lineitem: DataFrame) -> DataFrame:
    """One row per part and supplier that occur together."""
    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum("l_quantity").cast("int").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost"))

"""Pipe-separated text with a two-line schema file, and results as text with a validator."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import zip_longest
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import SCHEMA_TYPES, Catalog, CatalogError, ColumnInfo, TableInfo


def parse_schema(content: str) -> T.StructType:
    """Two lines separated by pipes: column names, and types (``I32 I64 FLOAT32 FLOAT64 STRING`` in any case)."""
    lines = [x.strip().rstrip("|") for x in content.splitlines() if x.strip()]
    if len(lines) != 2:
        raise CatalogError("a schema has two lines: names and types")
    names, types = ([x.strip() for x in line.split("|")] for line in lines)
    if len(names) != len(types):
        raise CatalogError(f"{len(names)} names and {len(types)} types")
    unknown = [t for t in types if t.upper() not in SCHEMA_TYPES]
    if unknown:
        raise CatalogError(f"unknown type {unknown[0]}")
    return T.StructType([T.StructField(n, SCHEMA_TYPES[t.upper()], False) for n, t in zip(names, types, strict=True)])


def read_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a pipe-separated file, with or without a pipe at the end of a line.

    An empty string is a value, and nothing is quoted; blank lines are passed over. A field that is no number of its type, or a row with too few
    or too many fields, fails.
    """
    n = len(schema.fields)
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.split("value", r"\|", -1).alias("parts"))
    whole = (F.size("parts") == n) | ((F.size("parts") == n + 1) & (F.element_at("parts", -1) == ""))
    parts = F.when(whole, F.col("parts")).otherwise(F.raise_error(F.concat(F.lit(f"a row has not {n} fields: "), "value")))
    rows = rows.select(parts.alias("parts"))
    return rows.select(*[F.col("parts")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def discover(spark: SparkSession, folder: str) -> tuple[Catalog, list[str]]:
    """A catalog of every ``x.csv`` of a folder that has an ``x.schema``; the names of those that have none.

    The folder may be in any store that Spark reads.
    """
    jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    tables, skipped = [], []
    for name in names:
        stem = PurePosixPath(name)
        if stem.suffix != ".csv":
            continue
        if f"{stem.stem}.schema" not in names:
            skipped.append(name)
            continue
        content = "\n".join(r.value for r in spark.read.text(f"{folder}/{stem.stem}.schema").coalesce(1).collect())
        schema = parse_schema(content)
        columns = [ColumnInfo(f.name, f.dataType) for f in schema.fields]
        tables.append(TableInfo(stem.stem, f"{stem.stem}.bin", columns, lambda p=f"{folder}/{name}", s=schema: read_text(spark, p, s)))
    assert jvm is not None
    return Catalog(tables), skipped


#: The last line of a result that is sent as a stream.
END = "!"


def float_text(column: Column) -> Column:
    """A number as the shortest digits that name it, plain from 0.0001 up to 10**16 and else with an exponent: ``0.5 100.0 1e16 2.5e-7``.

    The digits are Spark's own, which for some doubles are one more than the shortest.
    """
    shown = column.cast("string")
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(shown, "^-", "")
    mantissa, power = F.substring_index(body, "E", 1), F.try_to_number(F.substring_index(body, "E", -1), F.lit("S999")).cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", "")
    digits = F.concat(whole, part)
    large = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise("0"))
    long = F.concat(whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("e"), power.cast("string"))
    scientific = F.when((power >= 0) & (power < 16), large).when(power == -4, F.concat(F.lit("0.000"), digits)).otherwise(long)
    text = F.when(body == "Infinity", "inf").when(body.contains("E"), scientific).otherwise(body)
    return F.when(column.isNull(), "").when(F.isnan(column), "NaN").otherwise(F.concat(sign, text))


def as_lines(frame: DataFrame) -> DataFrame:
    """One string ``value`` per row: each field and then a pipe. Nulls are empty."""
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    kinds = [isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in frame.schema.fields]
    fields = [float_text(F.col(f"c{i}")) if k else F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")) for i, k in enumerate(kinds)]
    return plain.select(F.concat(*[x for f in fields for x in (f, F.lit("|"))], F.lit("")).alias("value"))


def write_lines(frame: DataFrame, path: str, end: bool = False) -> None:
    """Write result lines as text files; the rows of a sorted frame stay in order over the part files.

    With ``end`` the last line of the last file is the mark that ends a result.
    """
    out = as_lines(frame)
    if end:
        out = out.union(frame.sparkSession.createDataFrame([(END,)], "value string").coalesce(1))
    out.write.text(path)


def read_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of a text file, or of the part files of a folder by their names, a piece at a time."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    for name in sorted(s.getPath().toString() for s in found if s.getLen() and not s.getPath().getName().startswith(("_", "."))):
        yield from (r.value for r in spark.read.text(name).toLocalIterator())


def stream_lines(frame: DataFrame) -> Iterator[str]:
    """Result lines in order, a partition at a time, and the mark that ends them."""
    yield from (r.value for r in as_lines(frame).toLocalIterator())
    yield END


def lines(frame: DataFrame) -> list[str]:
    """All result lines on the driver, for results that are small by their nature, such as expected outputs."""
    return [r.value for r in as_lines(frame).collect()]


class ResultMismatch(AssertionError):
    """A result that differs from what was expected."""


def validate_lines(got: Iterable[str], expected: Iterable[str], in_order: bool) -> None:
    """Compare result lines one by one, or as multisets; white space at the ends does not count.

    In order, only a line of either is held at a time.
    """
    if not in_order:
        a, b = sorted(x.strip() for x in got), sorted(x.strip() for x in expected)
        if len(a) != len(b):
            raise ResultMismatch(f"expected {len(b)} rows but found {len(a)}")
        got, expected = a, b
    none = object()
    for i, (x, y) in enumerate(zip_longest(got, expected, fillvalue=none), 1):
        if x is none or y is none:
            raise ResultMismatch(f"row {i}: {'a row is missing' if x is none else 'there are more rows than expected'}")
        x, y = x.strip(), y.strip()
        if not x:
            raise ResultMismatch("an empty line in the result")
        if x != y:
            raise ResultMismatch(f"row {i}: expected {y} but found {x}")


def validate_bags(got: DataFrame, expected: DataFrame) -> None:
    """Compare two frames of lines as multisets, where they lie."""
    sides = [x.select(F.trim("value").alias("value"), F.lit(n).alias("side")) for x, n in ((got, 1), (expected, -1))]
    wrong = sides[0].unionByName(sides[1]).groupBy("value").agg(F.sum("side").alias("more"), F.sum((F.col("side") > 0).cast("int")).alias("n")).where("more <> 0 or (value = '' and n > 0)")
    first = wrong.orderBy("value").first()
    if first is not None:
        raise ResultMismatch("an empty line in the result" if not first.value and first.n else f"{abs(first.more)} {'more' if first.more > 0 else 'fewer'} rows than expected are {first.value}")


def same_rows(got: DataFrame, expected: DataFrame) -> bool:
    """Whether two frames hold the same multiset of rows, compared where they lie."""
    a, b = (x.toDF(*[f"c{i}" for i in range(len(x.columns))]) for x in (got, expected))
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_side").alias("d")).where("d <> 0").isEmpty()

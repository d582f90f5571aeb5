"""Profiles of columns: range, distinct values, density, physical order, histogram and number of rows.

For profiles, one aggregate gives range, a sketch of distinct values and rows of all columns, so the table is read once for them. Of columns that have few
distinct values by their sketch, a second one counts these exactly; profiles report the sketch's estimate
of all others, whose relative error is that of 4096 registers, unless exact counts are asked for. Histograms of all columns take five passes, and those of columns with few rows three.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import CATALOG_TYPES

#: Fixed values of the profile.
EXACT_LIMIT = 10_000
BUCKETS = 10
MAX_STRINGS = 50
#: Rows of a gap around a quantile from which on it is narrowed by sketches before its values are counted.
GAP_ROWS = 100_000


@dataclass
class Profile:
    """What is known of a column; ``None`` where it was not asked for or does not exist."""

    rows: int
    lower: object | None
    upper: object | None
    cardinality: int
    density: float
    ordered: bool | None = None
    histogram: list[tuple[object, object, int]] | None = None
    kind: str = "Float64"

    def stats(self) -> list:
        """The tagged form that catalogs hold; empty for a table without rows."""
        if not self.rows:
            return []
        out: list = ["IsPhysicallyOrdered"] if self.ordered else []
        if self.lower is not None:
            out.append({"RangeStat": self._range(self.lower, self.upper)})
        out += [{"CardinalityStat": self.cardinality}, {"DensityStat": self.density}]
        if self.histogram is not None:
            out.append({"HistogramStat": {"frequency_points": [[self._range(a, b), n] for a, b, n in self.histogram]}})
        return out

    def _range(self, lower: object, upper: object) -> dict:
        return {"lower_bound": {self.kind: lower}, "upper_bound": {self.kind: upper}}


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _bounds(value, dtype: T.DataType) -> list:
    number = value.cast("double") if _numeric(dtype) else F.lit(None).cast("double")
    return [F.min(number).alias("lower_bound"), F.max(number).alias("upper_bound")]


def _sketch(column):
    """An estimate of distinct values by 4096 registers; nulls don't count."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column)), F.lit(12)))


def column_stats(frame: DataFrame, exact: bool | None = True) -> DataFrame:
    """One row per column: column_name, row_count, lower_bound, upper_bound (numbers only, as double), cardinality, density.

    Exactly, each column is read by itself and grouped by its values, which tasks combine first, so that no row is repeated for another column.
    ``exact=False`` counts distinct values by sketches in one pass over all columns, ``None`` those of columns with over ``EXACT_LIMIT`` by them, and the others
    exactly, as sets that tasks put together.
    """
    fields = frame.schema.fields
    plain = frame.toDF(*[f"c{i}" for i in range(len(fields))])
    if exact:
        parts = []
        for i, f in enumerate(fields):
            values = plain.select(F.col(f"c{i}").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
            one = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), *_bounds(F.col("v"), f.dataType), F.count("v").alias("cardinality"))
            parts.append(one.select(F.lit(f.name).alias("column_name"), "*"))
        out = reduce(DataFrame.unionByName, parts)
    else:
        sums = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields):
            low, high = _bounds(F.col(f"c{i}"), f.dataType)
            sums += [low.alias(f"lo{i}"), high.alias(f"hi{i}"), _sketch(F.col(f"c{i}")).alias(f"d{i}")]
        one = plain.agg(*sums).first()  # a few numbers a column
        counts = {i: min(one[f"d{i}"], one["n"]) for i in range(len(fields))}
        few = [i for i in counts if counts[i] <= EXACT_LIMIT] if exact is None else []
        if few:
            found = plain.agg(*[F.size(F.collect_set(f"c{i}")).alias(f"d{i}") for i in few]).first()
            counts |= {i: found[f"d{i}"] for i in few}
        rows = [(f.name, one["n"], one[f"lo{i}"], one[f"hi{i}"], counts[i]) for i, f in enumerate(fields)]
        out = frame.sparkSession.createDataFrame(rows, "column_name string, row_count long, lower_bound double, upper_bound double, cardinality long")
    density = F.when(F.col("row_count") > 0, F.least(F.lit(1.0), F.col("cardinality") / F.col("row_count")).cast("float"))
    return out.withColumn("density", density)


def _quantiles(frame: DataFrame, values: list, buckets: int, accuracy: int) -> list[list[float]]:
    """Of each column the values at the ranks ``ceil(b * n / buckets)``, exactly and without nulls; NaN is above all numbers.

    A sketch of the values gives a few cuts around each rank, and a count of the rows at and between them says which gap has it; a gap of over ``GAP_ROWS``
    rows is cut again, and of smaller ones the values themselves are counted. So only the number of passes rests on the sketches.
    """

    def inside(i: int, lo: float | None, hi: float | None):
        tests = [~F.isnan(values[i]), *([values[i] > F.lit(lo)] if lo is not None else []), *([values[i] < F.lit(hi)] if hi is not None else [])]
        return F.when(reduce(lambda a, b: a & b, tests), values[i])

    def each(columns: list):
        """The given values below one another, by their number, each read by itself; nulls are left out."""
        return reduce(DataFrame.unionByName, [frame.select(F.lit(k).alias("k"), x.alias("x")).where("x is not null") for k, x in enumerate(columns)])

    out: list[dict[int, float]] = [{} for _ in values]
    counts = frame.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values)], *[F.count(inside(i, None, None)).alias(f"m{i}") for i in range(len(values))]).first()
    # gaps, each with its rows and the ranks within it that are asked for
    large: list[tuple[int, float | None, float | None, int, dict[int, int]]] = []
    small = []
    for i in range(len(values)):
        ranks = {b: max(1, -(-b * counts[f"n{i}"] // buckets)) for b in range(1, buckets)} if counts[f"n{i}"] else {}
        out[i] |= {b: math.nan for b, r in ranks.items() if r > counts[f"m{i}"]}
        ranks = {b: r for b, r in ranks.items() if b not in out[i]}
        if ranks:
            (small if counts[f"m{i}"] <= GAP_ROWS else large).append((i, None, None, counts[f"m{i}"], ranks))
    while large:
        sketches = []
        for k, (i, lo, hi, n, ranks) in enumerate(large):
            points = sorted({min(1.0, max(0.0, r / n + d / accuracy)) for r in ranks.values() for d in (-2, 2)})
            sketches.append(F.percentile_approx(inside(i, lo, hi), points, accuracy).alias(f"q{k}"))
        found = frame.agg(*sketches).first()
        cuts = [sorted(set(found[f"q{k}"])) for k in range(len(large))]
        # an odd cell has the copies of a cut, an even one what is between two
        cells = []
        for g, at in zip(large, cuts, strict=True):
            v = values[g[0]]
            cells.append(F.when(inside(*g[:3]).isNotNull(), reduce(lambda a, b: a + b, [(v > c).cast("int") + (v >= c).cast("int") for c in map(F.lit, at)])))
        rows: dict[tuple[int, int], int] = {(r.k, r.x): r.n for r in each(cells).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")).collect()}
        gaps, large = large, []
        for k, (i, lo, hi, n, ranks) in enumerate(gaps):
            before = 0
            for cell in range(2 * len(cuts[k]) + 1):
                here = rows.get((k, cell), 0)
                within = {b: r - before for b, r in ranks.items() if before < r <= before + here}
                before += here
                if within and cell % 2:
                    out[i] |= dict.fromkeys(within, cuts[k][cell // 2])
                elif within:
                    gap = (i, cuts[k][cell // 2 - 1] if cell else lo, cuts[k][cell // 2] if cell < 2 * len(cuts[k]) else hi, here, within)
                    # where a sketch has cut nothing off, values are counted nevertheless
                    (small if here <= GAP_ROWS or here == n else large).append(gap)
    if small:
        counted = each([inside(*g[:3]) for g in small]).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("x")))
        wanted = [(F.col("k") == k) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r) for k, g in enumerate(small) for r in g[4].values()]
        for row in upto.where(reduce(lambda a, b: a | b, wanted)).collect():
            i, ranks = small[row.k][0], small[row.k][4]
            out[i] |= {b: row.x for b, r in ranks.items() if row.upto - row.n < r <= row.upto}
    return [[found[b] for b in sorted(found)] for found in out]


def histograms(frame: DataFrame, columns: list[str], buckets: int = BUCKETS, accuracy: int = 10_000) -> DataFrame:
    """Equi-depth buckets of numeric columns: column_name, bucket, lower_bound, upper_bound, frequency, over all rows.

    Bounds are exact quantiles, found for all columns at once, and a last pass counts between them; rows stay where they are but for the few around a bound,
    and equal values are never divided. ``accuracy`` is that of the sketches which say where to look, and changes no result.
    """
    if not columns:
        return frame.sparkSession.createDataFrame([], "column_name string, bucket int, lower_bound double, upper_bound double, frequency long")
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    found = _quantiles(frame, values, buckets, accuracy)
    tiles = []
    for i, (c, v) in enumerate(zip(columns, values, strict=True)):
        tile = F.lit(0)
        for b in sorted({b for b in found[i] if not math.isnan(b)}):
            tile = tile + (v > F.lit(b)).cast("int")
        tiles.append(F.struct(F.lit(c).alias("column_name"), tile.alias("bucket"), v.alias("v")))
    rows = frame.select(F.explode(F.array(*tiles)).alias("e")).select("e.*").where("v is not null")
    return rows.groupBy("column_name", "bucket").agg(F.min("v").alias("lower_bound"), F.max("v").alias("upper_bound"), F.count(F.lit(1)).alias("frequency"))


def histogram(frame: DataFrame, column: str, buckets: int = BUCKETS, accuracy: int = 10_000) -> DataFrame:
    """The histogram of one numeric column: bucket, lower_bound, upper_bound, frequency."""
    return histograms(frame, [column], buckets, accuracy).drop("column_name")


def string_histogram(frame: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Equi-depth buckets of a string column: bucket, lower_bound, upper_bound, frequency; none where it has over ``MAX_STRINGS`` distinct values."""
    values = frame.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # the windows see one row more than the limit at most
    few = values.limit(MAX_STRINGS + 1).withColumn("_values", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("_values") <= MAX_STRINGS)
    before, total = F.sum("n").over(Window.orderBy("v")) - F.col("n"), F.sum("n").over(Window.partitionBy())
    tiled = few.select("v", "n", F.least(F.floor(before * buckets / total), F.lit(buckets - 1)).cast("int").alias("bucket"))
    return tiled.groupBy("bucket").agg(F.min("v").alias("lower_bound"), F.max("v").alias("upper_bound"), F.sum("n").alias("frequency"))


def physically_ordered(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: column_name, ordered; true where no value is below the one before it in file order.

    Files come by their path, and the blocks of a file by their offset, however a scan packs them into tasks; of a frame that is no scan of files,
    the order is that of its partitions. Rows stay where they are: each block is summed up as its first and last values and
    whether it is in order, and only these are compared across blocks. A null or NaN is below nothing, and nothing is below it.
    """
    names = columns or frame.columns
    try:
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
        frame.select(*place).schema  # noqa: B018  (resolves the names)
    except AnalysisException:
        place = [F.lit(""), F.spark_partition_id().cast("long")]
    kept = frame.select(*[x.alias(n) for x, n in zip(place, ("file", "block"), strict=True)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType())])
    for f in kept.schema.fields[2:]:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"{f.dataType.simpleString()} has no order here")
        i = f.name[1:]
        out = out.add(f"bad{i}", "boolean").add(f"first{i}", f.dataType).add(f"last{i}", f.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last, bad = None, [], [], []

        def summed() -> pa.RecordBatch:
            columns_ = [*at, *[x for i in range(len(names)) for x in (pa.array([bad[i]]), first[i], last[i])]]
            return pa.RecordBatch.from_arrays(columns_, names=[f.name for f in out.fields])

        for batch in batches:
            files, blocks = batch.column(0), batch.column(1)
            n, lo = batch.num_rows, 0
            while lo < n:
                # the rows of a block lie together
                same = pc.and_(pc.equal(files.slice(lo), files[lo]), pc.equal(blocks.slice(lo), blocks[lo]))
                end = pc.index(same, False).as_py()
                size = n - lo if end < 0 else end
                values = [v.slice(lo, size) for v in batch.columns[2:]]
                if at is None or at[0][0] != files[lo] or at[1][0] != blocks[lo]:
                    if at is not None:
                        yield summed()
                    at, first, last, bad = [files.slice(lo, 1), blocks.slice(lo, 1)], [v.slice(0, 1) for v in values], [], [False] * len(names)
                for i, v in enumerate(values):
                    if not bad[i]:
                        v = pa.concat_arrays([last[i], v]) if last else v
                        bad[i] = bool(pc.any(pc.less(v.slice(1), v.slice(0, len(v) - 1))).as_py())
                last = [v.slice(len(v) - 1) for v in values]
                lo += size
        if at is not None:
            yield summed()

    blocks = kept.mapInArrow(run, out)
    across = Window.orderBy("file", "block")  # a row for each block of a file
    found = blocks.select(*[(F.col(f"bad{i}") | F.coalesce(F.lag(f"last{i}").over(across) > F.col(f"first{i}"), F.lit(False))).alias(f"bad{i}") for i in range(len(names))])
    one = found.agg(*[F.coalesce(~F.bool_or(f"bad{i}"), F.lit(True)).alias(f"ok{i}") for i in range(len(names))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"ok{i}").alias("ordered")) for i, c in enumerate(names)])).alias("e")).select("e.*")


def profile(frame: DataFrame, with_order: bool = True, with_histogram: bool = True, exact: bool | None = None) -> dict[str, Profile]:
    """Profiles of all columns by name, with distinct values as ``column_stats`` counts them; what reaches the driver is a row per column and bucket."""
    stats = {r.column_name: r for r in column_stats(frame, exact=exact).collect()}
    ordered = {r.column_name: r.ordered for r in physically_ordered(frame).collect()} if with_order else {}
    numbers = [f.name for f in frame.schema.fields if _numeric(f.dataType)]
    tiles: dict[str, list] = {}
    for h in histograms(frame, numbers).orderBy("bucket").collect() if with_histogram else ():
        tiles.setdefault(h.column_name, []).append(h)
    out = {}
    for f in frame.schema.fields:
        r = stats[f.name]
        cast = int if isinstance(f.dataType, T.IntegralType) else float
        lower, upper = (None, None) if r.lower_bound is None else (cast(r.lower_bound), cast(r.upper_bound))
        kind = {v: k for k, v in CATALOG_TYPES.items()}.get(f.dataType, "Float64")
        # in full precision, so that rows can be had from it
        density = r.cardinality / r.row_count if r.row_count else 0.0
        p = Profile(r.row_count, lower, upper, r.cardinality, density, ordered.get(f.name), kind=kind)
        if with_histogram and r.row_count:
            if _numeric(f.dataType):
                p.histogram = [(cast(h.lower_bound), cast(h.upper_bound), h.frequency) for h in tiles.get(f.name, [])]
            elif isinstance(f.dataType, T.StringType) and r.cardinality <= MAX_STRINGS:
                p.histogram = [(h.lower_bound, h.upper_bound, h.frequency) for h in string_histogram(frame, f.name).orderBy("bucket").collect()]
        out[f.name] = p
    return out

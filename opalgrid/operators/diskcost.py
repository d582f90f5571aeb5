"""A cost model of block access on a rotating disk, over a table of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Disk:
    """The default geometry and speeds."""

    block_size: int = 4096
    rpm: int = 7200
    blocks_per_track: int = 1024
    heads_per_cylinder: int = 4
    total_cylinders: int = 500_000
    track_to_track_ms: float = 0.8
    full_stroke_ms: float = 18.0
    transfer_mb_s: float = 150.0


def access_costs(requests: DataFrame, disk: Disk = Disk(), by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``requests`` (seq, start_block, num_blocks) with cylinders, seek_us, rotation_us, transfer_us, total_us.

    A request costs a seek by the square root of the share of cylinders passed, half a turn unless it
    starts where the one before it ended, the transfer, and a step for each cylinder that it crosses. The
    first one starts from block 0 of cylinder 0. ``by`` names columns of independent disks. The requests of a disk are cut into
    ``parts`` ranges of ``seq``; in a range each follows the one before it, and the first of a range the last of the nearest range before.
    """
    per_cylinder = disk.blocks_per_track * disk.heads_per_cylinder
    by = by or []
    some = requests.where("num_blocks > 0").withColumn("_end", F.col("start_block") + F.col("num_blocks") - 1)
    parts = parts or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = some.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else None
    cuts = F.array(*map(F.lit, sorted(set(cuts or [])))) if cuts else None
    some = some.withColumn("_part", F.size(F.filter(cuts, lambda c: c <= F.col("seq"))) if cuts is not None else F.lit(0))
    # a row for each range of each disk
    lasts = some.groupBy(*by, "_part").agg(F.max_by("_end", "seq").alias("_last"))
    lasts = lasts.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), F.coalesce(F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")), F.lit(0)).alias("_entry"))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    w = Window.partitionBy(*by, "_part").orderBy("seq")
    before = F.coalesce(F.lag("_end").over(w), F.col("_entry"))
    some = some.join(lasts, same)
    at = some.withColumn("_before", before).withColumns({"_from": F.floor(F.col("_before") / per_cylinder), "_first": F.floor(F.col("start_block") / per_cylinder), "_last": F.floor(F.col("_end") / per_cylinder)})
    far, crossed = F.abs(F.col("_first") - F.col("_from")), F.col("_last") - F.col("_first")
    step, stroke = disk.track_to_track_ms, disk.full_stroke_ms
    seek = F.when(far == 0, 0.0).when(far == 1, step).otherwise(step + (stroke - step) * F.sqrt(F.least(F.lit(1.0), far / disk.total_cylinders)))
    turn = F.when(F.col("start_block") == F.col("_before") + 1, 0.0).otherwise(0.5 * 60_000 / disk.rpm)
    transfer = F.col("num_blocks") * disk.block_size / 1e6 / disk.transfer_mb_s * 1000
    out = at.withColumns({"cylinders": far + crossed, "seek_us": (seek + crossed * step) * 1000, "rotation_us": turn * 1000, "transfer_us": transfer * 1000})
    return out.withColumn("total_us", F.col("seek_us") + F.col("rotation_us") + F.col("transfer_us")).drop("_end", "_before", "_from", "_first", "_last", "_part", "_of", "_entry", *[f"_by{i}" for i in range(len(by))])

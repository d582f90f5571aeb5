"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are put into blocks by the leading bits of a seeded hash of their ids, so that the
blocks of a source in number order are a random permutation of its documents. A source whose target is
``e`` times its size and ``r`` words is drawn ``e`` times whole and once more up to ``r`` words: whole
blocks, the documents of one boundary block in hash order, and one document whose size fits the rest best.
The draws (source, pass, block) of all sources are then dealt to output shards: a binary tree over the
shards splits each source's exact quota of draws by multivariate-hypergeometric variates, leaves draw
disjoint runs of each source's permuted draws, and each shard is shuffled by itself.

Sources may be any in number: their targets are found by sums over a table. What reaches the driver is the quotas of strata times
shards; strata are the sources, or hashed groups of sources where there are very many. A source of n documents has ``2 ** BITS``
blocks, or the square root of n if that is more, so that neither the blocks of a source nor the documents of a block are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import column, materialize, read_table

WEIGHTS = (1, 2, 3)
MAX_RATIO = 3
BITS = 14
#: Sources that a task puts in order.
ROWS_PER_TASK = 100_000
#: Documents before and behind the boundary of a source from which the best fitting ones are chosen.
AROUND = 24
OUTPUT = ("mix_size", "mix_source_size", "mix_target", "mix_picks")
#: Words: runs of code points that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, max_ratio: float = MAX_RATIO) -> dict[str | None, float]:
    """Targets that share the total size by weight, none above ``max_ratio`` times its source's size.

    Sources take the weights in turn, by code point, null last. What sources at their limit leave is
    shared by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    left, rest = float(sum(sizes.values())), list(order)
    while rest:
        unit = left / sum(weight[s] for s in rest)
        above = [s for s in rest if unit * weight[s] > max_ratio * sizes[s]]
        if not above:
            return targets | {s: unit * weight[s] for s in rest}
        for s in above:
            targets[s] = float(max_ratio * sizes[s])
            left -= targets[s]
        left = max(left, 0.0)
        rest = [s for s in rest if s not in targets]
    return targets


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact quotas (shards x sources): a tree halves the shards and draws what goes left."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        left = total * (mid - lo) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(counts, left, method="marginals") if total else counts
        split(lo, mid, drawn)
        split(mid, hi, counts - drawn)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


#: Bits of a subset sum at most: larger sums are reckoned in coarser units, of that share of their total.
SUM_BITS = 1 << 22


def nearest_subset(sizes: list[int], room: int) -> list[int]:
    """Places of sizes whose sum is as near to ``room`` as any, by a bitset of the sums that can be reached.

    Sums of over ``SUM_BITS`` are counted in units, so that it is as near as half a unit for each size allows.
    """
    unit = 1 + sum(sizes) // SUM_BITS
    sizes, room = [(x + unit // 2) // unit for x in sizes], (room + unit // 2) // unit
    reached = [1]
    for x in sizes:
        reached.append(reached[-1] | reached[-1] << x)
    below = reached[-1] & ((1 << (room + 1)) - 1)
    above = reached[-1] >> room
    total = below.bit_length() - 1
    if above and (above & -above).bit_length() - 1 < room - total:
        total = room + (above & -above).bit_length() - 1
    out = []
    for i in range(len(sizes) - 1, -1, -1):
        if not reached[i] >> total & 1:
            out.append(i)
            total -= sizes[i]
    return out[::-1]


def _source_key(source):
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= 10_000 else df


def _numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` with ``_j``: 0, or the place among the rows of the same set, which share source, id and text.

    Rows of a set are numbered in each task of a written table, and each task's from where the last one ended.
    """
    if repeated is None:
        return rows.withColumn("_j", F.lit(0).cast("long"))
    again = materialize(rows.join(repeated, "_set", "left_semi").withColumn("_at", F.monotonically_increasing_id()), "mix").withColumn("_task", F.shiftright("_at", 33))
    tasks = again.groupBy("_set", "_task").agg(F.count(F.lit(1)).alias("_n"))
    tasks = tasks.withColumn("_from", F.sum("_n").over(Window.partitionBy("_set").orderBy("_task")) - F.col("_n")).drop("_n")
    # the keys are joined in another form, so that the join has exchanges of its own, and a hot set can be split
    tasks = tasks.select(F.bitwise_not("_set").alias("_s"), F.col("_task").alias("_t"), "_from")
    own = F.row_number().over(Window.partitionBy("_set", "_task").orderBy("_at"))
    again = again.withColumn("_own", own).join(tasks, (F.bitwise_not("_set") == F.col("_s")) & (F.col("_task") == F.col("_t")))
    once = rows.join(repeated, "_set", "left_anti").withColumn("_j", F.lit(0).cast("long"))
    return once.unionByName(again.withColumn("_j", (F.col("_from") + F.col("_own") - 1).cast("long")).select(*once.columns))


def _ranked(sources: DataFrame, n: int) -> DataFrame:
    """``sources`` with ``_place`` from 0 by ``_key``, in tasks of bounded size."""
    parts = max(1, -(-n // ROWS_PER_TASK))
    dealt = materialize(sources.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()), "mix")
    sizes = {r["_part"]: r.n for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = np.cumsum([sizes.get(p, 0) for p in range(parts)]).tolist()
    starts = [(p, e - sizes.get(p, 0)) for p, e in enumerate(ends)]
    begins = F.broadcast(sources.sparkSession.createDataFrame(starts, "_part int, _from long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return materialize(dealt.withColumn("_own", own).join(begins, "_part").withColumn("_place", F.col("_from") + F.col("_own") - 1).drop("_part", "_own", "_from"), "mix")


def with_targets(sources: DataFrame, weights=WEIGHTS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``source_targets`` for a table (_place, _size, ...) of any number of sources: ``_target`` is added.

    What a unit of weight gets only grows, so the sources at their limit are found by sums, until none is added.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    left, held, unit = None, None, 0.0
    while True:
        above = F.lit(unit) * weight > max_ratio * F.col("_size")
        found = sources.agg(F.sum(F.when(above, max_ratio * F.col("_size"))).alias("stopped"), F.sum(F.when(~above, weight)).alias("rest"), F.sum("_size").alias("total")).first()
        now = ((found["total"] or 0) - (found["stopped"] or 0), found["rest"] or 0)
        if now == (left, held) or not now[1]:
            return sources.withColumn("_target", F.when(above, (max_ratio * F.col("_size")).cast("double")).otherwise(F.lit(unit) * weight))
        left, held = now
        unit = max(0.0, left / held)


def _chosen(docs_of_edges: DataFrame) -> DataFrame:
    """(_key, _edge, _cut, _taken): for each boundary block, the last rank that is taken whole and the documents chosen beyond it.

    ``docs_of_edges`` has a row per source with its documents around the boundary, ``2 * AROUND + 1`` at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, taken = [], []
            for rows, room in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cut = None
                if rows[0]["_at"] > 1:  # all before the second of these are taken
                    cut, room, rows = rows[0]["_rank"], room - rows[0]["_run"], rows[1:]
                cuts.append(cut)
                taken.append([{k: rows[i][k] for k in ("_rank", "_set", "_j")} for i in nearest_subset([r["_size"] for r in rows], room)])
            kind = pa.list_(pa.struct([("_rank", pa.int64()), ("_set", pa.int64()), ("_j", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.int64()), pa.array(taken, kind)], names=["_key", "_edge", "_cut", "_taken"])

    return docs_of_edges.mapInArrow(run, "_key string, _edge long, _cut long, _taken array<struct<_rank:long,_set:long,_j:long>>")


def _picked(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, seed: int, docs_per_block: int, draws_per_shard: int, max_shards: int, strata: int, carry: list[Column] | None) -> tuple[DataFrame, int]:
    """(_row, _set, _j, _size, _source_size, _target, _picks) for each row, and the number of shards."""
    spark = docs.sparkSession
    size, key = word_count(column(text_col)), _source_key(column(source_col))
    id_ = F.coalesce(F.concat(F.lit("v"), column(id_col).cast("string")), F.lit(""))
    same = F.xxhash64(key, id_, F.coalesce(column(text_col), F.lit("")), F.lit(seed))
    # the input's columns travel in one struct, so that their names can't clash with those used here
    full = docs.select(F.struct(*(carry or ["*"])).alias("_row"), same.alias("_set"), size.alias("_size"), key.alias("_key"))
    light = materialize(full if carry else full.drop("_row"), "mix")
    repeated = light.groupBy("_set").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_set")
    repeated = materialize(repeated, "mix")
    repeated = None if repeated.isEmpty() else repeated
    light = _numbered(light, repeated)
    if repeated is not None:
        light = materialize(light, "mix")

    sources = materialize(light.groupBy("_key").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_n")), "mix")
    n_sources = sources.count()
    sources = with_targets(_ranked(sources, n_sources), weights)
    passes = F.when(F.col("_size") > 0, F.least(F.floor(F.col("_target") / F.col("_size")), F.lit(MAX_RATIO))).otherwise(0).cast("int")
    rest = F.when(F.col("_passes") < MAX_RATIO, F.rint(F.col("_target") - F.col("_passes") * F.col("_size"))).otherwise(0).cast("long")
    most = F.ceil(F.log2(F.col("_n") / docs_per_block))
    bits = F.greatest(F.lit(0), F.least(most, F.greatest(F.lit(BITS), F.ceil(F.log2("_n") / 2)))).cast("int")
    # sources are the strata of the tree if they are few; else hashed groups of them, whose draws are permuted together
    stratum = F.col("_place") if n_sources <= strata else F.pmod(F.xxhash64("_key"), F.lit(strata))
    sources = sources.withColumn("_passes", passes).withColumn("_rest", rest).withColumn("_bits", bits).withColumn("_stratum", stratum.cast("int"))
    sources = materialize(sources.select("_key", F.col("_size").alias("_source_size"), "_target", "_passes", "_rest", "_bits", "_stratum"), "mix")

    hash_ = F.xxhash64("_set", "_j", F.lit(seed))
    block = F.when(F.col("_bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(_hash, 64 - greatest(_bits, 1))")).cast("long")
    # order within a source: unsigned order of the hash, which is block order
    place = {"_block": block, "_rank": F.expr("_hash ^ shiftleft(1L, 63)")}
    placed = light.withColumn("_hash", hash_).join(_small(sources, n_sources), "_key").withColumns(place)
    blocks = placed.groupBy("_key", "_block", "_rest", "_passes", "_stratum").agg(F.sum("_size").alias("_words"))
    in_order = Window.partitionBy("_key").orderBy("_block")
    blocks = materialize(blocks.withColumn("_before", F.sum("_words").over(in_order) - F.col("_words")), "mix")

    # the block in which the last pass ends; in it, its documents up to the cut, and those around it, of which some are chosen
    edges = blocks.where("_rest > 0 and _before <= _rest and _before + _words > _rest").select("_key", F.col("_block").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_room"))
    inside = placed.join(_small(edges, n_sources), "_key").where("_block = _edge")
    in_rank = Window.partitionBy("_key").orderBy("_rank", "_set", "_j")
    inside = inside.select("_key", "_edge", "_room", "_rank", "_set", "_j", "_size", F.sum("_size").over(in_rank.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), F.row_number().over(in_rank).alias("_at"))
    middle = F.max(F.when(F.col("_run") <= F.col("_room"), F.col("_at")).otherwise(0)).over(Window.partitionBy("_key"))
    inside = inside.withColumn("_middle", middle).where(F.abs(F.col("_at") - F.col("_middle")) <= AROUND)
    around = inside.groupBy("_key", "_edge", "_room").agg(F.sort_array(F.collect_list(F.struct("_at", "_rank", "_set", "_j", "_size", "_run"))).alias("_docs"))
    last = materialize(_chosen(around.select("_key", "_edge", "_docs", "_room")), "mix")

    # draws: every block in the whole passes, and those up to the boundary in the last
    draws = blocks.join(_small(last.select("_key", "_edge"), n_sources), "_key", "left").select("_key", "_block", "_stratum", F.explode(F.sequence(F.lit(0), F.col("_passes"))).alias("_pass"), "_passes", "_edge", "_rest")
    draws = draws.where("_pass < _passes or (_rest > 0 and (_edge is null or _block <= _edge))")
    permuted = Window.partitionBy("_stratum").orderBy(F.xxhash64(F.lit(seed + 1), "_key", "_pass", "_block"), "_key", "_pass", "_block")
    draws = materialize(draws.select("_key", "_block", "_pass", "_stratum", (F.row_number().over(permuted) - 1).alias("_n")), "mix")
    counts = {r["_stratum"]: r.n for r in draws.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    shards = min(max_shards, max(1, -(-sum(counts.values()) // draws_per_shard)))
    quotas = split_quotas(np.array([counts[k] for k in names], dtype=np.int64), shards, np.random.default_rng(seed))
    # where the draws of each shard end: ``strata * max_shards`` numbers at most
    ends = spark.sparkContext.broadcast(dict(zip(names, np.cumsum(quotas, axis=0).T, strict=True)))

    @F.pandas_udf("int")
    def shard(stratum: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(n), np.int32)
        values, at = np.unique(stratum.to_numpy(), return_inverse=True)
        for i, s in enumerate(values.tolist()):
            own = at == i
            out[own] = np.searchsorted(ends.value[s], n.to_numpy()[own], "right")
        return pd.Series(out)

    dealt = draws.select("_key", "_block", F.struct("_pass", shard("_stratum", "_n").alias("_shard")).alias("_draw"))
    by_block = dealt.groupBy("_key", "_block").agg(F.sort_array(F.collect_list("_draw")).alias("_draws")).select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), "_draws")

    rows = light if carry else _numbered(full, repeated)
    known = sources.drop("_stratum", "_rest").join(last, "_key", "left")
    out = rows.withColumn("_hash", hash_).join(_small(known, n_sources), "_key").withColumns(place)
    out = out.join(by_block, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    in_last = F.expr("_edge is null or _block < _edge or (_block = _edge and (coalesce(_rank <= _cut, false) or array_contains(_taken, struct(_rank, _set, _j))))")
    drawn = F.coalesce("_draws", F.expr("cast(array() as array<struct<_pass:int,_shard:int>>)"))
    picks = F.filter(drawn, lambda d: (d["_pass"] < F.col("_passes")) | in_last)
    return out.select("_row", "_set", "_j", "_size", "_source_size", "_target", picks.alias("_picks")), shards


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    seed: int = 7,
    docs_per_block: int = 16,
    draws_per_shard: int = 256,
    max_shards: int = 4096,
    strata: int = 1024,
    carry: list[Column] | None = None,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_picks``.

    ``mix_picks`` is an array of (_pass, _shard), one for each time that the mix takes the document; empty
    where it does not. Input columns of these names are replaced, all others pass through, or the expressions in ``carry`` do in their
    place. Sizes are words of the whole text, however long; null and empty texts have size 0 and count as documents of
    their source. Null is a source of its own, the last. A source of size 0 has target 0, and no pass of it is drawn.
    Rows that repeat an id, null ids too, are told apart by their texts, and rows that repeat source, id and text by a number,
    so that each is drawn by itself. The same input gives the same picks. An empty table gives an empty result.
    """
    docs = docs.select(*[column(c) for c in docs.columns if c not in OUTPUT])
    out, _ = _picked(docs, id_col, text_col, source_col, weights, seed, docs_per_block, draws_per_shard, max_shards, strata, carry)
    return out.select("_row.*", F.col("_size").alias("mix_size"), F.col("_source_size").alias("mix_source_size"), F.col("_target").alias("mix_target"), F.col("_picks").alias("mix_picks"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, seed: int = 7, docs_per_block: int = 16, draws_per_shard: int = 256, max_shards: int = 4096, strata: int = 1024, partitions: int | None = None) -> DataFrame:
    """The mix as rows with all columns of ``docs``, whatever their names: a document comes as often as it is taken.

    Nulls, empty texts and repeated rows are as in ``mix``. Rows of a shard lie together, in an order shuffled by a seeded hash, and shards
    are dealt to partitions evenly and in order.
    """
    out, shards = _picked(docs, id_col, text_col, source_col, weights, seed, docs_per_block, draws_per_shard, max_shards, strata, None)
    taken = out.select("_row", "_set", "_j", F.explode("_picks").alias("_pick"))
    taken = taken.select("_row", F.col("_pick._shard").alias("_shard"), F.xxhash64(F.lit(seed + 2), "_pick", "_set", "_j").alias("_at"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("_shard") * n / shards) if shards >= n else F.col("_shard")
    return taken.repartitionById(min(n, shards), part.cast("int")).sortWithinPartitions("_shard", "_at").select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; also copies and the first shard."""
    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=[F.col("doc_id")])
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_picks")).alias("taken"),
        F.size("mix_picks").alias("copies"),
        F.when(F.size("mix_picks") > 0, F.col("mix_picks")[0]["_shard"]).alias("first_shard"),
    )

"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only built-in expressions are used. The first two levels count hashes, by map-side combined aggregates. Keys of length and prefix that
occur more than once set bits of a filter of fixed size, which is broadcast: a row whose bit is set has its full text hashed
where it lies, no other is, and from then on only hashes move. Keys that share a bit cost a hash and no more: full hashes
alone decide. Joins have plain exchanges on both sides, so adaptive execution can split a partition that a hot group fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import column, materialize, read_table

OUTPUT = ("keep_id", "group_size", "kept")
#: Code points of the prefix that the second level hashes.
PREFIX_CHARS = 256
#: Bits of the filter: at most 4 MB, in rows of 2 ** 15 bits. With as many repeated keys or more, all texts are hashed in full.
FILTER_BITS = 1 << 25


def _judged(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, carry: list[Column] | None) -> DataFrame:
    """(_row, keep_id, group_size, kept): what is carried of each row is in one struct, so that its names can't clash with those used here."""
    others = [column(c) for c in docs.columns if c not in (id_col, text_col)]
    # tells rows that repeat id and text apart
    mark = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(F.struct(*(carry or ["*"])).alias("_row"), column(id_col).alias("_id"), text.alias("_text"), mark.alias("_mark"))
    length = F.octet_length("_text").cast("long")
    rows = rows.withColumns({"_len": length, "_key": F.xxhash64(length, F.xxhash64(F.substring("_text", 1, prefix_chars)))})

    light = materialize(rows.select("_len", "_key"), "dedup")
    # Level 1: lengths that repeat. They are cast after counting: the join below then has an exchange of its own
    # on this side, which adaptive execution needs to split a hot partition of the other side.
    lengths = light.groupBy(F.col("_len").cast("int").alias("_n")).count().where("count > 1").select(F.col("_n").cast("long").alias("_len"))
    # Level 2: prefixes that repeat among them, as bits
    keys = light.join(lengths, "_len", "left_semi").groupBy("_key").count().where("count > 1")
    slot = F.pmod("_key", F.lit(FILTER_BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    bits = F.broadcast(materialize(bits, "dedup"))  # FILTER_BITS / 2 ** 15 rows at most
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(_byte, _bit)").bitwiseAND(1) == 1, F.lit(False))
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(bits, "_bucket", "left").withColumns({"_byte": byte, "_bit": (at % 8).cast("int")}).withColumn("_maybe", maybe)
    # Level 3: full hashes of what is left
    full = rows.where("_maybe").select("_id", "_mark", F.sha2("_text", 256).alias("_hash"))
    survivors = materialize(full.groupBy("_id", "_hash", "_mark").agg(F.count(F.lit(1)).alias("n")), "dedup")
    groups = survivors.groupBy("_hash").agg(F.max("_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1").select(F.unhex("_hash").alias("_group"), "keep_id", "group_size")
    sets = survivors.groupBy("_id", "_hash").agg(F.sum("n").alias("_same"), F.min("_mark").alias("_first"), F.min_by("n", "_mark").alias("_ties"))
    verdicts = sets.withColumn("_group", F.unhex("_hash")).join(groups, "_group").select(F.col("_id").alias("_vid"), F.col("_hash").alias("_vhash"), "keep_id", "group_size", "_same", "_first", "_ties")
    verdicts = materialize(verdicts, "dedup")
    most = verdicts.agg(F.max("_same").alias("same"), F.max("_ties").alias("ties")).first()

    # rows without a set bit have their key in the place of the hash, which matches none
    out = rows.select("_row", "_id", "_mark", F.spark_partition_id().alias("_pid"), F.when(F.col("_maybe"), F.sha2("_text", 256)).otherwise(F.col("_key").cast("string")).alias("_hash"))
    out = out.join(verdicts.hint("merge"), F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_hash") == F.col("_vhash")), "left")
    keep_id = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("_id"))
    kept = F.col("_id").eqNullSafe(keep_id)
    if (most["same"] or 1) > 1:
        kept = kept & (F.coalesce("_same", F.lit(1)) == 1) | (kept & (F.col("_mark") == F.col("_first")))
    result = lambda frame, kept: frame.select("_row", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))
    if (most["ties"] or 1) < 2:
        return result(out, kept)
    # rows alike in all columns: one of them. Each task of the scan puts one forward, and of these one is taken
    tied = F.coalesce((F.col("_ties") > 1) & (F.col("_mark") == F.col("_first")), F.lit(False))
    own = Window.partitionBy("_id", "_hash", "_pid").orderBy("_mark")
    among = Window.partitionBy("_id", "_hash", F.when(F.col("_own") == 1, F.lit(-1)).otherwise(F.col("_pid"))).orderBy("_pid")
    one = out.where(tied).withColumn("_own", F.row_number().over(own)).withColumn("_place", F.row_number().over(among))
    return result(out.where(~tied), kept).unionByName(result(one, kept & (F.col("_own") == 1) & (F.col("_place") == 1)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, carry: list[Column] | None = None) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` (long) and ``kept`` (boolean) for each row.

    Texts are equal when identical, however long; null counts as the empty text. Of equal texts the row with the
    largest id stays. Empty texts form one group. A null id is smaller than any other and stays only
    where all ids of its group are null. Of rows that repeat both id and text exactly one is kept, that whose other columns
    have the least hash, and each counts in ``group_size``. Input columns named like the output columns are replaced; all
    others pass through, or the expressions in ``carry`` do in their place. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in OUTPUT]
    return _judged(docs.select(*map(column, kept)), id_col, text_col, prefix_chars, carry).select("_row.*", *OUTPUT)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all columns of ``docs`` as they are, whatever their names."""
    return _judged(docs, id_col, text_col, PREFIX_CHARS, None).where("kept").select("_row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return exact_dedup(docs, carry=[F.col("doc_id"), digest]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

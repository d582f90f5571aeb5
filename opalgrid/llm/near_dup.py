"""Near duplicates by b-bit MinHash over sets of five-word shingles.

1. Each text becomes the set of its hashed shingles. Texts with the same set form a class, which the text of the least
   id represents; only classes go on.
2. A representative's minima under ``MINIMA`` hash functions are taken. The first ``BANDS * ROWS`` of them form
   band keys; of all of them the low ``2`` bits are kept and packed into two bit planes.
3. Rows are dealt by band key. Within a bucket, the share of equal low bits, corrected for chance
   collisions, estimates similarity by bit counts. A breadth-first search over estimates of at least
   ``MARGIN`` gives a spanning forest: one row per member at most, however large the bucket.
   Buckets with very many members are found by a sketch and taken for families, whose estimates step 5 makes in blocks.
4. Components of these links are families. Every pair that shares a bucket and whose estimate reaches
   ``MARGIN`` lies in one family. A small family goes to one task, with its full sets, which searches
   breadth-first over exact similarities, so that no pair is left untested unless it is connected already.
5. In a large family, the member with most estimated links is the hub, and all others are compared with it, block by
   block; then a next hub takes what is left, as long as hubs link much. What is not linked by then meets all others by
   signature, in pairs of blocks, and full sets only where an estimate reaches ``MARGIN``.
   Components of the exact links are the result.

A pair of similarity 0.75 is missed if no band agrees (chance (1 - 0.75**4)**36 = 1e-6) or if its estimate, of
standard deviation 0.038, is 0.2 too low (chance 1e-7).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _forest, connected_components
from .store import column, materialize, read_table, small_batches, tidy

WORDS = 5
PERCENT = 75
BANDS, ROWS = 36, 4
MINIMA = 192
MARGIN = 0.55
#: Members of a family that a task compares with each other, or with as many others, by full sets, and by signatures.
BLOCK, WIDE_BLOCK = 128, 1024
#: Above this size, the members of a bucket are taken for one family, whose signatures are compared in blocks instead.
LARGEST_BUCKET = 20_000
#: Band keys that are looked for as hot ones, and how many the sketch tracks for that.
HOT_KEYS, TRACKED_KEYS = 1000, 20_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_RNG = np.random.default_rng(20)
_SALTS = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)


class WordHashes(dict):
    """64-bit hashes of words; emptied at ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += own[i : i + n] * _MIX[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(found: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under each hash function."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, ((x[None, lo : lo + 2048] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> list[int]:
    rows = np.ascontiguousarray(least[: BANDS * ROWS].reshape(BANDS, ROWS))
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) - 2**63 for b in range(BANDS)]


def low_bits(least: np.ndarray) -> bytes:
    """The two low bits of each mixed minimum, as two packed planes."""
    mixed = least * np.uint32(0x9E3779B1)
    planes = np.stack([mixed >> np.uint32(31), (mixed >> np.uint32(30)) & np.uint32(1)]).astype(np.uint8)
    return np.packbits(planes, axis=1).tobytes()


def planes(packed: list[bytes]) -> np.ndarray:
    """Packed signatures as an array (signature, plane, 64-bit words)."""
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), 2, MINIMA // 64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities of one signature with many: the share of equal two-bit values, less chance collisions."""
    differ = np.bitwise_count((one[0] ^ many[:, 0]) | (one[1] ^ many[:, 1])).sum(axis=-1)
    return (1 - differ / MINIMA - 0.25) / 0.75


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * size of the intersection >= PERCENT * size of the union."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _spanning(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what estimates of at least MARGIN connect."""
    left, out = np.arange(len(signatures)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = estimates(signatures[x], signatures[left]) >= MARGIN
            found = left[near].tolist()
            left = left[~near]
            out += [(x, y) for y in found]
            queue += found
    return out


def _exact_links(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what exact similarities connect.

    Members with one label are known to be connected. Where there are two sides, only pairs across them count. No pair is left untested
    unless it is connected already or its estimate is below MARGIN.
    """
    root, out = np.unique(label, return_inverse=True)[1], []
    across = bool((side != side[0]).any())
    for x in range(len(sets) - 1):
        try_ = root[x + 1 :] != root[x]
        if across:
            try_ &= side[x + 1 :] != side[x]
        if not try_.any():
            continue
        try_[try_] = estimates(signatures[x], signatures[x + 1 :][try_]) >= MARGIN
        for y in (np.flatnonzero(try_) + x + 1).tolist():
            if root[y] != root[x] and similar(sets[x], sets[y]):
                out.append((x, y))
                root[root == root[y]] = root[x]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, id, side, label, block, bits, component) in group order to (component, lo, hi, id): the pairs of blocks for which a
    member has to be compared, as it has a partner there of another label by estimate."""
    for table, cuts, _ in _runs(batches):
        ids, side, label, block = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
        bits = planes(table.column(5).to_pylist())
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, s, b, sig = label[lo:hi], side[lo:hi], block[lo:hi], bits[lo:hi]
            across = bool((s != s[0]).any())
            if (own == own[0]).all():
                continue
            kinds, b = np.unique(b, return_inverse=True)
            meets = np.zeros((hi - lo, len(kinds)), bool)  # whether a member has a partner in a block
            for x in range(hi - lo - 1):
                try_ = own[x + 1 :] != own[x]
                if across:
                    try_ &= s[x + 1 :] != s[x]
                near = np.flatnonzero(try_)
                near = near[estimates(sig[x], sig[x + 1 :][near]) >= MARGIN] + x + 1
                meets[x, b[near]] = True
                meets[near, b[x]] = True
            component, (x, other) = table.column(6)[lo].as_py(), np.nonzero(meets)
            rows = zip(kinds[np.minimum(b[x], other)].tolist(), kinds[np.maximum(b[x], other)].tolist(), ids[lo + x].tolist(), strict=True)
            yield _columns([(component, *r) for r in rows], [pa.int64(), pa.int32(), pa.int32(), pa.int64()], ["component", "lo", "hi", "id"])


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc, mark, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = shingles(text, hashes)
            if len(found):
                least = minima(found)
                rows.append((doc, mark, len(found), xxhash.xxh128_digest(found.tobytes()), low_bits(least), band_keys(least)))
            else:
                rows.append((doc, mark, 0, None, None, None))
        yield _columns(rows, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())], ["doc_id", "mark", "n_shingles", "class", "bits", "bands"])


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Tables of whole runs of equal first columns, with the places where runs start and the end.

    A run of over ``most`` rows comes in parts, each of which starts with the last row of the one before; the
    flag tells that the first run of a table goes on from a part.
    """
    rest: list[pa.RecordBatch] = []
    held, parted = 0, None

    def out() -> tuple[pa.Table, np.ndarray, bool]:
        table, cuts = _cut(pa.Table.from_batches(rest))
        return table, cuts, parted is not None and int(table.column(0)[0].as_py()) == parted

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last == 0 and rest and rest[-1].column(0)[-1].as_py() == int(key[0]):
            rest.append(batch)
            held += batch.num_rows
            if most is not None and held > most:
                yield out()
                parted, rest, held = int(key[0]), [batch.slice(batch.num_rows - 1)], 1
            continue
        if last:
            rest.append(batch.slice(0, last))
        if rest:
            yield out()
        rest, held = [batch.slice(last)], batch.num_rows - last
    if rest:
        yield out()


def _cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    key = table.column(0).to_numpy()
    return table, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band key, id, packed bits) in key order to links of estimates."""
    for table, cuts, parted in _runs(batches, LARGEST_BUCKET):
        sizes = np.diff(cuts)
        many = np.repeat(sizes > 1, sizes)
        if not many.any():
            continue
        parted = parted and sizes[0] > 1
        table = table.filter(pa.array(many))
        ids = table.column(1).to_numpy()
        bits = planes(table.column(2).to_pylist())
        sizes = sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        chain = sizes > LARGEST_BUCKET
        chain[0] |= parted
        two = starts[(sizes == 2) & ~chain]
        differ = np.bitwise_count((bits[two, 0] ^ bits[two + 1, 0]) | (bits[two, 1] ^ bits[two + 1, 1])).sum(axis=-1)
        two = two[(1 - differ / MINIMA - 0.25) / 0.75 >= MARGIN]
        a, b = [ids[two]], [ids[two + 1]]
        for at, n in zip(starts[chain].tolist(), sizes[chain].tolist(), strict=True):
            a.append(ids[at : at + n - 1])
            b.append(ids[at + 1 : at + n])
        rest = (sizes > 2) & ~chain
        for at, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True):
            pairs = np.array(_spanning(bits[at : at + n]), np.int64).reshape(-1, 2) + at
            a.append(ids[pairs[:, 0]])
            b.append(ids[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["id", "set", *batch.schema.names[2:]])


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, id, side, label, set, bits) in group order to exact links."""
    for table, cuts, _ in _runs(batches):
        rows = []
        ids, side, label = table.column(1).to_pylist(), table.column(2).to_numpy(), table.column(3).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column(4).to_pylist()]
        bits = planes(table.column(5).to_pylist())
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows += [(ids[lo + i], ids[lo + j]) for i, j in _exact_links(sets[lo:hi], bits[lo:hi], side[lo:hi], label[lo:hi])]
        yield _columns(rows, [pa.int64(), pa.int64()], ["a", "b"])


def _family_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the exact links of a task connect, found in the worker that finds the links: a second one would keep its memory too."""
    return _forest(_family_links(batches))


def _compared(grouped: DataFrame, partitions: int) -> DataFrame:
    """The exact links within each group of rows (group, id, side, label, set, bits), as forests of tasks."""
    grouped = grouped.select("group", "id", "side", "label", "set", "bits")
    return grouped.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(tidy(_family_forest), "u long, v long").toDF("a", "b")


def _likely_links(reps: DataFrame, partitions: int) -> DataFrame:
    """Links that connect what shares a bucket and is alike by estimate."""
    keyed = reps.select(F.explode("bands").alias("key"), "doc_id", "bits")
    top = keyed.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {TRACKED_KEYS})").alias("top")).first()["top"] or []
    hot = [r["item"] for r in top if r["count"] > LARGEST_BUCKET]
    if not hot:
        return keyed.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(tidy(_bucket_links), "a long, b long").distinct()
    # HOT_KEYS rows at most
    keys = F.broadcast(reps.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
    rows = keyed.select("key", "doc_id").join(keys, "key", "left_semi")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    stars = rows.join(F.broadcast(least), "key").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    rest = keyed.join(keys, "key", "left_anti").repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(tidy(_bucket_links), "a long, b long")
    return rest.unionByName(stars).distinct()


def _large_family_links(sets: DataFrame, likely: DataFrame, partitions: int) -> DataFrame:
    """Exact links of families of several blocks; ``sets`` has (id, set, component, _blocks, _block, bits)."""
    ends = likely.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rest = materialize(sets.select("id", "component").join(ends, "id"), "near")
    links, left = None, rest.count()
    while True:
        # the member with most likely links is the hub, and all that are not linked yet are compared with it
        hubs = rest.groupBy("component").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub")).select(F.bitwise_not("component").alias("k"), "hub")
        hubs = materialize(hubs, "near")
        found = sets.join(rest.select("id"), "id", "left_semi").withColumn("k", F.bitwise_not("component")).join(hubs, "k")
        hub_rows = found.where("id = hub").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("side", F.lit(1))
        star = found.where("id <> hub").withColumn("side", F.lit(0)).unionByName(hub_rows)
        star = materialize(_compared(star.withColumns({"group": F.xxhash64("component", F.lit("hub"), "_block"), "label": F.col("id")}), partitions), "near")
        links = star if links is None else links.unionByName(star)
        linked = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rest = rest.join(linked, "id", "left_anti").join(hubs.select(F.col("hub").alias("id")), "id", "left_anti")
        rest = materialize(rest, "near")
        before, left = left, rest.count()
        # another round while one links a tenth of what is left
        if not left or 10 * (before - left) < before:
            break

    # what is linked has a label in common; members of other labels are compared by signatures, in pairs of wide blocks, ...
    labels = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
    members = materialize(sets.select("id", "component", "_blocks", "_block", "bits").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "near")
    wide = F.ceil(F.col("_blocks") * BLOCK / WIDE_BLOCK).cast("int")
    dealt = members.withColumn("_wides", wide).withColumn("_wide", F.pmod(F.xxhash64("id", F.lit(2)), F.col("_wides")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_wides") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("component", F.least("_wide", "_other"), F.greatest("_wide", "_other")))
    side = F.when(F.col("_wide") == F.col("_other"), 0).otherwise((F.col("_wide") > F.col("_other")).cast("int"))
    dealt = dealt.select("group", "id", side.alias("side"), "label", F.col("_block").alias("block"), "bits", "component").repartition(partitions, "group").sortWithinPartitions("group")
    pairs = dealt.mapInArrow(tidy(_candidates), "component long, lo int, hi int, id long").distinct()
    # ... and full sets go only where a member has a likely partner of another label
    rows = pairs.select("component", "lo", "hi", "id").join(members.select("id", "label", "_block"), "id").join(sets.select("id", "set", "bits"), "id")
    rows = rows.withColumns({"group": F.xxhash64("component", "lo", "hi"), "side": ((F.col("lo") < F.col("hi")) & (F.col("_block") == F.col("hi"))).cast("int")})
    return links.unionByName(_compared(rows, partitions))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for each row; ``mark`` is a hash of its text."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(column(id_col).cast("long").alias("_id"), _mark(text_col).alias("_mark"), column(text_col).alias("_text"))
    signed = materialize(texts.mapInArrow(tidy(_signed), "doc_id long, mark long, n_shingles long, class binary, bits binary, bands array<long>"), "near")
    # a class of equal sets is a node, whose text is that of its least id
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least")
    classes = signed.where("class is not null").groupBy("class").agg(least, F.any_value("bits").alias("bits"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "class", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"), "bits", "bands"), "near")
    reps = classes.select(F.col("node").alias("doc_id"), "bits", "bands")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    likely = materialize(_likely_links(reps, n), "near")
    families = materialize(connected_components(likely), "near")
    small_batches(spark)

    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(F.bitwise_not("component").alias("k"), "size")
    members = families.withColumn("k", F.bitwise_not("component")).join(sizes, "k")
    blocks = F.when(F.col("size") <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    members = members.select("node", "component", blocks.alias("_blocks"))
    members = members.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    members = members.join(classes.select("node", "rep", F.col("mark").alias("_m"), "bits"), "node")
    work = texts.join(members, (F.col("_mark") == F.col("_m")) & F.col("_id").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    work = work.select("node", "_text", "component", "_blocks", "_block", "bits")
    sets = materialize(work.mapInArrow(tidy(_full_sets), "id long, set binary, component long, _blocks int, _block int, bits binary"), "near")
    small = sets.where("_blocks = 1").withColumns({"group": F.col("component"), "side": F.lit(0), "label": F.col("id")})
    links = _compared(small, n)
    large = sets.where("_blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_large_family_links(large, likely, n))
    parts = connected_components(links, forests=True)

    # the least id of all classes of a component
    named = classes.select("node", "class", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.bitwise_not("component").alias("k"), "component_id")
    named = named.withColumn("k", F.bitwise_not("component")).join(ids, "k")
    # an exchange of its own on either side lets adaptive execution split a class of very many copies
    named = materialize(named.select(F.hex("class").alias("c"), "component_id", F.lit(True).alias("known")), "near")
    out = signed.select("doc_id", "mark", "n_shingles", F.coalesce(F.hex("class"), F.col("mark").cast("string")).alias("c"))
    out = out.join(named, "c", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(column(text_col), F.lit("")))


def _kept():
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are lower-cased (A-Z) runs without ASCII white space. Texts with fewer than five words are one
    shingle; texts without words, null texts too, have none and are linked with nothing. Texts of any length are taken whole. Rows are told
    apart by their texts: each has the component of its own text, whatever else its id stands for. A component is named by its least id;
    rows without an id have the name of their component too, null where none of it has an id, and are kept in that case alone. An empty table gives an empty
    result.
    """
    return _judged(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller id, with the columns of ``docs``.

    Rows that repeat a kept id and its text all stay: they are the same document to this operator. Rows without an id stay where nobody in their component has
    one, and so do null and empty texts. Columns pass through whatever their names. An empty table gives an empty result.
    """
    gone = _judged(docs, id_col, text_col).where(~_kept()).select(F.col("doc_id").alias("__opal_id"), F.col("mark").alias("__opal_mark")).distinct()
    gone = materialize(gone, "near")
    same = (_mark(text_col) == F.col("__opal_mark")) & column(id_col).cast("long").eqNullSafe(F.col("__opal_id"))
    return docs.join(gone, same, "left_anti")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM texts
), sized AS (
    SELECT doc_id, s, len(s) AS n FROM sets
), classes AS (
    SELECT min(doc_id) AS rep, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY list_sort(s)
), parts AS (
    SELECT rep, n, unnest(s) AS x FROM classes
), links AS (
    SELECT a.rep AS a, b.rep AS b FROM parts a JOIN parts b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), ends AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(rep, root) AS (
    SELECT rep, rep FROM classes UNION SELECT ends.b, reach.root FROM reach JOIN ends ON reach.rep = ends.a
), roots AS (
    SELECT rep, min(root) AS root FROM reach GROUP BY rep
), named AS (
    SELECT d.doc_id, d.n, coalesce(r.root, d.doc_id) AS component FROM sized d
    LEFT JOIN classes c ON list_sort(d.s) = list_sort(c.s) AND d.n > 0 LEFT JOIN roots r ON r.rep = c.rep
)
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM named
"""

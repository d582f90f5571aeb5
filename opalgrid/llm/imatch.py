"""Document fingerprints by I-Match over randomised lexicons.

Terms are counted by documents over the whole corpus, each by its 64-bit hash. The lexicon is the terms whose inverse document
frequency, as a share of that of a term of one document, lies within ``BAND``. A fingerprint is the hashes of a text's sorted distinct lexicon terms
that fall into each of ``len(SEEDS) * LEVELS + 1`` subsets of the lexicon: the whole one, and for each seed nested random halves,
quarters and so on, so that some subset holds a few terms of any text, short or long. Texts without
a term of the lexicon are represented by all their terms.

A lexicon of up to ``BROADCAST_TERMS`` terms is broadcast. Of a larger one, each task gets the terms that occur in its own documents, by a
join; the fingerprints are the same.

Likeness of two fingerprints is an estimate of the resemblance of the term sets: how often subsets
agree tells the size of the sets' difference, how often both are empty that of their union.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, materialize, read_table, small_batches

#: Terms of a lexicon that is broadcast, at most: 64 MB.
BROADCAST_TERMS = 1 << 23
#: Hashes that a task holds before it counts them.
COUNTED = 1 << 22
BAND = (0.1, 0.95)
SEEDS = (11, 23, 37, 41, 59, 67, 83)
LEVELS = 13
HEX = 5
_STRIP = ".,;:!?\"'()[]{}<>#$%&*|=+/\\-_"
_C = np.uint64(0xBF58476D1CE4E5B9)
_SALTS = np.array([xxhash.xxh64_intdigest(str(s)) for s in SEEDS], np.uint64)


class Terms(dict):
    """64-bit hashes of terms by word as written; emptied at ``most`` words. Words without letters or digits have 0, other terms have not."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        term = word.lower().strip(_STRIP)
        found = self[word] = (xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) or 1) if term else 0
        return found


def word_hashes(text: str, terms: Terms) -> np.ndarray:
    """A hash for each word of a text, in order."""
    words = text.split()
    return np.fromiter(map(terms.__getitem__, words), np.uint64, len(words))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes, without the 0 of words that are no terms."""
    found = np.unique(hashes)
    return found[1:] if len(found) and found[0] == 0 else found


def term_hashes(text: str, terms: Terms) -> np.ndarray:
    """The sorted distinct hashes of a text's terms."""
    return distinct(word_hashes(text, terms))


def edited_hashes(head: str, own: np.ndarray, tail: str, other: np.ndarray, terms: Terms) -> np.ndarray:
    """Word hashes of ``head + tail``, beginnings of two texts whose word hashes are known.

    Only the last words of either, and the word across the seam, are looked up.
    """
    a, b = head.split(), tail.split()
    if not a or not b:
        return word_hashes(head + tail, terms)
    seam, skip = [a[-1]], 0
    if not head[-1].isspace() and not tail[0].isspace():
        seam, skip = [a[-1] + b[0]], 1
    if len(b) > skip:
        seam_end = [b[-1]]
        middle = other[skip : len(b) - 1]
    else:
        seam_end, middle = [], other[:0]
    look = lambda words: np.fromiter(map(terms.__getitem__, words), np.uint64, len(words))
    return np.concatenate([own[: len(a) - 1], look(seam), middle, look(seam_end)])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many documents each term occurs, by its hash; term 0 has the number of documents."""
    small_batches(docs.sparkSession)

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, size = Terms(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += [np.zeros(1, np.uint64), term_hashes(text or "", terms)]
                size += len(held[-1]) + 1
                if size > COUNTED:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    return docs.select(column(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term): the terms of the band. Null and empty texts have no terms but count as documents; texts of any length count once.

    A term of one document is never in the band. An empty table gives an empty lexicon.
    """
    counted = materialize(document_frequencies(docs, text_col), "imatch")  # used twice
    total = counted.where("term = 0").agg(F.sum("n")).first()[0] or 0
    share = F.log(total / F.col("n")) / float(np.log(max(total, 2)))
    return materialize(counted.where((F.col("term") != 0) & (F.col("n") > 1) & share.between(*band)).select("term"), "imatch")


_LIMITS = np.uint64(1) << np.arange(63, 63 - LEVELS, -1, dtype=np.uint64)
_NO_TERM = "0" * HEX


def fingerprint(hashes: np.ndarray, lexicon: np.ndarray) -> str:
    """The subset hashes of sorted distinct terms, as text; the lexicon is sorted."""
    own = hashes
    if len(lexicon) and len(hashes):
        own = hashes[lexicon[np.minimum(lexicon.searchsorted(hashes), len(lexicon) - 1)] == hashes]
    if not len(own) or not len(lexicon):
        own = hashes
    mixed = (own[None, :] ^ _SALTS[:, None]) * _C
    mixed ^= mixed >> np.uint64(29)
    mixed *= _C
    # the terms of all subsets in a row, those of a subset in their order
    inside = mixed[:, None, :] < _LIMITS[:, None]
    joined = memoryview(own[np.nonzero(inside)[2]].tobytes())
    out, at = [xxhash.xxh3_64_hexdigest(own.tobytes())[:HEX]], 0
    for sizes in (8 * inside.sum(axis=2)).tolist():
        for level, size in enumerate(sizes, 1):
            out.append(xxhash.xxh3_64_hexdigest(joined[at : at + size], level)[:HEX] if size else _NO_TERM)
            at += size
    return "".join(out)


_RATES = 0.5 ** np.arange(1, LEVELS + 1)
_SIZES = 2.0 ** (np.arange(-16, 129) / 8)
_NONE = -np.outer(_RATES, _SIZES)  # log chance that a subset has none of so many terms
_SOME = np.log(-np.expm1(_NONE))


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """Estimated resemblances of the term sets of pairs of fingerprints, 0 to 1; 1 where they are equal."""
    if not a:
        return np.zeros(0)
    n = len(SEEDS)
    x, y = (np.frombuffer("".join(t).encode(), f"S{HEX}").reshape(len(t), -1)[:, 1:].reshape(len(t), n, LEVELS) for t in (a, b))
    empty = _NO_TERM.encode()
    differ = (x != y).sum(axis=1)
    some = ((x != empty) | (y != empty)).sum(axis=1)
    best = lambda hits: _SIZES[np.argmax(hits @ _SOME + (n - hits) @ _NONE, axis=1)]
    difference = np.where(differ.any(axis=1), best(differ), 0.0)
    out = np.where(some.any(axis=1), np.clip(1 - difference / best(some), 0, 1), 0.0)
    return np.where(np.array(a) == np.array(b), 1.0, out)


def likeness(a: str, b: str) -> float:
    return float(likenesses([a], [b])[0])


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbours(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[list[tuple]]:
    """(part, id, text, its word hashes, the next text, its word hashes) of rows (id, text, part, copy) in order, batch by batch.

    A copy is the first document of the next part, which comes last and is only a neighbour.
    """
    held: tuple | None = None
    for batch in batches:
        out = []
        for doc, text, part, copy in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
            if copy and (held is None or held[0] != part):
                continue
            words = word_hashes(text, terms)
            if held is not None and held[0] == part:
                out.append((*held, text, words))
            held = None if copy else (part, doc, text, words)
        yield out


def _edited_words(own: str, words: np.ndarray, text: str, other: np.ndarray, terms: Terms) -> np.ndarray:
    half = len(own) // 2
    return edited_hashes(own[: len(own) - half], words, text[:half], other, terms)


def _terms_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term) of all terms that a part's fingerprints are made of."""
    terms = Terms()
    for rows in _neighbours(batches, terms):
        found: dict[int, list[np.ndarray]] = {}
        for part, _, own, words, text, other in rows:
            found.setdefault(part, []).extend((words, other, _edited_words(own, words, text, other, terms)))
        for part, hashes in found.items():
            own = distinct(np.concatenate(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(own.view(np.int64))], names=["part", "term"])


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _marked(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    terms, last, mark = Terms(), None, ""  # the last text, which is the next row's own, and its fingerprint
    for rows in _neighbours(batches, terms):
        docs, sizes, digests, own_marks, changed, next_marks = [], [], [], [], [], []
        for _, doc, own, words, text, other in rows:
            own_marks.append(mark if own == last else fingerprint(distinct(words), lexicon))
            last, mark = text, own_marks[-1] if text == own else fingerprint(distinct(other), lexicon)
            next_marks.append(mark)
            changed.append(fingerprint(distinct(_edited_words(own, words, text, other, terms)), lexicon))
            digests.append(hashlib.sha256(edited(own, text).encode("utf-8", "surrogatepass")).hexdigest())
            docs.append(doc)
            sizes.append(len(own))
        columns = [docs, sizes, digests, own_marks, changed, likenesses(own_marks, changed), likenesses(own_marks, next_marks)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _ranges(firsts: list[tuple[int, int]]):
    """A function of (id, hash of the text): the number of the range, and, for the first row of a range, -1 less the number of the range before.

    Ranges begin with the rows in ``firsts``, which are in order; a hash of -2**63 stands for any.
    """
    ids, hashes = (np.array([f[i] for f in firsts], np.int64) for i in (0, 1))

    @F.pandas_udf("array<int>")
    def ranges(at: pd.Series, hash_: pd.Series) -> pd.Series:
        values, marks = at.to_numpy(), hash_.to_numpy()
        lo, own = np.searchsorted(ids, values, "left"), np.searchsorted(ids, values, "right") - 1
        # of several ranges of one id, by the hash
        for i in np.unique(lo[(own > lo) | ((own == lo) & (hashes[np.minimum(lo, len(ids) - 1)] > -(2**63)))]).tolist():
            here = np.flatnonzero((lo == i) & (own >= lo))
            own[here] = i + np.searchsorted(hashes[i : own[here[0]] + 1], marks[here], "right") - 1
        first = (ids[own] == values) & ((hashes[own] == marks) | (hashes[own] == -(2**63)))
        return pd.Series([[int(b), -1 - int((b - 1) % len(ids))] if f else [int(b)] for b, f in zip(own, first, strict=True)])

    return ranges


def fingerprint_neighbours(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint over the lexicon ``terms``, that of its edited text, and likenesses to it and to the next document.

    Documents are dealt by ranges of ids, one to a partition. A range's last document needs the first of the next range, and the
    last of all the first of all: the first document of each range goes to the range before it as well. Texts are moved once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = -(2**63)
    id_, text = column(id_col).cast("long"), F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), F.coalesce(id_, F.lit(least)).alias("_at"), F.xxhash64(text).alias("_hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.min("_at").alias("first"), F.percentile_approx("_at", [i / n for i in range(n)], 10_000).alias("cuts")).first()
    # each cut is an id that exists: the first of its range
    cuts = Counter(found["cuts"] or [])
    firsts = [(x, least) for x in sorted({found["first"], *cuts} - {None})]
    if any(k > 1 for k in cuts.values()):
        # an id with more rows than a range has is cut by the hashes of its texts as well; ranges then begin with the least row that they have
        step = lambda k: (1 << 64) // k
        wanted = sorted({*firsts, *((x, least + i * step(k)) for x, k in cuts.items() for i in range(1, k))})
        ranges = rows.groupBy(_ranges(wanted)("_at", "_hash")[0].alias("r")).agg(F.min(F.struct("_at", "_hash")).alias("first"))
        firsts = sorted((r.first["_at"], r.first["_hash"]) for r in ranges.select(F.col("first")).toLocalIterator())
    n = max(1, len(firsts))

    dealt = rows.withColumn("_to", F.explode(_ranges(firsts)("_at", "_hash")))
    dealt = dealt.select("doc_id", "text", F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to")).alias("_part"), (F.col("_to") < 0).alias("_copy"), "_at", "_hash")
    order = ("_part", "_copy", "_at", "_hash", "text")
    if terms.count() <= BROADCAST_TERMS:
        shared = spark.sparkContext.broadcast(np.sort(np.append(terms.toArrow().column(0).to_numpy().view(np.uint64), np.uint64(0))))
        ordered = dealt.repartitionById(n, "_part").sortWithinPartitions(*order).select("doc_id", "text", "_part", "_copy")
        return ordered.mapInArrow(lambda batches: _marked(batches, shared.value), _RESULT)

    # the lexicon's terms of each part come before its documents
    dealt = materialize(dealt, "imatch")
    ordered = dealt.repartitionById(n, "_part").sortWithinPartitions(*order).select("doc_id", "text", "_part", "_copy")
    own = ordered.mapInArrow(_terms_of_parts, "part int, term long").distinct().join(terms, "term", "left_semi")
    own = own.groupBy("part", F.pmod("term", F.lit(256)).alias("chunk")).agg(F.collect_list("term").alias("terms"))
    first = own.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("part").alias("_part"), F.lit(False).alias("_copy"), F.lit(least).cast("long").alias("_at"), F.lit(least).cast("long").alias("_hash"), "terms")
    both = first.unionByName(dealt.withColumn("terms", F.lit(None).cast("array<long>"))).repartitionById(n, "_part")
    both = both.sortWithinPartitions("_part", F.col("terms").isNull(), "_copy", "_at", "_hash", "text").select("doc_id", "text", "_part", "_copy", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def documents() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of_terms = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
                chunks = batch.column(4).drop_null()
                if len(chunks):
                    held.append(chunks.flatten().to_numpy().view(np.uint64))
                rest = batch.filter(pa.array(~of_terms))
                if rest.num_rows:
                    yield rest

        source = documents()
        first = next(source, None)
        if first is None:
            return
        # a partition is one part: all its terms have come before its first document
        yield from _marked(chain([first], source), np.sort(np.concatenate([np.zeros(1, np.uint64), *held])))

    return both.mapInArrow(run, _RESULT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Null texts are empty; two texts without any terms are alike by 1. A null id comes first in the order. Rows that repeat an id
    follow each other by a hash of their texts; an id with very many rows is cut by these. The only document of a table is its own next. Texts of any length are taken whole. Extra columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    return fingerprint_neighbours(docs, lexicon(docs, text_col), id_col, text_col)


def op2_imatch(spark, sf_dir: str) -> DataFrame:
    """One row per document: lengths, digests, fingerprints and likenesses."""
    return fingerprints(read_table(spark, sf_dir, "documents"))

"""Bounded-space online best-fit packing of token sequences.

Each task packs its own stream of documents, in order, without a shuffle. It holds a fixed number of open
bins, found by a bitset keyed by free space: a piece goes to the open bin with the least free space that
suffices. Where none does, a bin is opened; where all places are taken, the fullest closes first. The bins that are
still open when their tasks end are put together in the same way, those of many tasks in one, the fullest first: what one
holds goes whole behind what another has.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, materialize, read_table, small_batches, tidy

CAPACITY = 4096
OPEN_BINS = 512
#: Open bins of ended tasks that one task puts together, and places of such bins that are broadcast.
MERGED_BINS, BROADCAST_BINS = 1 << 16, 1 << 17
#: Documents that a Python worker gets at once, or fewer long ones: words that repeat among them are looked up once.
BATCH = 2048
END_ID = 1
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: an open bin with f free
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = self.bins = 0

    def _take(self, f: int) -> int:
        bin_ = self.free[f].pop()
        if not self.free[f]:
            self.bits &= ~(1 << f)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(f)
        else:
            f, bin_ = self.capacity, self.bins
            self.bins += 1
            if length < f and self.count >= self.open_bins:  # a full bin needs no place
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = f - length
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.capacity - f


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Chunks that the tokenizer's pattern cuts into runs of letters, single digits and runs of other signs, and
#: that its normalizer only lower-cases: basic Latin without apostrophes and "<" (special tokens), and letters of Latin-1.
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:;=-@\[-`{{-~]+")
_SIGNS = rf"([^{_LETTERS}0-9]+|[0-9])"


class WordNumbers(dict):
    """Numbers of words from 0, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _lists(offsets, values: pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _at(lists: pa.Array, outer: pa.Array) -> np.ndarray:
    """Where the inner values of lists of lists begin and end."""
    return lists.offsets.to_numpy()[outer.offsets.to_numpy()]


class ChunkCache:
    """Token ids of texts by those of chunks between ASCII white space, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins tokens across it, so the ids of a text are those of
    its chunks in a row. Plain chunks are cut into lower-case words, which the tokenizer's model takes in their byte-level form; all
    others are encoded whole. Arrow cuts a batch of texts and puts its ids together, so that Python sees each word of a batch once,
    and the tokenizer only new ones. What is kept for later batches is emptied at ``most`` words.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.empty()
        # only for tokenizers of which the above holds
        self.parts = True
        self.parts = all(self.ids(w) == array("I", self.encode(w)).tobytes() for w in ["The", "Über", "naïve", ".,", "7", "###", "_", "Été12.,No"])
        self.empty()

    def __len__(self) -> int:
        return len(self.known)

    def empty(self) -> None:
        """Leave the tokenizer alone."""
        self.words = WordNumbers()
        self.known = pa.array([], pa.large_list(pa.uint32()))  # ids by a word's number

    def encode(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode_word(self, word: str) -> list[int]:
        if not (self.parts and _PLAIN.fullmatch(word)):
            return self.encode(word)
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_in))]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words, whose ids are known from then on."""
        before = len(self.words)
        numbers = np.array([*map(self.words.__getitem__, words)], np.int64)
        ids, ends = array("I"), [0]
        for i in np.flatnonzero(numbers >= before).tolist():
            ids.extend(self.encode_word(words[i]))
            ends.append(len(ids))
        self.known = pa.concat_arrays([self.known, _lists(ends, pa.array(np.array(ids, np.uint32)))])
        return numbers

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each of the texts."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        each = chunks.flatten().dictionary_encode()
        cut = each.dictionary
        if self.parts:
            padded = pc.replace_substring_regex(pc.utf8_lower(cut), _SIGNS, r" \1 ")
            cut = pc.if_else(pc.match_substring_regex(cut, f"^{_PLAIN.pattern}$"), padded, cut)
        parts = pc.ascii_split_whitespace(cut)
        words = parts.flatten().dictionary_encode()
        names = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.string()))
        numbers = self._numbers(pc.binary_join(names, "\n")[0].as_py().split("\n"))
        of_words = self.known.take(pa.array(numbers[words.indices]))
        of_chunks = _lists(_at(of_words, parts), of_words.flatten()).take(each.indices)
        ids, at = of_chunks.flatten().to_numpy().data, _at(of_chunks, chunks).tolist()
        if len(self.words) > self.most:
            self.empty()
        for start, stop in zip(at, at[1:], strict=False):
            yield ids[start:stop].tobytes()

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids(pa.array([text], pa.string())))


_caches: dict[str, ChunkCache] = {}


def _cache(path: str | None) -> ChunkCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 1; only longer ones than ``capacity`` are cut, however long. Null and
    empty texts are the one end token. Null ids pass through; repeated rows are packed one by one; texts of equal length go to any of the
    bins that they fit as well. Other columns are left out, whatever their names.
    ``tokenizer_path`` names a file for the ``tokenizers`` library that each executor can open; None is the
    installed public one. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession, BATCH)
    types, names = [pa.int64(), pa.int32(), *[pa.int64()] * 5], [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, packer = _cache(tokenizer_path), BestFit(capacity, open_bins)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        end = END_ID.to_bytes(4, "little")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), cache.all_ids(batch.column(1)), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        bin_, offset = packer.place(len(own) // 4)
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), first + bin_, offset))
                yield batch_of(rows)
        finally:
            cache.empty()  # the worker keeps the tokenizer
        # what is open, as piece -1 of no document
        yield batch_of([(None, -1, 0, capacity - free, 0, first + bin_, 0) for free, bins in enumerate(packer.free) for bin_ in bins])

    packed = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA)
    written = materialize(packed, "packing")
    small_batches(docs.sparkSession)
    return _with_open_bins_merged(written, capacity)


def _with_open_bins_merged(packed: DataFrame, capacity: int) -> DataFrame:
    """Pieces with the places that they have after open bins are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(n, s) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        packer, firsts, out = BestFit(capacity, len(held)), {}, []
        for n, sequence in sorted(held, key=lambda x: (-x[0], x[1])):
            bin_, offset = packer.place(n)
            if firsts.setdefault(bin_, sequence) != sequence:
                out.append((sequence, firsts[bin_], offset))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["of", "into", "shift"])

    bins = packed.where("piece = -1").select("sequence_id", "length")
    n = bins.count()
    tasks = max(1, -(-n // MERGED_BINS))
    dealt = bins.repartitionById(tasks, F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)).cast("int"))
    moved = materialize(dealt.mapInArrow(tidy(run), "of long, into long, shift long"), "packing")
    out = packed.where("piece >= 0").join(F.broadcast(moved) if n <= BROADCAST_BINS else moved, F.col("sequence_id") == F.col("of"), "left")
    places = {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
    return out.withColumns(places).select(*packed.columns)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its tokens and its place in a sequence."""
    return pack(read_table(spark, sf_dir, "documents"))

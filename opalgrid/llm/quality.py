"""A quality classifier of supervised subword embeddings.

A document is the mean of learned vectors of its features: its words, its pairs of neighbouring words and
the 3- and 4-character grams of its words, each hashed into one table. A softmax layer over that mean
gives the classes. Vectors and layer are trained on the driver by numpy stochastic gradient descent, over
features that executors extract from a bounded sample of labelled rows. For scoring, each table row is
reduced to its share of the log odds, so that executors get one table of ``BUCKETS`` floats, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, read_table, small_batches, tidy

BUCKETS = 1 << 18
DIM = 12
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 3000
#: The learning rate of vectors, as a multiple of that of the layer.
VECTOR_RATE = 16
THRESHOLD = 0.3
FOLDS = 5

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int32)  # 18 leading bits


class Words:
    """Numbers for words, and for each word its hash and the features of its characters."""

    def __init__(self, table: np.ndarray | None = None, most: int = 300_000) -> None:
        self.table, self.most = table, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        # of the first ``self.known`` words; there is room for more
        self.known = 0
        self.hash, self.sums, self.counts = np.zeros(1024, np.uint64), np.zeros(1024, np.float64), np.zeros(1024, np.int64)
        self.grams: list[np.ndarray] = []

    def _room(self, n: int) -> slice:
        """Places for ``n`` more words; buffers double, so that each word is copied a few times at most."""
        new = slice(self.known, self.known + n)
        if new.stop > len(self.hash):
            more = max(new.stop, 2 * len(self.hash)) - len(self.hash)
            self.hash, self.sums, self.counts = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.hash, self.sums, self.counts))
        self.known = new.stop
        return new

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.clear()
        number, known = self.number, len(self.number)
        idx = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        if len(number) > known:
            self._learn(list(number)[known:] if known == 0 else [w for w, i in zip(words, idx.tolist(), strict=True) if i >= known])
        return idx

    def _learn(self, words: list[str]) -> None:
        words = list(dict.fromkeys(words))
        chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), lengths)
        grams, owners = [], []
        h = _mix(chars * _A + np.uint64(1))
        for n in (2, 3, 4):
            h = _mix(h[:-1] * _B + chars[n - 1 :]) if len(h) > 1 else h[:0]
            if n > 2:
                inside = owner[: len(h)] == owner[n - 1 :]
                grams.append(_buckets(_mix(h[inside] + np.uint64(n))))
                owners.append(owner[: len(h)][inside])
        # the hash of a whole word: a sum over characters and places
        starts = np.cumsum(lengths) - lengths
        place = (np.arange(len(chars)) - np.repeat(starts, lengths)).astype(np.uint64)
        whole = _mix(np.add.reduceat(_mix(chars * _A + place * _B), starts)) if len(words) else np.zeros(0, np.uint64)
        gram, own = np.concatenate(grams), np.concatenate(owners)
        gram, own = np.concatenate([_buckets(whole), gram]), np.concatenate([np.arange(len(words)), own])
        counts = np.bincount(own, minlength=len(words))
        new = self._room(len(words))
        self.hash[new], self.counts[new] = whole, counts
        if self.table is None:
            by_word = gram[np.argsort(own, kind="stable")]
            self.grams += np.split(by_word, np.cumsum(counts)[:-1])
        else:
            self.sums[new] = np.bincount(own, weights=self.table[gram], minlength=len(words))

    def pairs(self, idx: np.ndarray) -> np.ndarray:
        h = self.hash[idx]
        return _buckets(_mix(h[:-1] * _A + h[1:] + np.uint64(2)))

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text and how often each occurs."""
        idx = self.look_up(text.lower().split())
        if not len(idx):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        all_ = np.concatenate([self.pairs(idx), *[self.grams[i] for i in idx.tolist()]])
        found, counts = np.unique(all_, return_counts=True)
        return found.astype(np.int32), counts.astype(np.int32)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """The mean over all features of each text; 0 without any."""
        split = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        idx = self.look_up([w for words in split for w in words])
        out = np.zeros(len(texts))
        if not len(idx):
            return out
        some = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[some]
        total, count = np.add.reduceat(self.sums[idx], starts), np.add.reduceat(self.counts[idx], starts)
        pair = np.append(self.table[self.pairs(idx)], 0)
        pair[starts[1:] - 1] = 0  # no pair reaches into the next text
        pair[-1] = 0
        out[some] = (total + np.add.reduceat(pair, starts)) / (count + lengths[some] - 1)
        return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, dim: int = DIM, seed: int = 3) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (label, features, counts); each bucket's share of the log odds, and the bias.

    Without rows both are 0.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    rows = [r for r in rows if len(r[1])]
    seen = np.zeros(BUCKETS, bool)
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, found, counts = rows[i]
            share = (counts / counts.sum()).astype(np.float32)
            own = table[found]
            mean = share @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # the gradient of a vector is its feature's share of the text, so vectors have a larger rate than the layer
            table[found] -= (lr * VECTOR_RATE) * np.outer(share, back)
            seen[found] = True
    table[~seen] = 0  # what training never saw says nothing
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows of ``docs`` outside the held-out fold, those whose seeded hash is least.

    Labels are ``quality`` of ``labels`` by ``doc_id``; null labels and ids are left out, of repeated ones
    the largest counts; of rows that repeat an id each counts. Null and empty texts teach nothing, long ones are read whole. Without labelled rows every score is 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality").where("_id is not null and quality is not null")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("quality").alias("_label"))
    present = docs.select(column(id_col).cast("long").alias("_id")).join(known, "_id").groupBy("_id").agg(F.first("_label").alias("_label"))
    chosen = present.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [words.features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["id", "label", "found", "counts"])

    # the sample has a fixed number of rows at most
    texts = docs.select(column(id_col).cast("long").alias("_id"), column(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    table = texts.select("_id", F.col("_label").cast("int"), "_text").mapInArrow(tidy(run), "id long, label int, found array<int>, counts array<int>").toArrow()
    rows = sorted(zip(*[table.column(i).to_pylist() for i in (0, 1)], range(table.num_rows), strict=True))
    found, counts = table.column(2).combine_chunks(), table.column(3).combine_chunks()
    at = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)
    return fit([(label, at(found, i), at(counts, i)) for _, label, i in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", drop: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1), or the name in ``out``. Null and empty texts get the score of the bias alone.

    Texts of any length are scored whole, equal ones alike; repeated rows are scored one by one. An input column of the result's name is
    replaced; all others pass through, but for those in ``drop``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c not in (*drop, out)]
    table, bias = model
    shared = spark.sparkContext.broadcast(table)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            z = np.concatenate([np.zeros(0), *[words.log_odds(texts[i : i + 64]) for i in range(0, len(texts), 64)]]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept_at], pa.array(p, pa.float64())], names=[*[batch.schema.names[i] for i in kept_at], "score"])

    text_at, kept_at = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]
    # plain names inside: those of the input may have dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(scores), plain.select(*[f"c{i}" for i in kept_at]).schema.add("score", "double")).toDF(*keep, out)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all columns of ``docs`` as they are, whatever their names.

    Null and empty texts have the score of the bias; repeated rows stay or go together. Without labels every row stays. An empty table gives an empty result.
    """
    out = "__opal_score"
    return score(docs, train(docs, labels), out=out).where(F.col(out) >= threshold).drop(out)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model, drop=("text",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

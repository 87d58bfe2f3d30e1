"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word, for each hashed
character n-gram of its words and one marking a word that repeats the word before it. A softmax
over two classes reads the average. Vectors and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows, in one task.

As the average is linear, a trained model is folded into one number per bucket (its vector
times the difference of the class weights), which is all that scoring needs.

Defined results: null and empty texts have the score of the bias alone; repeated rows get equal
scores; without usable labels every score is 0.5; other columns never take part.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import narrow, texts_of
from findweave.llm._labels import fit_in_task, folds, training_rows

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 5
RATE = 0.5
#: Distinct words that a scoring task remembers; beyond it the memory starts anew.
CACHE = 400_000
#: n-grams of a word that are built at a time.
SLICE = 1 << 16
THRESHOLD = 0.7
#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 6_000

_REPEAT = BUCKETS  # the bucket of the repeat marker


def features(word: bytes) -> array:
    """Buckets of a word: the word itself, then its character n-grams with boundary marks.

    All of the word takes part, whatever its length; long words are read in slices, so that only
    two bytes per n-gram are held.
    """
    crc, mask, marked = zlib.crc32, BUCKETS - 1, b"<" + word + b">"
    out = array("H", [crc(b"w" + word) & mask])
    for n in NGRAMS:
        last = len(marked) - n + 1
        for lo in range(0, last, SLICE):
            out.extend(array("H", [crc(marked[i : i + n]) & mask for i in range(lo, min(last, lo + SLICE))]))
    return out


class _Words(dict):
    """Word -> number, filled as words are met."""

    def __init__(self):
        super().__init__()
        self.order: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.order)
        self.order.append(word)
        return n


class _Table:
    """Buckets of numbered words in one flat array."""

    def __init__(self):
        self.ids, self.starts, self.sizes, self.used, self.known = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, words: list[bytes]) -> None:
        found = [features(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, n = int(sizes.sum()), len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + total] = np.concatenate([*map(np.asarray, found), np.zeros(0, int)])
        self.starts[self.known : self.known + n], self.sizes[self.known : self.known + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = self.used + total, self.known + n

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words one after the other, and how many each has."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def document_features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares of the average, as views of large arrays."""
    words, table, out, part = _Words(), _Table(), [], []

    def close():
        if part:
            ids, shares = (np.concatenate([x[k] for x in part]) for k in (0, 1))
            ends = np.cumsum([len(x[0]) for x in part])
            out.extend((ids[e - len(x[0]) : e], shares[e - len(x[0]) : e]) for e, x in zip(ends, part, strict=True))
            part.clear()

    for text in texts:
        codes = np.fromiter(map(words.__getitem__, text.split()), np.int64)
        if len(words.order) > table.known:
            table.add(words.order[table.known :])
        distinct, counts = np.unique(codes, return_counts=True)
        ids, sizes = table.of(distinct)
        flat, inverse = np.unique(np.append(ids, _REPEAT), return_inverse=True)
        share = np.bincount(inverse, np.append(np.repeat(counts, sizes), (codes[1:] == codes[:-1]).sum()))
        part.append((flat.astype(np.int32), (share / max(1.0, share.sum())).astype(np.float32)))
        if len(part) == 256:
            close()
    close()
    return out


@dataclass
class Model:
    """Logit of class 1 = bias + average of ``value`` over a document's buckets."""

    value: np.ndarray
    bias: float


def train(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit vectors and softmax by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    y = np.asarray(labels, int)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    if len(y) == 0 or share.min() == 0:
        return Model(np.zeros(BUCKETS + 1), 0.0)
    docs, step, total = document_features(texts), 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, part = docs[i]
            hidden = part @ vectors[ids]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            now = rate * (1 - step / total)
            grad = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            vectors[ids] -= now * len(ids) ** 0.5 * part[:, None] * grad
            step += 1
    return Model(vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with the folded model, remembering the sums of words it has met."""

    def __init__(self, model: Model):
        self.model, self.words = model, _Words()
        self.sums, self.sizes = np.zeros(1024), np.zeros(1024)
        self.known = 0

    def _learn(self) -> None:
        fresh = self.words.order[self.known :]
        if self.known + len(fresh) > len(self.sums):
            grow = max(len(self.sums), len(fresh))
            self.sums, self.sizes = (np.concatenate([a, np.zeros(grow)]) for a in (self.sums, self.sizes))
        ids = [features(w) for w in fresh]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = self.model.value[np.concatenate(ids).astype(np.int64)]
        end = self.known + len(fresh)
        self.sums[self.known : end] = np.add.reduceat(flat, np.cumsum(sizes) - sizes)
        self.sizes[self.known : end] = sizes
        self.known = end

    def __call__(self, texts) -> np.ndarray:
        out = []
        for text in texts:
            if len(self.words.order) > CACHE:
                self.words, self.known = _Words(), 0
            codes = np.fromiter(map(self.words.__getitem__, text.split()), np.int64)
            if len(self.words.order) > self.known:
                self._learn()
            repeats = float((codes[1:] == codes[:-1]).sum())
            size = self.sizes[codes].sum() + repeats
            logit = self.model.bias + (self.sums[codes].sum() + repeats * self.model.value[_REPEAT]) / max(1.0, size)
            out.append(1 / (1 + np.exp(-np.clip(logit, -700, 700))))
        return np.array(out, float)


def score_batches(model, scorer) -> callable:
    """A mapInArrow function: (key, text) -> (key, score)."""

    def run(batches):
        score = scorer(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts_of(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return fit_in_task(training_rows(docs, labels, label, max_rows=MAX_ROWS), lambda rows: train(rows["text"], rows["label"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus
    return narrow(docs, id_col, text_col).mapInArrow(score_batches(shared, Scorer), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with their columns, in one pass."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(texts_of(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", folds().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

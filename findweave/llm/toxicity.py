"""Toxicity: a convolutional text classifier.

Words (lower case, punctuation stripped) have the sum of two learned hashed embeddings, that of
the word and that of its first letters, which inflected forms share; filters of several widths slide over the whole text, each keeps its largest rectified response, and a logistic
layer reads these maxima. All parts are trained in numpy on a bounded sample of labelled rows.
Embeddings of buckets that fewer than ``MIN_DOCS`` sampled texts use stay zero, so one-off words
can't be learned by heart.

Convolutions are linear in the embeddings: for scoring, each filter tap is multiplied out into a
table over the buckets, so a text costs table look-ups, additions and a maximum.

Thresholds are calibrated by language on sampled rows kept apart from training; the language
picks the threshold and never enters a score.

Defined results: null and empty texts have the score of no response at all; texts shorter than
a filter are padded with silence; repeated rows get equal scores; without usable labels every
score is 0.5; languages without enough sampled rows, and a null language, use the common
threshold; other columns never take part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import narrow, texts_of
from findweave.llm._labels import fit_in_task, folds, training_rows

BUCKETS = 1 << 15  # bucket 0 is silence; of words the lower half, of first letters the upper half
PREFIX = 4
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
MIN_DOCS = 4
EPOCHS = 6
#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 16_000
RATE = 0.15
THRESHOLD = 0.3
#: Rows of a language that its own threshold needs, of each class.
MIN_CALIBRATION = 20
#: Distinct words that a scoring task remembers; beyond it the memory starts anew.
CACHE = 250_000
_STRIP = b".,;:!?*$%&#|\"'()[]{}<>-_~"


def buckets(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its first letters; (0, 0) if nothing but punctuation."""
    word = word.lower().strip(_STRIP)
    if not word:
        return 0, 0
    half = BUCKETS // 2
    return 1 + zlib.crc32(word) % (half - 1), half + zlib.crc32(word.decode("utf-8", "replace")[:PREFIX].encode()) % half


class _Words(dict):
    """Word -> number in order of first use; number 0 is silence."""

    def __init__(self):
        super().__init__()
        self.order: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.order)
        self.order.append(word)
        return n


def codes_of(text: bytes, table: _Words) -> np.ndarray:
    """Numbers of a text's words, ended by silence so that every filter fits."""
    words = text.split()
    codes = np.zeros(len(words) + max(WIDTHS) - 1, np.int32)
    codes[: len(words)] = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
    return codes


@dataclass
class Model:
    #: Per filter tap (width, offset) a table of responses by bucket.
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict = field(default_factory=dict)
    common: float = THRESHOLD

    def logits(self, docs: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        """One number per text, computed over the joined texts; ``tables``: responses by word number."""
        if not docs:
            return np.zeros(0)
        codes, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        starts, top, pads = np.cumsum(sizes) - sizes, [], max(WIDTHS) - 1
        k = 0
        for w in WIDTHS:
            response = tables[k][codes]
            for j in range(1, w):
                response[: len(codes) - j] += tables[k + j][codes[j:]]
            k += w
            if pads:  # positions in the padding are no positions of the text
                for back in range(1, pads + 1):
                    response[starts + sizes - back] = -np.inf
                response[starts[sizes == pads]] = -np.inf
            top.append(np.maximum.reduceat(response, starts, axis=0))
        pooled = np.maximum(np.concatenate(top, axis=1) + self.bias, 0)
        return pooled @ self.out + self.out_bias


def train(texts: list[bytes], labels: list[int], seed: int = 11, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Adagrad over single texts in random order; both classes weigh the same."""
    rng, n_out, taps = np.random.default_rng(seed), FILTERS * len(WIDTHS), sum(WIDTHS)
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model([np.zeros((BUCKETS, FILTERS), np.float32)] * taps, np.zeros(n_out), np.zeros(n_out), 0.0)
    words = _Words()
    docs = [codes_of(t, words) for t in texts]
    both = np.array([buckets(w) for w in words.order])
    used = np.zeros(BUCKETS, np.int64)
    for d in docs:
        used[np.unique(both[np.unique(d)])] += 1
    frozen = used < MIN_DOCS
    frozen[0] = True
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    emb[frozen] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    bias, out, out_bias = np.zeros(n_out), rng.normal(0.3, 0.1, n_out), -1.0
    g_emb, g_fil, g_bias, g_out, g_ob = np.full(BUCKETS, 1e-2), [np.full_like(f, 1e-2) for f in filters], np.full(n_out, 1e-2), np.full(n_out, 1e-2), 1e-2
    positive = y.mean()
    pads = max(WIDTHS) - 1
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            codes = docs[i]
            n = len(codes) - pads
            if n == 0:
                continue
            vec, at, raw = emb[both[codes, 0]] + emb[both[codes, 1]], [], []
            for w, f in zip(WIDTHS, filters, strict=True):
                r = vec[:n] @ f[0]
                for j in range(1, w):
                    r += vec[j : n + j] @ f[j]
                at.append(r.argmax(0))
                raw.append(r[at[-1], np.arange(FILTERS)])
            pre = np.concatenate(raw) + bias
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ out + out_bias, -30, 30)))
            delta = (p - y[i]) * (0.5 / positive if y[i] else 0.5 / (1 - positive))
            if abs(delta) < 1e-3:
                continue
            d_out, d_pre = delta * act + 1e-4 * out, delta * out * (pre > 0)
            for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                d = d_pre[k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    step = d[:, None] * f[j].T
                    d_f = (d[:, None] * vec[at[k] + j]).T
                    for where in both[codes[at[k] + j]].T:
                        live = ~frozen[where]
                        np.add.at(g_emb, where[live], (step[live] ** 2).sum(1))
                        np.subtract.at(emb, where[live], rate * step[live] / np.sqrt(g_emb[where[live]])[:, None])
                    g_fil[k][j] += d_f**2
                    f[j] -= rate * d_f / np.sqrt(g_fil[k][j])
            g_out += d_out**2
            out -= rate * d_out / np.sqrt(g_out)
            g_bias += d_pre**2
            bias -= rate * d_pre / np.sqrt(g_bias)
            g_ob += delta**2
            out_bias -= rate * delta / g_ob**0.5
    out_bias = out_bias + np.log(positive / (1 - positive))  # from equal classes back to their shares
    tables = [np.ascontiguousarray(emb @ f[j], np.float32) for f in filters for j in range(f.shape[0])]
    return Model(tables, bias, out, float(out_bias))


class Scorer:
    """Scores texts, remembering the responses to words it has met."""

    def __init__(self, model: Model, batch_words: int = 200_000):
        self.model, self.batch_words = model, batch_words
        self.words, self.known = _Words(), 0
        self.tables = [np.zeros((1024, t.shape[1]), np.float32) for t in model.tables]

    def _flush(self, held: list[np.ndarray]) -> np.ndarray:
        fresh = self.words.order[self.known :]
        end = self.known + len(fresh)
        if end > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros((max(len(t), len(fresh)), t.shape[1]), np.float32)]) for t in self.tables]
        if fresh:
            both = np.array([buckets(w) for w in fresh])
            for mine, t in zip(self.tables, self.model.tables, strict=True):
                mine[self.known : end] = t[both[:, 0]] + t[both[:, 1]]
            self.known = end
        out = self.model.logits(held, self.tables)
        if end > CACHE:
            self.words, self.known = _Words(), 0
        return out

    def __call__(self, texts) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            held.append(codes_of(text, self.words))
            size += len(held[-1])
            if size >= self.batch_words:
                out.append(self._flush(held))
                held, size = [], 0
        out.append(self._flush(held))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score from which F1 on the given rows is highest (the middle of that gap)."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    last = np.append(s[1:] != s[:-1], True)  # ties fall on the same side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def calibrate(model: Model, rows: list[tuple[bytes, int, str | None]]) -> Model:
    """Set the common threshold and one for each language with enough rows."""
    if not rows:
        return model
    scores, y, lang = Scorer(model)([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] or "" for r in rows])
    enough = lambda m: min((y[m] == 1).sum(), (y[m] == 0).sum()) >= MIN_CALIBRATION
    everything = np.ones(len(y), bool)
    if enough(everything):
        model.common = best_threshold(scores, y)
    model.thresholds = {str(name): best_threshold(scores[m], y[m]) for name in sorted(set(lang.tolist()) - {""}) if enough(m := lang == name)}
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Train on four fifths of the sampled rows, calibrate on the rest."""
    sample = training_rows(docs, labels, label, max_rows=MAX_ROWS, extra=("lang",) if "lang" in docs.columns else ())

    def learn(rows: dict) -> Model:
        part = list(zip(rows["text"], rows["label"], rows.get("lang", [None] * len(rows["text"])), strict=True))
        held = [p for k, p in enumerate(part) if k % 5 == 4]
        kept = [p for k, p in enumerate(part) if k % 5 != 4]
        return calibrate(train([p[0] for p in kept], [p[1] for p in kept]), held)

    return fit_in_task(sample, learn)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, score, threshold of the row's language, toxic (score at or over it)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x filters numbers, whatever the corpus
    rows = narrow(docs, id_col, text_col) if lang_col is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        scorer, m = Scorer(shared.value), shared.value
        for batch in batches:
            scores = scorer(texts_of(batch.column(1)))
            langs = batch.column(2).to_pylist() if lang_col else [None] * len(scores)
            limits = np.array([m.thresholds.get(x, m.common) for x in langs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(limits, pa.float64()), pa.array(scores >= limits)], names=["doc_id", "score", "threshold", "toxic"])

    return rows.mapInArrow(run, "doc_id long, score double, threshold double, toxic boolean")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", folds().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")

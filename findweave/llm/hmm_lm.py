"""Language-model scoring with a hidden Markov model over words.

Word counts of all training documents give each word a class: the most frequent words are classes
of their own, words seen once (and unseen ones) share one class, the others share classes by their
last letters; a word's probability within its class comes from the counts. Latent states emit
classes. Baum-Welch counts are taken on each partition, summed by Spark, and turned into new
parameters, pass after pass over all training documents until their likelihood settles. Passes
start from the model that explains the counts of neighbouring classes best, which are summed over
all training documents, too; that model is fitted to the table of counts (as large as the classes
squared, whatever the corpus) from a random start around the corpus shares of the classes. The
scaled forward recursion then gives the exact log-probability of each text: over known words, the
end and one unknown word, probabilities sum to one in every state.

Texts are never shuffled: blocks of documents send their distinct words, packed by hash, to the
count table and get class and count back by position.

Defined results: a null or empty text is the end alone; repeated rows score alike; rows with a
null id are scored but neither learned from nor held out; an empty table gives an empty result;
other columns never take part. Very long texts are scored whole.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import BLOCK_BYTES, bucket_counts, bucket_rows, complete, grow, grow_strings, grow_wide, narrow, payload_rows, shrink, shrink_wide, unpack_codes
from findweave.session import materialize

STATES = 8
#: Most frequent words with a class of their own; classes of other words by spelling.
TOP_WORDS = 2000
SPELLED = 512
END, RARE = TOP_WORDS, TOP_WORDS + 1
CLASSES = TOP_WORDS + 2 + SPELLED
#: The likelihood has settled when a pass over all training documents raises its logarithm by less than this part.
SETTLED = 1e-4
#: The same for a pass over the counts of neighbouring classes; it is looked at after so many passes.
SETTLED_PAIRS, EVERY = 1e-6, 8
#: Weight of the corpus shares of the classes in each state's emissions.
PRIOR = 20.0
LONG = 4096
BATCH_TOKENS = 600_000


def tokens(text: bytes) -> list[bytes]:
    """Words in ASCII lower case (the end is added where documents are coded)."""
    return text.lower().split()


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    """True for rows that are not learned from (a null id is not learned from either)."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


@dataclass
class Corpus:
    """Counts of the training tokens: N, V, documents, words seen once."""

    tokens: int
    types: int
    docs: int
    once: int


def count_words(packed: DataFrame) -> DataFrame:
    """(bucket, word, c): how often each word occurs in training documents."""

    def run(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for words, uses in zip(group["words"], group["uses"], strict=True):
            for word, n in zip(grow_strings(words.as_py()), grow(uses.as_py()).tolist(), strict=True):
                if n:
                    total[word] = total.get(word, 0) + n
        bucket = pa.array(np.full(len(total), group["bucket"][0].as_py()), pa.int32())
        return pa.table({"bucket": bucket, "word": pa.array(total.keys(), pa.binary()), "c": pa.array(total.values(), pa.int64())})

    parts = packed.groupBy("bucket", "slice").applyInArrow(run, "bucket int, word binary, c long")
    return parts.groupBy("bucket", "word").agg(F.sum("c").alias("c"))


def classify(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``counts`` with the class of each word (cls), and the training tokens of each class."""
    top = counts.orderBy(F.desc("c"), "word").limit(TOP_WORDS).where("c > 1")
    ranked = [(bytes(r["word"]), n) for n, r in enumerate(top.collect())]  # TOP_WORDS at most
    spark = counts.sparkSession
    own = spark.createDataFrame(pa.table({"word": pa.array([w for w, _ in ranked], pa.binary()), "own": pa.array([n for _, n in ranked], pa.int32())}))
    spelled = (F.crc32(F.substring("word", -3, 3)) % SPELLED + TOP_WORDS + 2).cast("int")
    known = counts.join(F.broadcast(own), "word", "left").withColumn("cls", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("c") == 1, F.lit(RARE)).otherwise(spelled)).drop("own")
    sums = known.groupBy("cls").agg(F.sum("c").alias("total")).toArrow()  # CLASSES rows at most
    totals = np.zeros(CLASSES)
    totals[sums["cls"].to_numpy()] = sums["total"].to_numpy()
    return known, totals


def shares(c: np.ndarray, cls: np.ndarray, totals: np.ndarray, once: int) -> np.ndarray:
    """log10 of a word's part of its class; unseen words (c = 0) have half of the rare class, or all, if nothing was seen once."""
    known = np.log10(np.maximum(c, 1) / np.maximum(totals[cls], 1)) + np.where(cls == RARE, np.log10(0.5), 0.0)
    return np.where(c > 0, known, np.log10(0.5 if once else 1.0))


def class_shares(totals: np.ndarray, docs: int) -> np.ndarray:
    """Shares of the classes in all training tokens, the ends of the documents included."""
    out = totals + 0.01
    out[END] += docs
    return out / out.sum()


def look_up(packed: DataFrame, classed: DataFrame, slices: int) -> DataFrame:
    """(block, check, idx, c, cls): the packed words of each block with their counts and classes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {w.as_py(): i for i, w in enumerate(right["word"])}
        c, cls = np.append(right["c"].to_numpy(), 0).astype(np.int64), np.append(right["cls"].to_numpy(), RARE).astype(np.int64)
        out_c, out_cls = [], []
        for words in left["words"]:
            found = np.array([at.get(w, -1) for w in grow_strings(words.as_py())], np.int64)
            out_c.append(shrink_wide(c[found]))
            out_cls.append(shrink(cls[found]))
        return pa.table({"block": left["block"], "check": left["check"], "idx": left["idx"], "c": pa.array(out_c, pa.binary()), "cls": pa.array(out_cls, pa.binary())})

    table = classed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    grouped = packed.drop("uses").groupBy("bucket", "slice").cogroup(table.groupBy("bucket", "slice"))
    return grouped.applyInArrow(run, "block long, check long, idx binary, c binary, cls binary")


_CODED = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, share double, codes binary"


def pack(codes: np.ndarray) -> bytes:
    return zlib.compress(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1).T).view("<u2").reshape(-1)


def code_documents(payload: DataFrame, found: DataFrame, corpus: Corpus, totals: np.ndarray) -> DataFrame:
    """Per document its base score, what its words contribute within classes, and its class codes."""
    bottom = np.log10(corpus.tokens + 0.1 * (corpus.types + 1))
    names = [f.split()[0] for f in _CODED.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        for block in left.to_pylist():
            n, parts, seen = block["n_words"], right.to_pylist(), 0
            c, cls = np.zeros(n + 1, np.int64), np.full(n + 1, END)
            for part in parts:
                at = np.cumsum(grow(part["idx"]))
                c[at], cls[at] = grow_wide(part["c"]), grow(part["cls"])
                seen += len(at)
            complete(block, parts, seen)
            share = shares(c, cls, totals, corpus.once)
            c[n], share[n] = corpus.docs, 0.0
            base, known = np.log10(c + 0.1) - bottom, c > 0
            codes, start = unpack_codes(block["codes"]).astype(np.int64), 0
            for doc_id, size in zip(block["ids"], block["counts"], strict=True):
                mine = np.append(codes[start : start + size], n)
                row = (doc_id, not held_out(doc_id), size + 1, int(known[mine].sum()), float(base[mine].sum()), float(share[mine].sum()), pack(cls[mine]))
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
                start += size
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return payload.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, _CODED)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def random(shares: np.ndarray, states: int = STATES, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = shares * rng.gamma(2.0, 1.0, (states, len(shares)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


class _Layout:
    """Sequences ordered by length, stored step by step, so one step is one slice."""

    def __init__(self, seqs: list[np.ndarray]):
        sizes = np.array([len(s) for s in seqs])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        ends = np.cumsum(sizes)
        step = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        place = self.at[step]
        place += np.repeat(np.arange(len(sizes)), sizes)
        self.codes = np.empty(ends[-1], np.int64)
        self.codes[place] = np.concatenate([seqs[i] for i in self.order])
        self.rank = np.arange(ends[-1]) - np.repeat(self.at[:-1], self.active)

    def by_sequence(self, logs: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, logs, minlength=len(self.order))
        return out


def forward(model: Hmm, seqs: list[np.ndarray], dtype=np.float64, keep: bool = False):
    """log10 likelihood of each sequence by the scaled forward recursion (and what backward needs)."""
    lay = _Layout(seqs)
    emit, move = np.ascontiguousarray(model.emit.T, dtype).take(lay.codes, axis=0), model.move.astype(dtype)
    scale = np.empty(len(lay.codes), dtype)
    alpha = np.empty_like(emit) if keep else None
    a, at, ones = None, lay.at.tolist(), np.ones(len(model.start), dtype)
    for t, n in enumerate(lay.active.tolist()):
        lo, hi = at[t], at[t + 1]
        a = (a[:n] @ move) * emit[lo:hi] if t else model.start.astype(dtype) * emit[lo:hi]
        s = np.matmul(a, ones, out=scale[lo:hi])  # sums of short rows are faster as a product
        a = np.divide(a, s[:, None], out=alpha[lo:hi] if keep else a)
    total = lay.by_sequence(np.log10(scale.astype(np.float64)))
    return (total, lay, emit, scale, alpha) if keep else total


def expected_counts(model: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log10 likelihood."""
    total, lay, emit, scale, alpha = forward(model, seqs, np.float32, keep=True)
    move, k = model.move.astype(np.float32), len(model.start)
    gamma, moves, at, active = alpha, np.zeros((k, k)), lay.at.tolist(), lay.active.tolist()
    beta = np.ones((active[-1], k), np.float32)
    for t in range(len(active) - 1, -1, -1):
        lo, hi, n = at[t], at[t + 1], active[t]
        if t < len(active) - 1:
            m, nlo, nhi = active[t + 1], at[t + 1], at[t + 2]
            ahead = emit[nlo:nhi] * beta
            ahead /= scale[nlo:nhi, None]
            moves += alpha[lo : lo + m].T @ ahead
            back = ahead @ move.T
            beta = back if m == n else np.concatenate([back, np.ones((n - m, k), np.float32)])
        # alpha of this step is not read again, so gamma takes its place (earlier steps still hold alpha)
        gamma[lo:hi] *= beta
    emits = np.stack([np.bincount(lay.codes, gamma[:, s], minlength=model.emit.shape[1]) for s in range(k)])
    return gamma[: active[0]].sum(0).astype(float), moves * model.move, emits, float(total.sum())


def update(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Hmm:
    start, move, emit = starts + 1e-3, moves + 1e-3, emits + PRIOR * shares
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _batches(rows) -> list[tuple[list, list[np.ndarray]]]:
    """Groups of (keys, sequences) of like length: long ones wait for each other."""
    groups = {False: ([], []), True: ([], [])}
    sizes = {False: 0, True: 0}
    for key, data in rows:
        seq = unpack(data)
        long = len(seq) > LONG
        groups[long][0].append(key)
        groups[long][1].append(seq)
        sizes[long] += len(seq)
        if sizes[long] >= BATCH_TOKENS:
            yield groups[long]
            groups[long], sizes[long] = ([], []), 0
    yield from (g for g in groups.values() if g[0])


def _pack_counts(parts) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts])


def baum_welch(coded: DataFrame, model: Hmm, shares: np.ndarray) -> tuple[Hmm, float]:
    """One pass: counts of each partition's training documents, summed by Spark; and the log10 likelihood before it."""
    k, m = model.emit.shape
    shared = coded.sparkSession.sparkContext.broadcast(model)  # states x classes numbers

    def run(batches):
        total = None
        rows = ((None, code.as_py()) for b in batches for code in b.column(0))
        for _, seqs in _batches(rows):
            part = _pack_counts(expected_counts(shared.value, seqs))
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["at", "n"])

    sums = coded.where("learn").select("codes").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(k + k * k + k * m + 1)
    flat[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return update(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, m), shares), float(flat[-1])


def count_pairs(coded: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(at, n): how often class at // classes is followed by class at % classes in training documents."""

    def run(batches):
        total, codes, held = np.zeros(classes * classes, np.int64), [], 0

        def add():
            nonlocal total, codes, held
            if codes:
                ends = np.cumsum([len(c) for c in codes])[:-1]
                flat = np.concatenate(codes).astype(np.int64)
                pairs = flat[:-1] * classes + flat[1:]
                total += np.bincount(np.delete(pairs, ends - 1), minlength=len(total))
            codes, held = [], 0

        for batch in batches:
            for data in batch.column(0):
                codes.append(unpack(data.as_py()))
                held += len(codes[-1])
                if held >= BATCH_TOKENS:
                    add()
        add()
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["at", "n"])

    return coded.where("learn").select("codes").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))


def explain_pairs(counts: np.ndarray, shares: np.ndarray, states: int = STATES, part: float = SETTLED_PAIRS) -> Hmm:
    """The model of neighbouring classes (``counts``: first by second) by expectation maximisation.

    Two neighbours are drawn from two states in a row, whose joint probabilities are ``joint``.
    """
    model = Hmm.random(shares, states)
    joint, emit = (model.move / states).astype(np.float32), model.emit.astype(np.float32)
    counts, before = counts.astype(np.float32), -np.inf
    total = max(1.0, float(counts.sum(dtype=float)))
    for number in itertools.count():
        expected = np.maximum(emit.T @ (joint @ emit), np.float32(1e-37))
        if number % EVERY == 0:
            now = float((counts * np.log(expected)).sum(dtype=float)) / total
            if now - before <= EVERY * part * abs(now):
                break
            before = now
        ratio = counts / expected
        seconds, firsts = emit @ ratio, emit @ ratio.T
        emits = emit * (joint @ firsts + joint.T @ seconds) + (PRIOR * shares).astype(np.float32)
        joint = joint * (firsts @ emit.T).T + 1e-3
        joint, emit = joint / joint.sum(), emits / emits.sum(1, keepdims=True)
    start = joint.sum(1).astype(float)
    return Hmm(start / start.sum(), (joint / joint.sum(1, keepdims=True)).astype(float), emit.astype(float))


def starting_point(coded: DataFrame, shares: np.ndarray, states: int = STATES) -> Hmm:
    """``explain_pairs`` of all training documents, in one task over the table of counts."""

    def run(group: pa.Table) -> pa.Table:
        counts = np.zeros(len(shares) ** 2)
        counts[group["at"].to_numpy()] = group["n"].to_numpy()
        found = explain_pairs(counts.reshape(len(shares), -1), shares, states)
        flat = _pack_counts((found.start, found.move, found.emit))
        return pa.table({"model": pa.array([flat.astype("<f8").tobytes()], pa.binary())})

    pairs = count_pairs(coded, len(shares))
    rows = pairs.groupBy(F.lit(0).alias("one")).applyInArrow(run, "model binary").collect()  # one row
    if not rows:
        return Hmm.random(shares, states)
    flat, k = np.frombuffer(rows[0]["model"], "<f8"), states
    return Hmm(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, -1))


def settled(coded: DataFrame, shares: np.ndarray, states: int = STATES, part: float = SETTLED) -> Hmm:
    """Baum-Welch over all training documents until their likelihood settles."""
    model, before = starting_point(coded, shares, states), -np.inf
    while True:
        model, now = baum_welch(coded, model, shares)
        if now - before <= part * abs(now):
            return model
        before = now


def log10_scores(coded: DataFrame, model: Hmm) -> DataFrame:
    """``coded`` with ``score``: the exact log10 probability of each text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rows = ((r, r["codes"]) for b in batches for r in b.to_pylist())
        for keys, seqs in _batches(rows):
            scores = forward(shared.value, seqs)
            yield pa.RecordBatch.from_pylist(
                [{"doc_id": r["doc_id"], "n_tokens": r["n_tokens"], "n_known": r["n_known"], "base_score": r["base_score"], "score": float(s) + r["share"]} for r, s in zip(keys, scores, strict=True)],
                schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]),
            )

    return coded.select("doc_id", "n_tokens", "n_known", "base_score", "share", "codes").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    rows = narrow(docs, id_col, text_col)
    sizes = bucket_counts(rows)
    packed = materialize(bucket_rows(rows, tokens, sizes, limit, held_out), "words")
    counts = materialize(count_words(packed), "counts")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    learned = rows.select("doc_id").where(remainder != 0).count()
    corpus = Corpus(n + learned, v + (learned > 0), learned, once)
    classed, totals = classify(counts)
    found = look_up(packed, classed.select("bucket", "word", "c", "cls"), sizes[1])
    coded = materialize(code_documents(payload_rows(rows, tokens, limit), found, corpus, totals), "coded")
    model = settled(coded, class_shares(totals, learned), states)
    return log10_scores(coded, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_hmm_lm(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

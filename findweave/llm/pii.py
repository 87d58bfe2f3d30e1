"""Personal data: bootstrapped contextual extraction.

Seed entities (e-mail, IP address, card number and phone number by fixed patterns, and secrets: long
mixed hexadecimal keys, access-key ids, values assigned to a password or key) and all other tokens
that carry digits are instances. Each occurrence induces lexical patterns: the word before it, the
two words before it, the word after it, and its own shape with the lengths of its runs. The contexts
of all seeds are counted over all tokens of all texts, so a context's confidence is the part of the
tokens in it that are identifiers, and tokens without a digit become instances where they stand in a
context that seeds fill to ``LIKELY``, held back where it is rare.

The pattern-instance graph is scored round by round by Spark. A shape's confidence is the mean score
of its values, a context's the scores of its occurrences over all tokens in it, both held back where
these are few. An instance's score is the larger of two: what its best context says alone, times
``TRUST``, and the mean of its shape's confidence (counted twice) and its best context's; only the
latter flows back into the patterns, and a shape without any context says nothing. Instances that
reach ``FOUND`` are identifiers the seeds alone did not show. In the next of ``GENERATIONS`` they
count with their scores, and their own contexts, counted alike, join the graph and admit further
instances, until there are no new ones. The found ones' occurrences are added as spans of kind "id".
Seeds keep their spans whatever the scores are.

Which patterns are counted, and which contexts admit instances, reaches the tasks as a bit filter of
fixed size; what passes it wrongly is dropped by a join on the pattern itself (counts: on its 64-bit hash). Only instances,
patterns, counts and spans are shuffled, never texts (``redact`` deals texts once, by id and digest).

Defined results: null and empty texts have no spans; repeated rows get the same spans each, ties of
scores are no matter; spans count code points, ends exclusive; overlapping spans of different kinds
are all kept, but an added span never overlaps a seed's; very long texts are read whole, and words
of more than ``LONG_WORD`` characters stand in patterns by their 128-bit hash; an empty table gives
an empty result; other columns never take part. An identifier of several tokens is found by its
parts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import digest, narrow, texts_of
from findweave.llm.near_dedup import _STEP, _U, _mix
from findweave.session import materialize

#: Kinds of the base patterns, in the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "id")
#: Times that instances induce contexts, the seeds first, and rounds of scoring in each.
GENERATIONS, ROUNDS = 2, 2
#: Instances from which on a pattern's mean counts half.
HOLD = 3.0
#: Part of a context that identifiers fill where tokens without digits become instances, and the weight
#: of a context's confidence on its own.
LIKELY, TRUST = 0.25, 0.8
LONG_WORD = 64
#: Bits that number the places of the filter of patterns; each pattern has four places.
FILTER_BITS = 24
#: Words whose hashes are kept, and words that are counted at a time; counts that a task holds before it hands them on.
CACHE, MOST_HELD = 400_000, 2_000_000
#: Words of whole texts that are looked up in contexts at a time.
AT_ONCE = 50_000
#: Tasks that count contexts, at most, for each slot of the cluster.
TASKS_A_SLOT = 2
#: Parts that the instances of a pattern are dealt out into.
SALT = 32
FOUND = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a number that starts inside a run of digits could only match what its run's start did not
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Access-key ids, and values with a digit that are assigned to names of secrets (fixed values).
_ACCESS = re.compile(r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|api_?key|access_?key|token)\x20?[=:]\x20?[\"']?(?=[^\s\"',;]*[0-9])([^\s\"',;]{8,})")
_MARKED = re.compile(rb"[0-9@]")
_DIGIT, _DIGIT_BYTE = re.compile(r"[0-9]"), re.compile(rb"[0-9]")
_EDGE = ".,;:!?\"'()[]{}<>*$%&#|="
_EDGE_BYTES = _EDGE.encode()
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their at signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, ordered by start, then kind."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split(".") if len(p) < 20) and all(len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(value: str) -> str:
    """The value with runs of digits and of letters replaced by their kind and length."""
    return _LETTERS.sub(lambda m: f"a{min(len(m.group()), 9)}", _DIGITS.sub(lambda m: f"\x00{len(m.group())}", value)).replace("\x00", "d")


def norm(word: str) -> str:
    """A word as it stands in patterns: without marks around it, in lower case; very long ones by their hash."""
    word = word.strip(_EDGE).lower() or word
    return word if len(word) <= LONG_WORD else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def context_patterns(before: list[str], after: str | None) -> list[str]:
    """Patterns of up to two words before and one after."""
    out = []
    if before:
        out.append("before:" + norm(before[-1]))
    if len(before) > 1:
        out.append("before2:" + norm(before[-2]) + " " + norm(before[-1]))
    if after:
        out.append("after:" + norm(after))
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the seeds that are no base spans; none overlaps another."""
    out = sorted([m.span() for m in _SECRET.finditer(text)] + [m.span() for m in _ACCESS.finditer(text)])
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(1)
        k = bisect_left(out, (a, a))
        if not (k < len(out) and out[k][0] < b) and not (k and out[k - 1][1] > a):
            out.insert(k, (a, b))
    return [("secret", a, b) for a, b in out]


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, str, list[str]]]:
    """(start, end, kind or "", value, shape pattern, context patterns) of seeds and other tokens with digits."""
    seeds = base + secrets(text)
    seeds.sort(key=lambda s: s[1])
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [t[0] for t in tokens]

    def around(start: int, end: int) -> list[str]:
        first, last = bisect_right(starts, start) - 1, bisect_left(starts, end)
        return context_patterns([text[a:b] for a, b in tokens[max(0, first - 2) : first]], text[slice(*tokens[last])] if last < len(tokens) else None)

    out = [(a, b, kind, text[a:b].lower(), "shape:" + (kind if kind in ("email", "secret") else shape(text[a:b])), around(a, b)) for kind, a, b in seeds]
    for (a, b), (left, right) in zip(tokens, _free(tokens, seeds, text), strict=True):
        if left < right and _DIGIT.search(text, a, b):
            out.append((left, right, "", text[left:right].lower(), "shape:" + shape(text[left:right]), around(a, b)))
    return out


def _free(tokens: list[tuple[int, int]], seeds: list[tuple[str, int, int]], text: str):
    """(start, end) of each token without the marks around it; an empty span where it overlaps a seed."""
    k, reach = 0, 0
    for a, b in tokens:
        while k < len(seeds) and seeds[k][1] < b:
            reach = max(reach, seeds[k][2])
            k += 1
        raw = text[a:b]
        left = a + len(raw) - len(raw.lstrip(_EDGE))
        yield (left, left) if reach > a else (left, max(left, a + len(raw.rstrip(_EDGE))))


_SPAN = "struct<start:int,end:int,kind:string,value:string,shape:string,contexts:array<string>>"
_SCAN = f"row long, doc_id long, digest binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<{_SPAN}>"


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, digest): rows of one id and digest have the same text."""
    return narrow(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))


def scan(rows: DataFrame) -> DataFrame:
    """Base results of each row and the instances in its text."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("shape", pa.string()), ("contexts", pa.list_(pa.string()))])
    names = ["start", "end", "kind", "value", "shape", "contexts"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for batch in batches:
            out = []
            for doc_id, raw, mark in zip(batch.column(0), texts_of(batch.column(1)), batch.column(2), strict=True):
                if _MARKED.search(raw):
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                    out.append((number, doc_id.as_py(), mark.as_py(), *counts, hashlib.sha256(listed(base).encode()).hexdigest(), [dict(zip(names, i, strict=True)) for i in instances(text, base)]))
                else:
                    out.append((number, doc_id.as_py(), mark.as_py(), 0, 0, 0, 0, nothing, []))
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.list_(span)]
            columns = ["row", "doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names=columns)

    return rows.select("doc_id", "text", "digest").mapInArrow(run, _SCAN)


_PLACES = _U((1 << FILTER_BITS) - 1)


class _Words(dict):
    """Hashes of words as they stand in patterns, by their bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        plain = len(word) <= LONG_WORD and word.isascii()  # then bytes do as characters
        self[word] = h = xxhash.xxh3_64_intdigest(word.strip(_EDGE_BYTES).lower() or word if plain else norm(word.decode("utf-8", "replace")))
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def _before(h: np.ndarray) -> np.ndarray:
    return _mix(h + _STEP)


def _after(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ _STEP)


def _before2(h: np.ndarray, then: np.ndarray) -> np.ndarray:
    return _mix(_mix(h * _U(3) + _STEP) * _STEP + then)


def pattern_hashes(patterns: list[str]) -> np.ndarray:
    """64-bit hashes of contexts, the same as of the words in a text that make them."""
    parts = [p.partition(":")[::2] for p in patterns]
    own = lambda words: np.array([xxhash.xxh3_64_intdigest(w) for w in words], _U)
    first, second = own([w.split(" ")[0] for _, w in parts]), own([w.split(" ")[-1] for _, w in parts])
    kinds = np.array([k for k, _ in parts])
    return np.where(kinds == "before", _before(first), np.where(kinds == "after", _after(first), _before2(first, second)))


def _place(hashes: np.ndarray, number: int) -> np.ndarray:
    """The first to fourth of the places of each hash in the filter."""
    h = _mix(hashes + _U(1)) if number > 1 else hashes
    return (h >> _U(number % 2 * FILTER_BITS) & _PLACES).astype(np.int64)


def within(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions, ascending, of the hashes that may be among those that the filter was made of."""
    left = np.arange(len(hashes))
    for number in range(4):  # nearly all are out after the first place
        place = _place(hashes[left], number)
        left = left[bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]
    return left


def _neighbours(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of ``sizes`` words, one after the other: positions of the words that have one, and two, behind them in their text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.flatnonzero(text[1:] == text[:-1]), np.flatnonzero(text[2:] == text[:-2])


def keyed(patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``hash``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["pattern", "hash"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, hash long")


def filter_of(patterns: DataFrame) -> np.ndarray:
    """Bit filter of the ``pattern`` column: two megabytes, however many patterns there are."""

    def run(batches):
        for batch in batches:
            hashes = pattern_hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_place(hashes, k) for k in range(4)])), pa.int32())], names=["place"])

    set_bits = patterns.select("pattern").mapInArrow(run, "place int").groupBy(F.expr("place div 8").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, place % 8)")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bits[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy()
    return bits


def count_contexts(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how many tokens of all texts stand in each context of ``patterns``."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(patterns))

    def run(batches):
        bits, known = shared.value, _Words()
        held, size, hashes, totals = [], 0, np.zeros(0, _U), np.zeros(0, np.int64)

        def counted():
            """What was met so far, each context once."""
            h = np.concatenate([*held, np.zeros(0, _U)])
            # the last word of a text stands before nothing, the first after nothing
            one, two = _neighbours([len(x) for x in held])
            met = np.concatenate([_before(h[one]), _after(h[one + 1]), _before2(h[two], h[two + 1])])
            met, n = np.unique(met[within(met, bits)], return_counts=True)
            both, at = np.unique(np.concatenate([hashes, met]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([totals, n]), len(both)).astype(np.int64)

        def told():
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(totals, pa.int64())], names=["hash", "total"])

        for batch in batches:
            for raw in texts_of(batch.column(0)):
                held.append(known.of(raw.split()))
                size += len(held[-1])
                if size >= CACHE:
                    hashes, totals = counted()
                    held, size = [], 0
                    if len(hashes) >= MOST_HELD:
                        yield told()
                        hashes, totals = hashes[:0], totals[:0]
        hashes, totals = counted()
        yield told()

    # a context is told once by each task that meets it: few tasks, so that rows follow the contexts, not contexts times partitions
    few = TASKS_A_SLOT * rows.sparkSession.sparkContext.defaultParallelism
    counted_ = rows.select("text").coalesce(few).mapInArrow(run, "hash long, total long").groupBy("hash").agg(F.sum("total").alias("total"))
    return counted_.join(keyed(patterns), "hash").select("pattern", "total")


def free_hits(words: list[bytes], sizes: list[int], known: _Words, bits: np.ndarray) -> dict[int, list[str]]:
    """Contexts in the filter of the tokens that may be free instances, by the token's position.

    ``words``: those of texts of ``sizes`` words, one after the other. Tokens with a digit and those
    that hold an e-mail are none, so where only seeds stand in a context no text is read further.
    """
    named = lambda w: norm(w.decode("utf-8", "replace"))
    h, (one, two), out = known.of(words), _neighbours(sizes), {}
    before, after, before2 = one[within(_before(h[one]), bits)], one[within(_after(h[one + 1]), bits)], two[within(_before2(h[two], h[two + 1]), bits)]
    met = np.unique(np.concatenate([before + 1, after, before2 + 2])).tolist()
    free = {i for i in met if not _DIGIT_BYTE.search(words[i]) and not (b"@" in words[i] and emails(words[i].decode("utf-8", "replace")))}
    for at, ahead, pattern in (
        (before, 1, lambda i: "before:" + named(words[i])),
        (after, 0, lambda i: "after:" + named(words[i + 1])),
        (before2, 2, lambda i: f"before2:{named(words[i])} {named(words[i + 1])}"),
    ):
        for i in at.tolist():
            if i + ahead in free:
                out.setdefault(i + ahead, []).append(pattern(i))
    return out


def free_instances(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, digest, start, end, value, pattern) of the tokens without digits in contexts of ``patterns``, seeds apart."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(patterns))
    fields = {"doc_id": pa.int64(), "digest": pa.binary(), "start": pa.int32(), "end": pa.int32(), "value": pa.string(), "pattern": pa.string()}

    def run(batches):
        bits, known = shared.value, _Words()

        def met(texts: list[tuple[int | None, bytes, bytes]], words: list[bytes], sizes: list[int]):
            ends, found, out = np.cumsum(sizes), {}, []
            for i, patterns in free_hits(words, sizes, known, bits).items():
                k = int(np.searchsorted(ends, i, side="right"))
                found.setdefault(k, {})[i - int(ends[k]) + sizes[k]] = patterns
            for k, of in found.items():
                doc_id, raw, mark = texts[k]
                text = raw.decode("utf-8", "replace")
                tokens = [m.span() for m in _TOKEN.finditer(text)]
                seeds = sorted(base_spans(text) + secrets(text), key=lambda s: s[1]) if _MARKED.search(raw) else []
                for i, (left, right) in enumerate(_free(tokens, seeds, text)):
                    if i in of and left < right:
                        out += [(doc_id, mark, left, right, text[left:right].lower(), p) for p in of[i]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, fields.values(), strict=True)], names=list(fields))

        for batch in batches:
            texts, words, sizes = [], [], []
            for doc_id, raw, mark in zip(batch.column(0), texts_of(batch.column(1)), batch.column(2), strict=True):
                own = raw.split()
                texts.append((doc_id.as_py(), raw, mark.as_py()))
                words += own
                sizes.append(len(own))
                if len(words) >= AT_ONCE:
                    yield met(texts, words, sizes)
                    texts, words, sizes = [], [], []
            yield met(texts, words, sizes)

    met = rows.select("doc_id", "text", "digest").mapInArrow(run, "doc_id long, digest binary, start int, end int, value string, pattern string")
    return met.join(patterns.select("pattern"), "pattern")


def meetings(scanned: DataFrame) -> DataFrame:
    """(value, pattern, seed, n): which values with digits, and seeds, stand in which patterns, and how often."""
    seen = scanned.select(F.explode("found").alias("i")).select("i.*")
    met = seen.select("value", (F.col("kind") != "").alias("seed"), F.explode(F.concat(F.array("shape"), "contexts")).alias("pattern"))
    return materialize(met.groupBy("value", "pattern").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "met")


def induce(rows: DataFrame, contexts: DataFrame, induced: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges, free) of the contexts in ``induced`` (pattern, filled): their part of the graph, and the places of instances without digits.

    ``contexts``: value, pattern, seed, n of instances with digits; ``filled``: occurrences in the
    context that are identifiers. ``edges``: value, pattern, seed, n, total (tokens in the context).
    A context that identifiers fill wholly has no further tokens, and ``free`` is None if no context
    is filled enough, as then no text need be read for it.
    """
    totals = materialize(count_contexts(rows, induced).join(induced, "pattern"), "totals")
    edges = contexts.join(totals.select("pattern", "total"), "pattern")
    likely = totals.where((F.col("filled") >= LIKELY * (F.col("total") + HOLD)) & (F.col("filled") < F.col("total")))
    if likely.isEmpty():
        return edges, None
    free = materialize(free_instances(rows, likely), "free")
    again = free.groupBy("value", "pattern").agg(F.lit(False).alias("seed"), F.count("*").alias("n"))
    return edges.unionByName(again.join(totals.select("pattern", "total"), "pattern")), free


def score_graph(edges: DataFrame, rounds: int = ROUNDS, known: DataFrame | None = None) -> DataFrame:
    """(value, score) of the instances that are no seeds, after ``rounds`` of scoring the graph.

    ``edges``: value, pattern, seed, n, total (null for shapes). ``known``: (value, score) of
    instances found before, which keep at least that score.
    """
    # the instances of a pattern are dealt out over several tasks, as one pattern may have a third of them
    salt = F.pmod(F.xxhash64("value"), F.lit(SALT)).cast("int").alias("salt")
    edges = materialize(edges.select("*", salt), "graph")
    # a value that is a seed somewhere is a seed everywhere
    score = edges.groupBy("value").agg(F.max(F.col("seed").cast("int")).cast("double").alias("fixed"))
    if known is not None:
        score = score.join(known.select("value", F.col("score").alias("before")), "value", "left").select("value", "fixed", F.coalesce("before", F.lit(0.0)).alias("before"))
    else:
        score = score.withColumn("before", F.lit(0.0))
    score = score.withColumn("score", F.greatest("fixed", "before"))
    for _ in range(rounds):
        weighed = edges.join(score.select("value", "score"), "value")
        parts = weighed.groupBy("pattern", "salt").agg(F.sum("score").alias("s"), F.count("*").alias("k"), F.sum(F.col("score") * F.col("n")).alias("w"), F.first("total").alias("total"))
        of_shape, of_context = F.sum("s") / (F.sum("k") + HOLD), F.sum("w") / (F.first("total") + HOLD)
        confidence = parts.groupBy("pattern").agg(F.coalesce(of_context, of_shape).alias("conf"))
        drawn = edges.join(parts.select("pattern", "salt").join(confidence, "pattern"), ["pattern", "salt"])
        by_shape = F.coalesce(F.max(F.when(F.col("total").isNull(), F.col("conf"))), F.lit(0.0))
        by_context = F.coalesce(F.max(F.when(F.col("total").isNotNull(), F.col("conf"))), F.lit(0.0))
        # a shape alone is no evidence; and what contexts say alone doesn't flow back into them: a context can't confirm itself
        both = F.when(by_context > 0, (by_shape * 2 + by_context) / 3).otherwise(F.lit(0.0))
        again = drawn.groupBy("value").agg(both.alias("new"), (by_context * TRUST).alias("alone"))
        score = score.select("value", "fixed", "before").join(again, "value").select("value", "fixed", "before", F.greatest("fixed", "before", "new").alias("score"), "alone")
        score = materialize(score, "scores")
    return score.where("fixed = 0").select("value", F.greatest("score", "alone").alias("score"))


def discover(rows: DataFrame, scanned: DataFrame, rounds: int, found: float, generations: int = GENERATIONS) -> tuple[DataFrame, DataFrame | None]:
    """(value) of the identifiers that the seeds led to, and the places of instances without digits (None: none were looked at).

    Each generation's identifiers induce the contexts of the next.
    """
    met = meetings(scanned)
    contexts = met.where("pattern NOT LIKE 'shape:%'")
    edges = met.where("pattern LIKE 'shape:%'").withColumn("total", F.lit(None).cast("long"))
    induced = contexts.where("seed").groupBy("pattern").agg(F.sum("n").alias("filled"))
    places, patterns, known = None, None, None
    for generation in range(generations):
        induced = materialize(induced, "induced")
        if generation and induced.isEmpty():
            break
        more, free = induce(rows, contexts, induced)
        edges, patterns = edges.unionByName(more), induced.select("pattern") if patterns is None else patterns.union(induced.select("pattern"))
        if free is not None:
            places = free if places is None else places.unionByName(free)
            contexts = contexts.unionByName(free.groupBy("value", "pattern").agg(F.lit(False).alias("seed"), F.count("*").alias("n")))
        known = materialize(score_graph(edges, rounds, known).where(F.col("score") >= found), "known")
        mine = contexts.join(known.select("value"), "value", "left_semi")
        induced = mine.join(patterns, "pattern", "left_anti").groupBy("pattern").agg(F.sum("n").alias("filled"))
    return known.select("value"), None if places is None else places.drop("pattern").distinct()


def _extracted(rows: DataFrame, rounds: int, found: float) -> DataFrame:
    """Per row of ``rows`` (doc_id, text, digest): doc_id, digest, base counts and digest, ``all_spans``."""
    scanned = materialize(scan(rows), "scanned")
    new, free = discover(rows, scanned, rounds, found)
    spots = scanned.select("doc_id", "digest", F.explode("found").alias("i")).select("doc_id", "digest", "i.*")
    entry = lambda kind: F.struct(F.col("start"), F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int").alias("rank"), F.col("end"), kind.alias("kind"))
    seeds = spots.where("kind <> ''").select("doc_id", "digest", entry(F.col("kind")).alias("s"))
    other = spots.where("kind = ''").select("doc_id", "digest", "start", "end", "value")
    other = other if free is None else other.unionByName(free)
    added = other.join(new, "value", "left_semi").select("doc_id", "digest", entry(F.lit("id")).alias("s"))
    per_text = seeds.union(added).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("s")).alias("all_spans"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    joined = scanned.drop("found", "row").alias("a").join(per_text.alias("b"), same, "left").select("a.*", "b.all_spans")
    return joined.withColumn("all_spans", F.coalesce("all_spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, found: float = FOUND) -> DataFrame:
    """Per row: doc_id, base counts and digest, and ``all_spans``: array of (start, rank, end, kind)."""
    return _extracted(identified(docs, id_col, text_col), rounds, found).drop("digest")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in angle brackets; n_chars follows.

    Spans come back by id and a 128-bit digest of the text.
    """
    names, schema = docs.columns, docs.schema
    taken = {c.lower() for c in names}
    fresh = []
    for name in ("id", "digest", "spans"):
        while name in taken:
            name += "_"
        fresh.append(name)
        taken.add(name)
    key, mark, spot = fresh
    spans = _extracted(identified(docs), ROUNDS, FOUND).where(F.size("all_spans") > 0).dropDuplicates(["doc_id", "digest"])
    spans = spans.select(F.coalesce("doc_id", F.lit(-1)).alias(key), F.col("digest").alias(mark), F.col("all_spans").alias(spot))
    # rows without an id meet those of id -1, whose spans are the same where the text is
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(mark, digest(F.col("text")))
    marked = keyed.join(spans.dropDuplicates([key, mark]), [key, mark], "left").select(*names, spot)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None, spans: list | None) -> str | None:
        if not spans:
            return text
        out, done = [], 0
        for s in spans:
            if s["end"] <= done:
                continue
            out += [text[done : max(done, s["start"])], f"<{s['kind'].upper()}>" if s["start"] >= done else ""]
            done = s["end"]
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = [clean(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), batch.column(len(names)), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    rows = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text(F.col("all_spans")).alias("spans"),
        count("secret").alias("n_secret"), count("id").alias("n_id"), F.size("all_spans").cast("long").alias("n_spans"),
    )

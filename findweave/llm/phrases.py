"""Phrase collocations by word-id suffix arrays.

Texts are cut into pieces and words once; a shard holds the word ids of many whole pieces (a cut
between pieces loses no phrase) and its own list of words, each under its language. Numpy sorts a
shard's suffixes by prefix doubling (ranks of one, two and four words); runs of equal prefixes
between neighbouring suffixes, the LCP intervals, are its distinct phrases of one to four words with
their counts.

The merge by key has two steps, so that rare phrases, which are nearly all, never travel as text.
First the intervals of all shards meet by the leading bits of a hash, in buckets, and every shard is told which of
its intervals have ``MIN_COUNT`` occurrences or more in all shards together; phrases that share
them can only be let through too many. Then the shards write those phrases out, packed by bucket, and
their counts are summed by the phrase itself, which is exact. Parts of a phrase occur at least as often as it does, so
these counts hold all that scores need.

Defined results: null and empty texts have no words; a null language counts as ``und``, together
with the language of that name; an empty language is one of its own; repeated rows count each time;
rows with a null id count like others; very long texts are cut at piece ends into several shards; a
language without candidates has no rows; ties follow the order of score, count and phrase; other
columns never take part; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.llm._blocks import Numbers, grow, grow_strings, grow_wide, shrink, shrink_strings, shrink_wide, texts_of
from findweave.llm.near_dedup import _STEP, _U, _mix
from findweave.session import materialize

#: Longest phrase; its suffix order takes two doublings.
LONGEST = 4
MIN_COUNT = 30
#: A candidate goes when a longer one around it has this share of its count, in percent.
SHADOW = 80
TOP = 2000
#: Words of a shard, bytes of text that are cut at a time, words of the corpus for each bucket of hashes.
SHARD_WORDS = 1_000_000
PART_BYTES = 4_000_000
BUCKET_WORDS = 500_000
#: First ranking of each language's candidates is dealt out to so many groups.
RANK_GROUPS = 64

#: A-Z are lower-cased; the ends of pieces become a byte that no UTF-8 text has.
END = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + END * len(_ENDS))


def _parts(text: bytes) -> Iterator[bytes]:
    """``text``, folded, in parts that end where a piece ends."""
    text, start = text.translate(_FOLD), 0
    while start < len(text):
        end = text.find(END, start + PART_BYTES) + 1 or len(text)
        yield text[start:end]
        start = end


def shard_stream(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """(words, their languages, codes) of each shard of (lang, text) batches; code 0 ends a piece, code c is word c - 1. Shards without words are left out."""

    def fresh():
        numbers = Numbers()
        numbers[None]  # code 0
        return numbers, {}, [], 0

    numbers, tables, codes, size = fresh()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            for part in _parts(text):
                table = tables.setdefault(lang, _Words(lang, numbers))
                tokens = part.replace(END, b" \xff ").split()
                codes.append(np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens)))
                codes.append(np.zeros(1, np.int64))
                size += len(tokens)
                if size >= limit:
                    if len(numbers) > 1:
                        yield *_listed(numbers), np.concatenate(codes)
                    numbers, tables, codes, size = fresh()
    if len(numbers) > 1:
        yield *_listed(numbers), np.concatenate(codes)


class _Words(dict):
    """Codes of one language's words, numbered together with those of the shard's other languages."""

    def __init__(self, lang: str, numbers: Numbers):
        super().__init__({END: 0})
        self.lang, self.numbers = lang, numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.numbers[self.lang, word]
        return n


def _listed(numbers: Numbers) -> tuple[list[bytes], list[str]]:
    keys = list(numbers)[1:]
    return [w for _, w in keys], [lang for lang, _ in keys]


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words sorted by the four codes from there on, and the LCP of each with the one before it (at most 4).

    Ranks of one code double to ranks of two, and those to the order of four. Past the end stands code 0.
    """

    def ahead(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])

    two = np.unique(codes * (codes.max(initial=0) + 1) + ahead(codes, 1), return_inverse=True)[1].astype(np.int64)
    four = two * (two.max(initial=0) + 1) + ahead(two, 2)
    words = np.flatnonzero(codes)
    order = words[np.argsort(four[words], kind="stable")]
    third = ahead(codes, 2)
    same = [np.concatenate([[False], x[order][1:] == x[order][:-1]]) for x in (codes, two, third, four)]
    lcp = np.where(same[3], 4, np.where(same[1], 2 + same[2], same[0].astype(np.int64)))
    return order, lcp


def intervals(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first positions, counts) of the distinct phrases of each length within pieces."""
    order, lcp = suffix_order(codes)
    ends = np.append(np.flatnonzero(codes == 0), len(codes))
    room = ends[np.searchsorted(ends, order)] - order
    for length in range(1, LONGEST + 1):
        whole = room >= length  # phrases that don't run past their piece; equal ones stand together
        starts = np.flatnonzero(lcp[whole] < length)
        yield length, order[whole][starts], np.diff(np.append(starts, int(whole.sum())))


def hashed(words: list[bytes], langs: list[str], codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, positions, lengths, counts) of a shard's phrases, ascending by hash."""
    of = np.zeros(len(words) + 1, _U)
    of[1:] = np.fromiter((xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + w) for w, lang in zip(words, langs, strict=True)), _U, len(words))
    out = []
    for length, at, counts in intervals(codes):
        acc = np.full(len(at), length, _U)
        for k in range(length):
            acc = _mix(acc * _STEP + of[codes[at + k]])
        out.append((acc, at.astype(np.int32), np.full(len(at), length, np.int8), counts.astype(np.int32)))
    hashes = np.concatenate([c[0] for c in out])
    order = np.argsort(hashes)
    return tuple([hashes[order], *(np.concatenate([c[k] for c in out])[order] for k in (1, 2, 3))])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets ascend with the hashes."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


_SHARD = "shard long, langs array<string>, totals array<long>, words binary, lang_of binary, codes binary"


def _code(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 24
    for number, (words, langs, codes) in enumerate(shard_stream(batches, limit)):
        named = Numbers()
        lang_of = np.fromiter((named[lang] for lang in langs), np.int64, len(langs))
        totals = np.bincount(lang_of[codes[codes > 0] - 1], minlength=len(named))
        cells = ([base + number], [list(named)], [totals.tolist()], [shrink_strings(words)], [shrink(lang_of)], [shrink(codes)])
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["shard", "langs", "totals", "words", "lang_of", "codes"])


def _decoded(row: dict) -> tuple[list[bytes], list[str], np.ndarray]:
    return grow_strings(row["words"]), [row["langs"][i] for i in grow(row["lang_of"])], grow(row["codes"])


def key_bits(words: int) -> int:
    """Leading bits of a hash by which phrases of a corpus of so many words meet.

    Five more than number the words; a key that is shared all the same lets a rare phrase through,
    whose exact count drops it later.
    """
    return min(64, max(32, words.bit_length() + 5))


def _asked(shards: DataFrame, buckets: int, bits: int) -> DataFrame:
    """(bucket, shard, keys, counts): each shard's phrases, packed by bucket; a key is a hash's first ``bits`` bits."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, _, _, counts = hashed(*_decoded(row))
                of = _bucket_of(hashes, buckets)
                edges, keys = np.flatnonzero(np.diff(of, prepend=-1)), hashes >> _U(64 - bits)
                out = [(int(of[a]), row["shard"], shrink_wide(np.diff(keys[a:b], prepend=_U(0))), shrink(counts[a:b])) for a, b in zip(edges, [*edges[1:], len(of)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard", "keys", "counts"])

    return shards.mapInArrow(run, "bucket int, shard long, keys binary, counts binary")


def _answers(asked: DataFrame, least: int) -> DataFrame:
    """(shard, bucket, kept): a bit per phrase of the shard in the bucket, set where all shards together have ``least``."""

    def run(group: pa.Table) -> pa.Table:
        each = [np.cumsum(grow_wide(h.as_py()).view(_U), dtype=_U) for h in group["keys"]]
        counts = np.concatenate([grow(c.as_py()) for c in group["counts"]])
        _, of = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(of.max() + 1, np.int64)
        np.add.at(total, of, counts)
        bits = np.split(total[of] >= least, np.cumsum([len(e) for e in each])[:-1])
        return pa.table({"shard": group["shard"], "bucket": group["bucket"], "kept": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "shard long, bucket int, kept binary")


_WRITTEN = "bucket int, langs array<string>, sizes array<int>, phrases binary, counts binary"


def _written(shards: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """(bucket, langs, sizes, phrases, counts): the phrases of a shard that the answers let through, packed by bucket.

    A bucket's phrases are in order, ``sizes`` of each language, as ordered texts pack best.
    """

    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        row = shard.to_pylist()[0]
        words, langs, codes = _decoded(row)
        hashes, at, lengths, counts = hashed(words, langs, codes)
        of = _bucket_of(hashes, buckets)
        size = np.bincount(of, minlength=buckets)
        first, kept = np.cumsum(size) - size, np.zeros(len(hashes), bool)
        for bucket, bits in zip(told["bucket"].to_pylist(), told["kept"].to_pylist(), strict=True):
            kept[first[bucket] : first[bucket] + size[bucket]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=size[bucket])
        at, lengths, counts, of = at[kept], lengths[kept], counts[kept], of[kept].tolist()
        phrases = [b" ".join([words[c - 1] for c in codes[a : a + n].tolist()]) for a, n in zip(at.tolist(), lengths.tolist(), strict=True)]
        spoken, out = [langs[c - 1] for c in codes[at].tolist()], []
        for bucket, mine in groupby(sorted(range(len(of)), key=lambda i: (of[i], spoken[i], phrases[i])), key=of.__getitem__):
            mine = list(mine)
            named = Counter(spoken[i] for i in mine)
            out.append((bucket, list(named), list(named.values()), shrink_strings([phrases[i] for i in mine]), shrink(counts[mine])))
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 5, kinds, strict=True)], names=["bucket", "langs", "sizes", "phrases", "counts"])

    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, _WRITTEN)


def _summed(written: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, length, f): the counts of all shards by the phrase itself, where they come to ``least``."""

    def run(group: pa.Table) -> pa.Table:
        langs = pa.array([lang for names, sizes in zip(group["langs"].to_pylist(), group["sizes"].to_pylist(), strict=True) for lang, n in zip(names, sizes, strict=True) for _ in range(n)], pa.string())
        phrases = pa.chunked_array([pa.array(grow_strings(p.as_py()), pa.binary()) for p in group["phrases"]])
        each = pa.table({"lang": langs, "phrase": phrases, "n": np.concatenate([grow(c.as_py()) for c in group["counts"]])})
        total = each.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total["n_sum"], least))
        phrase = total["phrase"].cast(pa.string())
        return pa.table({"lang": total["lang"], "phrase": phrase, "length": pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32()), "f": total["n_sum"]})

    return written.groupBy("bucket").applyInArrow(run, "lang string, phrase string, length int, f long")


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of one to four words that occur ``least`` times, and (lang, n), each language's words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = materialize(rows.mapInArrow(lambda batches: _code(batches, shard_words), _SHARD), "shards")
    totals = materialize(shards.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = 32 + words // BUCKET_WORDS
    narrow = shards.drop("totals")
    kept = _written(narrow, _answers(_asked(narrow, buckets, key_bits(words)), least), buckets)
    return materialize(_summed(kept, least), "phrases"), totals


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, length, a, l, r, score): the phrases of two words or more with their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = found.where("length > 1").withColumn("cut", F.explode(F.expr("sequence(1, length - 1)")))
    cut = cut.select("lang", "phrase", "length", F.col("f").alias("a"), "cut", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("head"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("length") - F.col("cut")), " ").alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    # a product of up to 26 digits, divided exactly; the quotient is at most a million
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (l + r)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return cut.groupBy("lang", "phrase", "length", "a").agg(best.alias("b")).select("lang", "phrase", "length", "a", "b.l", "b.r", "b.score")


def unshadowed(candidates: DataFrame, shadow: int = SHADOW) -> DataFrame:
    """The candidates that lie in no longer candidate with ``shadow`` percent of their count."""
    words = F.split("phrase", " ")
    longer = candidates.where("length > 2").withColumn("size", F.explode(F.expr("sequence(2, length - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, length - size + 1)")))
    around = longer.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    return candidates.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < shadow * F.col("a"), F.lit(True))).drop("around")


def _first(rows: DataFrame, by: list, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, shadow: int = SHADOW, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` candidates.

    The first ones of ``RANK_GROUPS`` groups of a language are ranked again, so no task sorts a language's candidates.
    """
    found, totals = counts(docs, lang_col, text_col, least, shard_words)
    left = unshadowed(scored(found), shadow).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    ranked = _first(_first(left, ["lang", "part"], top).drop("rank"), ["lang"], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS o(k))),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a, k FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f)),
s AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
t AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS most FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM b)) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN t ON t.lang = b.lang AND t.g = b.g WHERE most IS NULL OR 100 * most < 80 * a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000
"""

"""Phrase collocations against SQL and plain counts, in small shards, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from duck import connect, rows_of, sql_rows

from findweave.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, rank int, n int, shard long"


def _pieces(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def _plain(rows, least, shadow=80, top=2000):
    """(lang, text) rows: every phrase counted by a loop."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in _pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in n:
        found = {g: c for (x, g), c in f.items() if x == lang and c >= least and len(g) > 1}
        told = []
        for g, a in found.items():
            if any(100 * b >= shadow * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items() if len(h) > len(g)):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            told.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_sql(spark, sf_dir):
    assert rows_of(phrases.op11_phrases(spark, sf_dir)) == sql_rows(connect(sf_dir), phrases.ORACLE)


@pytest.mark.parametrize("shard_words", [40, 1000, 1_000_000])
def test_counts_of_many_shards(spark, shard_words):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a ", "b ", "C ", "dd\t", "é ", ". ", ",", "\n", "a b c "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, rnd.choice(["en", "en", "en", None, "und", ""]), "s", 0, "p", 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, top in ((3, 2000), (6, 7)):
        assert _got(phrases.collocations(docs, least=least, top=top, shard_words=shard_words)) == _plain([(r[2], r[1]) for r in rows], least, top=top)


def test_intervals_are_the_distinct_phrases():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 400):
        codes = rng.integers(0, 4, size)
        want = {k: Counter(tuple(codes[i : i + k]) for i in range(size - k + 1) if all(codes[i : i + k])) for k in range(1, 5)}
        for k, at, counts in phrases.intervals(codes):
            assert {tuple(codes[i : i + k]): c for i, c in zip(at, counts.tolist(), strict=True)} == want[k] and len(at) == len(want[k])


def test_long_texts_are_cut_at_piece_ends(monkeypatch):
    text = "one two, three four five. " * 200
    whole = list(phrases.shard_stream([pa.record_batch({"lang": ["en"], "text": [text]})], 10**9))
    monkeypatch.setattr(phrases, "PART_BYTES", 100)
    parts = list(phrases.shard_stream([pa.record_batch({"lang": ["en"], "text": [text]})], 50))
    assert len(whole) == 1 and len(parts) > 10

    def total(shards):
        out = Counter()
        for words, _, codes in shards:
            for k, at, counts in phrases.intervals(codes):
                out.update({tuple(words[c - 1] for c in codes[i : i + k]): n for i, n in zip(at, counts.tolist(), strict=True)})
        return out

    assert total(whole) == total(parts)


def test_large_counts_are_exact(spark):
    big = 3 * 10**15
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)], "lang string, phrase string, length int, f long")
    assert phrases.scored(found).first()["score"] == 2_000_000 * big // (2 * big + 8)


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None, None, None, None, None), (2, "", "en", "s", 0, "p", 1, 2, 3), (3, " \t.,\n", None, "s", 0, "p", 1, 2, 3), (4, "x y " * 50_000, "en", "s", 0, "p", 1, 2, 3)]
    rows += [(5, "tie one. tie two", None, "s", 0, "p", 1, 2, 3)] * 40 + [(None, "tie one; other words", "und", "s", 0, "p", 1, 2, 3)] * 10
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _got(phrases.collocations(docs)) == _plain([(r[2], r[1]) for r in rows], 30)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("doc_id < 4")).count() == 0


def test_shared_keys_let_phrases_through_but_not_into_the_result(spark, monkeypatch):
    monkeypatch.setattr(phrases, "key_bits", lambda words: 32)
    rows = [(i, f"w{i % 7} x{i % 3}. y{i}", "en", "s", 0, "p", 1, 2, 3) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _got(phrases.collocations(docs, least=5)) == _plain([(r[2], r[1]) for r in rows], 5)
    assert phrases.key_bits(10) == 32


def test_key_bits_follow_the_words():
    assert [phrases.key_bits(n) for n in (0, 135_000_000, 27 * 10**12, 2**62)] == [32, 33, 50, 64]


def test_phrases_travel_packed_by_bucket(spark):
    """A shard sends a row per bucket, not one per phrase, and the sums are those of the phrases."""
    rows = [(k % 2 and "en" or "de", f"a b c d{k % 7} e") for k in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    shards = phrases.materialize(docs.mapInArrow(lambda batches: phrases._code(batches, 40), phrases._SHARD), "shards").drop("totals")
    written = phrases.materialize(phrases._written(shards, phrases._answers(phrases._asked(shards, 2, 32), 2), 2), "written")
    assert written.groupBy("bucket").count().count() == 2 and written.count() <= 2 * shards.count()
    got = {(r["lang"], r["phrase"]): (r["length"], r["f"]) for r in phrases._summed(written, 2).collect()}
    want = Counter((lang, " ".join(t.split()[i : i + n])) for lang, t in rows for n in (1, 2, 3, 4) for i in range(6 - n))
    assert got == {(lang, p): (len(p.split()), n) for (lang, p), n in want.items() if n >= 2}

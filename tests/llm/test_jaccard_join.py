"""The grouped prefix join against SQL and all pairs, and on odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from duck import connect, rows_of, sql_rows

from findweave.llm import jaccard_join, near_dedup
from findweave.llm._blocks import shrink

SCHEMA = "doc_id long, text string, lang string, source string, size int, key string, digest string, component_id long, block int"


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _plain(rows):
    """All pairs of distinct texts; texts under one id are told apart."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets, root = [_set(t) for _, t in nodes], list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {r: nodes[find(i)][0] for i, r in enumerate(nodes)}
    return sorted(((d, len(_set(t)), least.get((d, t))) for d, t in rows), key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "k", "d", 5, 6) for d, t in rows], SCHEMA)


def test_matches_sql(spark, sf_dir):
    assert rows_of(jaccard_join.op13_jaccard_join(spark, sf_dir)) == sql_rows(connect(sf_dir), jaccard_join.ORACLE)


@pytest.mark.parametrize(("crowd", "seed"), [(64, 1), (2, 2)])
def test_components_match_all_pairs(spark, monkeypatch, crowd, seed):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 6, 20, 60]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(260):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", f"z{i}"])
        if rnd.random() < 0.2:
            words = words[: rnd.randint(1, len(words))] + passage  # a passage that many share links nothing by itself
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words).title()))
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    assert _got(jaccard_join.linked(_table(spark, rows).repartition(6))) == _plain(rows)


def test_groups_of_one_prefix(spark):
    """Sets with equal sizes and prefixes are one group until they are compared; chains link through others."""
    common = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(12):  # the same rare beginning, frequent shingles differ at the end
        rows.append((i, " ".join(["r1", "r2", "r3", "r4", "r5", "r6", "r7"] + common[i : i + 40])))
        rows += [(100 + 20 * i + k, " ".join([f"u{i}{k}"] * 30 + common[i : i + 40])) for k in range(3)]
    assert _got(jaccard_join.linked(_table(spark, rows))) == _plain(rows)


def test_exactly_the_threshold_links(spark):
    # 8 of 10 shingles shared: linked; 15 of 19: not
    eight = [f"a{i}" for i in range(12)]
    rows = [(1, " ".join(eight + ["b"])), (2, " ".join(eight + ["c"]))]
    assert _plain(rows)[1] == (2, 9, 1)
    nineteen = [f"d{i}" for i in range(19)]
    rows += [(3, " ".join(nineteen + ["x", "y"])), (4, " ".join(nineteen + ["p", "q"]))]
    assert _plain(rows)[3] == (4, 17, 4)
    assert _got(jaccard_join.linked(_table(spark, rows))) == _plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c d e"), (None, "one"), (8, long), (9, long + " end"), (9, long + " end"), (9, "two texts under one id here"), (10, "É 中 𝔸 b c d"), (11, "É 中 𝔸 B c d")]
    assert _got(jaccard_join.linked(_table(spark, rows))) == _plain(rows)
    assert jaccard_join.linked(_table(spark, rows).where("false")).count() == 0
    assert _got(jaccard_join.linked(_table(spark, rows[:3]))) == _plain(rows[:3])


def test_codes_of_a_block():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.sort(rng.choice(50, rng.integers(0, 9), replace=False)) for _ in range(rng.integers(1, 8))]
        steps = np.concatenate([np.diff(s, prepend=0) for s in sets])
        assert jaccard_join._codes(shrink(steps), [len(s) for s in sets]).tolist() == np.concatenate(sets).tolist()
    assert [jaccard_join.prefix_length(n) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]


def test_sets_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BATCH", 20)
    texts = [" ".join(f"w{k}x{i}" for i in range(k)) for k in (0, 3, 14, 14, 9, 40, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["rep", "text"])
    out = list(jaccard_join._hashed_sets([batch, batch.slice(0, 0)]))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2, 3], [4, 5], [6], []]
    table = jaccard_join._WordHashes()
    assert [(r["rep"], r["size"], r["bag"]) for b in out for r in b.to_pylist()] == [(k, len(s), s.tobytes()) for k, s in enumerate(jaccard_join.shingle_set(t.encode(), table) for t in texts)]

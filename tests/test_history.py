"""Composed renames against a walk over the commits."""

from __future__ import annotations

import random

from findweave.operators import renames

CHANGES = "seq int, change string, path string, previous_path string"


def _walk(commits):
    """Path of each file after all commits, by its path before the first; None if deleted."""
    return {r["path"]: r["effective_path"] for r in commits}


def test_chains_swaps_and_files_created_again(spark):
    rows = [
        (1, "R", "b", "a"), (2, "R", "c", "b"), (3, "R", "d", "c"),  # a chain
        (1, "R", "y", "x"), (1, "R", "x", "y"),  # a swap in one commit
        (2, "R", "q", "p"), (3, "R", "p", "q"),  # there and back
        (1, "D", "gone", None), (2, "A", "gone", None), (3, "R", "other", "gone"),  # what was created anew is another file
        (1, "R", "m2", "m"), (2, "D", "m2", None), (3, "A", "m2", None), (4, "M", "m2", None),
        (1, "M", "z", None), (2, "A", "new", None), (5, "R", "n2", None),
    ]
    got = _walk(renames.effective_paths(spark.createDataFrame(rows, CHANGES)).collect())
    first = {"a": "d", "x": "y", "y": "x", "p": "p", "gone": None, "m": None}
    assert {k: got[k] for k in first} == first and "z" not in got and "new" not in got and len([k for k in got if got[k] is None]) == 3


def test_random_histories(spark):
    rnd = random.Random(4)
    files = {f"f{i}": f"f{i}" for i in range(60)}  # first path -> path now
    rows, fresh = [], 0
    for seq in range(1, 25):
        living = sorted((first, now) for first, now in files.items() if now is not None)
        rnd.shuffle(living)
        for first, now in living[:4]:
            fresh += 1
            rows.append((seq, "R", f"n{fresh}", now))
            files[first] = f"n{fresh}"
        (a, one), (b, two) = living[4:6]
        rows += [(seq, "R", two, one), (seq, "R", one, two)]
        files[a], files[b] = two, one
        for first, now in living[6:7]:
            rows += [(seq, "D", now, None), (seq + 1, "A", now, None)]
            files[first] = None
    df = renames.effective_paths(spark.createDataFrame(rows, CHANGES))
    got = _walk(df.collect())
    for first, now in files.items():
        assert got.get(first, first) == now
    assert renames.effective_paths(spark.createDataFrame([], CHANGES)).count() == 0


def test_continuity_on_effective_paths(spark):
    kind = "id long, path string, name string, kind string, hash string"
    previous = spark.createDataFrame([(1, "a", "f", "k", "h1"), (2, "gone", "g", "k", "h2"), (3, "x", "f", "k", "h3"), (4, "y", "f", "k", "h4"), (5, "w", "h", "k", "h5")], kind)
    current = spark.createDataFrame([(11, "c", "f", "k", "h1"), (12, "gone", "g", "k", "h2"), (13, "y", "f", "k", "h3"), (14, "x", "f", "k", "new"), (15, "v", "h", "k", "h5")], kind)
    changes = spark.createDataFrame([(1, "R", "b", "a"), (2, "R", "c", "b"), (1, "D", "gone", None), (2, "A", "gone", None), (1, "R", "y", "x"), (1, "R", "x", "y")], CHANGES)
    got = sorted((tuple(r) for r in renames.continuity_over(previous, current, changes).collect()), key=str)
    assert got == sorted([(1, 11, "unchanged", "symbol_unchanged"), (2, None, "deleted", "file_deleted"), (3, 13, "unchanged", "symbol_unchanged"), (4, 14, "modified", "symbol_modified"), (5, 15, "moved", "symbol_moved"), (None, 12, "added", "symbol_added")], key=str)

"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree gives every vector a long hash string. A digit of it is the direction, out of up to 64
orthonormal random ones and their opposites, that the vector is closest to (vectors are extended by
one component so that the largest inner product is the smallest angle). Tree order is the order of
the strings, so the vectors that share a prefix with a query are a run of the sorted array. In each
tree a query starts from its own string and from those whose first digits are its next closest
directions; each start descends to its longest match. Then all starts of all trees ascend together,
one digit at a time and in each step the starts with the closest first digit first, until enough
vectors lie in their runs, which are scored exactly.

How many vectors are enough is fitted on a bounded sample: the smallest share at which the sample's
own neighbours are found with ``RECALL_AIM``. On vectors without structure that share is large,
whatever the index; on clustered ones it is small. A query whose runs of one digit hold too few
vectors ascends to the root, which is the whole table.

Equal vectors are folded into one entry with its smallest ids (as many as an answer can name), so
a vector that a third of the rows have costs one entry. Runs are split over tasks by prefix, where
many vectors share it by slices, and where many queries ask for it by blocks of queries; nothing of
the table but the sample is collected.

Defined results: rows whose id or vector is null, whose vector is zero, has null or non-finite
components or another length than most vectors, take no part; repeated rows of one id count once
(of several vectors under one id, the smallest counts); ties go to the smaller id; with fewer
candidates than asked for, all are returned; an empty table gives an empty result; other columns
never take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.session import materialize

TREES = 24
#: Digits of a hash string, bits of a digit, and directions of a digit at most (each with its opposite).
DIGITS, DIGIT_BITS, DIRECTIONS = 4, 7, 64
BITS = DIGITS * DIGIT_BITS
#: Starts of a query in each tree.
PROBES = 4
#: Vectors and queries of the sample that the candidate share is fitted on.
SAMPLE, SAMPLE_QUERIES = 4096, 128
RECALL_AIM = 0.95
#: Vectors that one task scores queries against, and queries' runs of one task.
SLICE, ASKED = 8192, 8192
SEED = 5


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector as doubles) of the rows that take part, each id once, and their length."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 0
    return rows.where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector")), dim


def fold_equal(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, vector, members): distinct vectors with their ``keep`` smallest ids."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= keep)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("rep"), "vector", "members")


def directions(dim: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """(trees, digits, dim + 1, directions): orthonormal directions of each digit."""
    rng, width = np.random.default_rng(seed), min(DIRECTIONS, dim + 1)
    return np.linalg.qr(rng.standard_normal((trees, DIGITS, dim + 1, width)))[0]


def _extended(x: np.ndarray, longest: float | None) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / norm if longest is None else x / longest
    rest = np.zeros_like(norm) if longest is None else np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
    return np.concatenate([unit, rest], axis=1)


def _closest(y: np.ndarray) -> np.ndarray:
    """The digit of each row of products: the number of the largest one, opposites included."""
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] > 0)


def hash_strings(x: np.ndarray, planes: np.ndarray, longest: float | None) -> np.ndarray:
    """(rows, trees) hash strings as integers; ``longest`` is None for queries."""
    full, out = _extended(x, longest), np.zeros((len(x), len(planes)), np.int64)
    for tree, digits in enumerate(planes):
        for plane in digits:
            out[:, tree] = out[:, tree] << DIGIT_BITS | _closest(full @ plane)
    return out


def starts(x: np.ndarray, planes: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(rows, trees, probes) strings that queries start from, and the closeness of their first digits."""
    own, full = hash_strings(x, planes, None), _extended(x, None)
    probes, rows = min(probes, 2 * planes.shape[3]), np.arange(len(x))[:, None]
    strings, near = np.zeros((*own.shape, probes), np.int64), np.zeros((*own.shape, probes))
    below = BITS - DIGIT_BITS
    for tree, digits in enumerate(planes):
        y = full @ digits[0]
        both = np.stack([-y, y], axis=2).reshape(len(x), -1)
        first = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        strings[:, tree] = first << below | (own[:, tree] & ((1 << below) - 1))[:, None]
        near[:, tree] = both[rows, first]
    return strings, near


def fit_share(sample: np.ndarray, planes: np.ndarray, longest: float, k: int, aim: float = RECALL_AIM) -> float:
    """Smallest sum of run lengths, as a share of all vectors, that reaches ``aim``; infinite for the whole table."""
    n = len(sample)
    if n <= 2 * k:
        return np.inf
    queries = sample[: min(SAMPLE_QUERIES, n)]
    stored, (asked, near) = hash_strings(sample, planes, longest).T, starts(queries, planes)
    needed = []
    for i, q in enumerate(queries):
        scores = sample @ q
        scores[i] = -np.inf
        best = np.argpartition(-scores, k)[:k]
        differ = (stored[:, None, :] ^ asked[i][:, :, None]).reshape(-1, n)
        match = DIGITS - -(-np.frexp(differ.astype(float))[1] // DIGIT_BITS)  # digits in common
        runs = np.stack([(match >= d).sum(1) for d in range(1, DIGITS + 2)], axis=1)
        depth, start = (z.ravel() for z in np.meshgrid(np.arange(1, DIGITS + 1), np.arange(len(runs)), indexing="ij"))
        order = np.lexsort((-near[i].ravel()[start], -depth))
        total = np.empty((DIGITS + 1, len(runs)))
        total[0] = np.inf
        total[depth[order], start[order]] = np.cumsum((runs[start, depth - 1] - runs[start, depth])[order])
        needed.append(total[match[:, best], np.arange(len(runs))[:, None]].min(0) / n)
    needed = np.sort(np.concatenate(needed))
    return float(needed[int(np.ceil(aim * len(needed))) - 1])


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(kind)], pa.binary())


def _hashed(rows: DataFrame, planes, longest: float, kind: str) -> DataFrame:
    """(rep, vector as bytes, hashes) of entries."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                h = hash_strings(x, planes.value, longest)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), _bytes(x, kind), lists], names=["rep", "vector", "hashes"])

    return rows.select("rep", "vector").mapInArrow(run, "rep long, vector binary, hashes array<long>")


def _asked(rows: DataFrame, planes, kind: str) -> DataFrame:
    """(query_id, vector as bytes, starts: array of tree, string, near) of queries."""
    schema = "query_id long, vector binary, starts array<struct<tree:int,string:long,near:double>>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                strings, near = starts(x, planes.value)
                n, trees, probes = strings.shape
                fields = [pa.array(np.tile(np.repeat(np.arange(trees, dtype=np.int32), probes), n)), pa.array(strings.ravel()), pa.array(near.ravel())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * trees * probes, pa.int32()), pa.StructArray.from_arrays(fields, ["tree", "string", "near"]))
                yield pa.RecordBatch.from_arrays([part.column(0), _bytes(x, kind), lists], names=["query_id", "vector", "starts"])

    return rows.select("vec_id", "vector").mapInArrow(run, schema)


def _head(h: Column, bits: Column | int, of: int = BITS) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", h, (F.lit(of) - bits).cast("int"))


def _ascend(spread: DataFrame, stored: DataFrame, enough: float) -> DataFrame:
    """(query_id, tree, low, high, candidates): the runs of the sorted arrays that each query takes.

    ``spread``: query_id, tree, string, near. A start that matches nothing by one digit has no run.
    """
    depths = F.explode(F.sequence(F.lit(1), F.lit(DIGITS))).alias("depth")
    prefix = _head(F.col("string"), F.col("depth") * DIGIT_BITS).alias("prefix")
    runs = stored.groupBy("tree", F.col("hash").alias("string")).agg(F.count("*").alias("n")).select("tree", "string", "n", depths).groupBy("tree", "depth", prefix).agg(F.sum("n").alias("n"))
    matched = spread.select("query_id", "tree", "string", "near", depths).withColumn("prefix", prefix).join(runs, ["tree", "depth", "prefix"])
    start = Window.partitionBy("query_id", "tree", "string").orderBy(F.desc("depth"))
    steps = matched.withColumn("more", F.col("n") - F.coalesce(F.lag("n").over(start), F.lit(0)))
    rising = Window.partitionBy("query_id").orderBy(F.desc("depth"), F.desc("near"), "tree", "string").rowsBetween(Window.unboundedPreceding, -1)
    taken = steps.withColumn("before", F.coalesce(F.sum("more").over(rising), F.lit(0))).where(F.col("before") < enough)
    chosen = taken.groupBy("query_id", "tree", "string").agg(F.min("depth").alias("depth"), F.max("n").alias("n"))
    width = F.expr(f"CAST(shiftleft(1L, CAST({BITS} - depth * {DIGIT_BITS} AS INT)) AS BIGINT)")
    low = _head(F.col("string"), F.col("depth") * DIGIT_BITS) * width
    return chosen.select("query_id", "tree", low.alias("low"), (low + width).alias("high"), "n")


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: the ``k`` nearest found for each row that ``queries`` selects.

    ``candidates`` is the number of vectors that were scored for the query, one in several runs counted in each.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    entries = materialize(fold_equal(rows, k + 1), "entries")
    count, longest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    planes = directions(dim, trees)
    sample = entries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow()["vector"]
    sample = np.array(sample.to_pylist(), float).reshape(len(sample), dim)
    enough = fit_share(sample, planes, longest or 1.0, k) * max(1, count)
    # groups of about a slice
    group_bits = int(np.clip(np.floor(np.log2(max(1, count) / SLICE)) + 1, 0, BITS))
    shared = spark.sparkContext.broadcast(planes.astype(np.float32))  # trees x digits x dimensions x directions numbers

    stored = _hashed(entries, shared, longest or 1.0, kind).select("rep", "vector", F.posexplode("hashes").alias("tree", "hash"))
    asked = materialize(_asked(rows.where(queries).withColumnRenamed("vec_id", "query_id").select(F.col("query_id").alias("vec_id"), "vector"), shared, kind), "queries")
    whole = F.lit(1 << BITS).cast("long")
    if np.isfinite(enough):
        spread = asked.select("query_id", F.explode("starts").alias("s")).select("query_id", "s.*")
        runs = materialize(_ascend(spread, stored, enough), "runs")
        reached = runs.groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") >= enough).select("query_id", "n")
        # too few vectors by one digit: the root of the first tree
        runs_of = runs.join(reached.withColumnRenamed("n", "candidates"), "query_id").select("query_id", "tree", "low", "high", "candidates")
        rooted = asked.select("query_id").join(reached, "query_id", "left_anti")
        runs_of = runs_of.unionByName(rooted.select("query_id", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("low"), whole.alias("high"), F.lit(count).cast("long").alias("candidates")))
    else:
        runs_of = asked.select("query_id", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("low"), whole.alias("high"), F.lit(count).cast("long").alias("candidates"))

    # runs are dealt out by their leading bits; crowded groups are cut into slices and blocks of queries
    group = _head(F.col("hash"), group_bits)
    crowd = materialize(stored.groupBy("tree", group.alias("group")).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "groups")
    first, last = _head(F.col("low"), group_bits), _head(F.col("high") - 1, group_bits)
    asking = runs_of.select("query_id", "tree", "low", "high", F.explode(F.sequence(first, last)).alias("group")).join(crowd, ["tree", "group"])
    asking = materialize(asking, "asking")
    blocks = asking.groupBy("tree", "group").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks"))
    index = stored.select("tree", group.alias("group"), "rep", "hash", "vector").join(crowd.join(blocks, ["tree", "group"]), ["tree", "group"])
    index = index.select("tree", "group", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "hash", "vector")
    asking = asking.join(blocks, ["tree", "group"]).select("tree", "group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id", "low"), F.col("blocks")).cast("int").alias("block"), "query_id", "low", "high")
    asking = asking.join(asked.select("query_id", "vector"), "query_id")
    keys = ["tree", "group", "slice", "block"]
    found = index.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_scorer(k + 1, kind), "query_id long, rep long, score double")

    best = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    nearest = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    named = nearest.join(entries.select("rep", "members"), "rep").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(runs_of.select("query_id", "candidates").distinct(), "query_id").select("query_id", "rank", "vec_id", "score", "candidates")


def _scorer(k: int, kind: str):
    """Best ``k`` entries of each query within the runs of one slice."""

    def vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_py() for v in column), kind).reshape(rows, -1).astype(float)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "rep": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(left["hash"].to_numpy(), kind="stable")
            strings, rep = left["hash"].to_numpy()[order], left["rep"].to_numpy()[order]
            x, q = vectors(left["vector"], left.num_rows)[order], vectors(right["vector"], right.num_rows)
            lo, hi = np.searchsorted(strings, right["low"].to_numpy()), np.searchsorted(strings, right["high"].to_numpy())
            # rounding of a product of matrices, far below
            slack = 1e-12 * x.shape[1] * np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1)
            query = right["query_id"].to_numpy()
            for a, b in np.unique(np.stack([lo, hi], 1), axis=0):
                if a == b:
                    continue
                members = np.flatnonzero((lo == a) & (hi == b))
                block, ids = x[a:b], rep[a:b]
                for s in range(0, len(members), 256):
                    mine = members[s : s + 256]
                    scores = q[mine] @ block.T
                    for row, m in zip(scores, mine, strict=True):
                        near = np.flatnonzero(row >= np.partition(row, -k)[-k] - slack[m]) if len(row) > k else np.arange(len(row))
                        exact = np.add.accumulate(block[near] * q[m], axis=1)[:, -1]  # component by component
                        top = np.lexsort((ids[near], -exact))[:k]
                        out["query_id"].append(np.full(len(top), query[m]))
                        out["rep"].append(ids[near][top])
                        out["score"].append(exact[top])
        kinds = {"query_id": pa.int64(), "rep": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()})

    return run


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

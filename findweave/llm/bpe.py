"""BPE encoding and decoding through a distinct-word table.

Texts are split into pre-tokens ("words") block by block; each block keeps its texts as numbers of
its own distinct words. The distinct words of all blocks are dealt out by their hash, so that the
rows of a word meet in one bucket, where it is encoded once (once per slice where a corpus is so
large that a bucket's rows are cut into slices); each block then joins the ids back by position. Only distinct words, their ids and packed numbers are shuffled, never the texts. Ids are
decoded through a join with the id-to-piece table, whose size is that of the vocabulary.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens in
a text are their own ids; repeated rows are encoded alike; an empty table gives an empty result;
other columns never take part. A word that every block uses is one entry of each block's rows; very
long texts are blocks of their own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findweave.llm import _tokens
from findweave.llm._blocks import BLOCK_BYTES, bucket_counts, bucket_rows, complete, grow, grow_strings, narrow, payload_rows, shrink, unpack_codes


def id_to_piece(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): one row per vocabulary entry."""
    pieces = _tokens.vocabulary(path).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(pieces.keys(), pa.int32()), "piece": pa.array(pieces.values(), pa.binary())}))


def decode(ids: DataFrame, path: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(key, text) of rows with id arrays and distinct keys, by a join with the id-to-piece table."""
    spread = ids.select(F.col(key).alias("key"), F.posexplode(ids_col).alias("pos", "id"))
    joined = spread.join(F.broadcast(id_to_piece(ids.sparkSession, path)), "id")
    at = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    text = joined.groupBy("key").agg(at.alias("at")).select(F.col("key").alias(key), F.decode(F.unhex(F.array_join(F.transform("at.piece", F.hex), "")), "utf-8").alias("text"))
    return ids.select(key).join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


class Pieces:
    """The id-to-piece table as arrays: ids join to the bytes of their pieces by position."""

    def __init__(self, path: str):
        pieces = _tokens.vocabulary(path).pieces
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.fromiter(map(len, ordered), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[at + np.arange(len(at))].tobytes()


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_buckets(words: DataFrame, path: str) -> DataFrame:
    """(block, idx, sizes, ids) of each slice's rows; every distinct word of a slice is encoded once."""

    def run(group: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        encode, out = _tokens.vocabulary(path).ids, []
        for packed in group["words"]:
            flat, sizes = [], []
            for word in grow_strings(packed.as_py()):
                ids = known.get(word)
                if ids is None:
                    known[word] = ids = encode(word.decode())
                flat += ids
                sizes.append(len(ids))
            out.append((shrink(np.array(sizes, np.int64)), shrink(np.array(flat, np.int64))))
        return pa.table({"block": group["block"], "check": group["check"], "idx": group["idx"], "sizes": pa.array([o[0] for o in out], pa.binary()), "ids": pa.array([o[1] for o in out], pa.binary())})

    return words.groupBy("bucket", "slice").applyInArrow(run, "block long, check long, idx binary, sizes binary, ids binary")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def join_back(payload: DataFrame, encoded: DataFrame, path: str, each, schema: str) -> DataFrame:
    """``each(doc_id, ids, decoded bytes)`` for every document, from blocks and their words' ids."""
    typed = _arrow(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, rows = _pieces(path), []
        for block in left.to_pylist():
            n = block["n_words"]
            sizes, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            flat, size, seen = [], 0, 0
            parts = right.to_pylist()
            for part in parts:
                at, own, ids = np.cumsum(grow(part["idx"])), grow(part["sizes"]), grow(part["ids"])
                sizes[at], starts[at] = own, size + np.cumsum(own) - own
                flat.append(ids.astype("<u4"))
                size, seen = size + len(ids), seen + len(at)
            complete(block, parts, seen)
            raw = np.concatenate([*flat, np.zeros(0, "<u4")]).astype("<u4").tobytes()
            ids_of = [raw[4 * a : 4 * (a + k)] for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
            codes, start = unpack_codes(block["codes"]), 0
            for doc_id, k in zip(block["ids"], block["counts"], strict=True):
                ids = b"".join([ids_of[c] for c in codes[start : start + k].tolist()])
                rows.append(each(doc_id, ids, pieces.join(np.frombuffer(ids, "<u4"))))
                start += k
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(typed), typed, strict=True)], schema=typed)

    return payload.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, schema)


def encode_documents(docs: DataFrame, each, schema: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """Encode and decode every document; ``each`` makes the output row from ids and decoded bytes."""
    path = vocabulary or _tokens.default_path()

    def cut(text: bytes) -> list[str]:
        return _tokens.vocabulary(path).split(text.decode("utf-8", "replace"))

    rows = narrow(docs, id_col, text_col)
    encoded = encode_buckets(bucket_rows(rows, cut, bucket_counts(rows), limit).drop("uses"), path)
    return join_back(payload_rows(rows, cut, limit), encoded, path, each, schema)


def token_ids(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit bytes, decoded text) of every document."""
    return encode_documents(docs, lambda d, ids, text: (d, ids, text.decode("utf-8", "replace")), "doc_id long, ids binary, text string", **options)


def _digest(doc_id: int, ids: bytes, text: bytes) -> tuple:
    return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

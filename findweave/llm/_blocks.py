"""Helpers shared by the text operators: Arrow batches, word splitting, document blocks.

A *word* is a run of bytes outside space and 0x09-0x0D; ``bytes.split()`` splits on exactly
these, so words are cut from UTF-8 bytes without decoding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters (bytes) of text in one block; one longer document is a block of its own.
BLOCK_BYTES = 8_000_000


#: Text whose words meet in one slice of a bucket.
SLICE_BYTES = 128_000_000


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null for a null column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; a null text is the empty text."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for start in range(0, len(binary), 256):
        for item in binary.slice(start, 256):
            yield item.as_py() or b""


class Numbers(dict):
    """Numbers its keys in the order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns never travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def digest(text: Column) -> Column:
    """128 bits of the text's MD5; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def block_stream(batches: Iterable[pa.RecordBatch], cut: Callable[[bytes], list], limit: int) -> Iterator[tuple]:
    """(block id, doc ids, words of the block, per document a code array) for each block.

    Codes number the distinct words of the block in order of first use. Block ids come from
    the partition number and a counter, so a recomputed partition gets the same ids.
    """
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 24
    number, ids, codes, size, table = 0, [], [], 0, Numbers()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), texts_of(batch.column(1)), strict=True):
            if ids and size + len(text) > limit:
                yield base + number, ids, list(table), codes
                number, ids, codes, size, table = number + 1, [], [], 0, Numbers()
            words = cut(text)
            codes.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
            ids.append(doc_id.as_py())
            size += len(text)
    if ids:
        yield base + number, ids, list(table), codes


def pack_codes(codes: list[np.ndarray]) -> bytes:
    return zlib.compress(np.concatenate(codes).astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes() if codes else b"", 1)


def unpack_codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1) if len(raw) else np.zeros(0, np.uint32)


def shrink(values: np.ndarray) -> bytes:
    """Non-negative numbers under 2**32, byte planes apart, compressed."""
    return zlib.compress(np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def grow(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def shrink_wide(values: np.ndarray) -> bytes:
    """Like ``shrink``, for numbers up to 2**63."""
    low = shrink(np.asarray(values) & 0xFFFFFFFF)
    return len(low).to_bytes(4, "little") + low + shrink(np.asarray(values) >> 32)


def grow_wide(data: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(data[:4], "little")
    return grow(data[4:n]) | grow(data[n:]) << 32


def shrink_strings(items: list[bytes]) -> bytes:
    sizes = shrink(np.fromiter(map(len, items), np.int64, len(items)))
    return len(sizes).to_bytes(4, "little") + sizes + zlib.compress(b"".join(items), 1)


def grow_strings(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends, blob = np.cumsum(grow(data[4 : 4 + n])).tolist(), zlib.decompress(data[4 + n :])
    return [blob[a:b] for a, b in zip([0, *ends][:-1], ends, strict=True)]


def bucket_counts(rows: DataFrame) -> tuple[int, int]:
    """Buckets of words, and slices of each bucket, for the text of ``rows``.

    Distinct words grow about with the square root of a text, and so do the buckets. What the
    blocks ask of a bucket grows faster; it is cut by block into slices of about ``SLICE_BYTES``
    of text, so that a group never holds a row of every block.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, 2 * math.isqrt(total // 1_000_000))
    return buckets, max(1, -(-total // (buckets * SLICE_BYTES)))


def checksum(words: list) -> int:
    """Of a block's distinct words in order; tells whether two scans made the same block."""
    return zlib.crc32(b"\n".join(w.encode() if isinstance(w, str) else w for w in words))


def bucket_rows(rows: DataFrame, cut: Callable[[bytes], list], counts: tuple[int, int], limit: int = BLOCK_BYTES, held: Callable[[int], bool] | None = None) -> DataFrame:
    """The distinct words of each block, packed by the bucket of their hash.

    (bucket, slice, block, check, idx, words, uses); ``uses`` counts occurrences in documents for which
    ``held`` is false (all, if not given).
    """
    buckets, slices = counts
    kinds = {"bucket": pa.int32(), "slice": pa.int32(), "block": pa.int64(), "check": pa.int64(), "idx": pa.binary(), "words": pa.binary(), "uses": pa.binary()}

    def run(batches):
        for block, ids, words, codes in block_stream(batches, cut, limit):
            if not words:
                continue
            check = checksum(words)
            words = [w.encode() if isinstance(w, str) else w for w in words]
            counted = [c for d, c in zip(ids, codes, strict=True) if held is None or not held(d)]
            uses = np.bincount(np.concatenate(counted), minlength=len(words)) if counted else np.zeros(len(words), np.int64)
            of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1))
            out = []
            for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
                idx = order[lo:hi]
                out.append((int(of[idx[0]]), zlib.crc32(b"%d" % block) % slices, block, check, shrink(np.diff(idx, prepend=0)), shrink_strings([words[i] for i in idx]), shrink(uses[idx])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(run, "bucket int, slice int, block long, check long, idx binary, words binary, uses binary")


def payload_rows(docs: DataFrame, cut: Callable[[bytes], list], limit: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: its document ids, their word counts, the packed word codes and the checksum of its words."""

    def run(batches):
        for block, ids, words, codes in block_stream(batches, cut, limit):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(c) for c in codes]], pa.list_(pa.int32())),
                    pa.array([len(words)], pa.int32()), pa.array([checksum(words)], pa.int64()), pa.array([pack_codes(codes)], pa.binary()),
                ],
                names=["block", "ids", "counts", "n_words", "check", "codes"],
            )

    return docs.mapInArrow(run, "block long, ids array<long>, counts array<int>, n_words int, check long, codes binary")


def complete(block: dict, parts: list[dict], seen: int) -> None:
    """Stops if the words that came back aren't those that the block was coded with."""
    if seen != block["n_words"] or any(p["check"] != block["check"] for p in parts):
        raise RuntimeError(f"block {block['block']} was read differently: its input isn't the same in every scan")

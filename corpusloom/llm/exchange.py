"""Counting and matching of hashed keys across a corpus without a row per key.

Map tasks turn a stretch of texts into a *block*: sorted or positional arrays of 64-bit keys. A
block is cut by key into parts, one row of packed arrays per part; a part's task sorts what it
gets with numpy. So a key that every document holds costs one entry per block, shuffles move
packed bytes, and memory is bounded by the size of a part, which shrinks as parts are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Words, encoded, steps

#: Bytes of text in a block.
BLOCK = 4 << 20


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the top bits, so that a part's keys need not carry them."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)


def low_bytes(h: np.ndarray, n: int) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(packed: list[bytes], n: int) -> np.ndarray:
    wide = np.zeros((sum(map(len, packed)) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, n)
    return wide.view("<u8")[:, 0]


def scatter(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that occurs, the indices of its entries in order."""
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if at[p] < at[p + 1]:
            yield p, order[at[p] : at[p + 1]]


def gaps(s: np.ndarray) -> bytes:
    """Rising numbers as differences. The first byte says how: 1 in bytes, where 255 goes on; else their width."""
    d = np.diff(s, prepend=0)
    more = d // 255
    if more.sum() <= len(d):
        out = np.full(len(d) + int(more.sum()), 255, np.uint8)
        out[np.cumsum(more + 1) - 1] = d % 255
        return b"\1" + out.tobytes()
    return b"\2" + d.astype("<u2").tobytes() if d.max() < 1 << 16 else b"\4" + d.astype("<u4").tobytes()


def ungaps(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, f"<u{b[0]}", offset=1)
    at = np.cumsum(x.astype(np.int64))
    return at[x != 255] if b[0] == 1 else at


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the first byte says how many."""
    top = int(x.max(initial=0))
    n = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([n]) + x.astype(f"<u{n}").tobytes()


def offset(x: np.ndarray) -> bytes:
    """Whole numbers of any size and sign, as their least and what is above it."""
    least = int(x.min()) if len(x) else 0
    return np.array([least], "<i8").tobytes() + small((x.view(U64) - np.array([least], np.int64).view(U64)).astype(U64) if x.dtype == np.int64 else x.astype(np.int64) - least)


def unoffset(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, f"<u{b[8]}", offset=9).astype(U64)
    return (x + np.frombuffer(b, "<u8", count=1)).view(np.int64)


def unsmall(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[pa.Table]:
    """Whole stretches of rows with about ``size`` bytes of text; a longer text is alone."""
    held, n = [], 0
    for part in steps(batches, text, size // 4):
        b = pa.compute.sum(pa.compute.binary_length(part.column(part.schema.get_field_index(text)))).as_py() or 0
        if held and n + b > size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(part)
        n += b
    if held:
        yield pa.Table.from_batches(held)


def block_words(table: pa.Table, lower: bool, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and where each row's words begin. Cut in steps to bound memory."""
    h, n = [], []
    for part in steps(table.to_batches(), text):
        texts = encoded(part.column(part.schema.get_field_index(text)))
        w = Words([t.lower() for t in texts] if lower else texts)
        h.append(w.h)
        n.append(w.counts())
    counts = np.concatenate(n)
    return np.concatenate(h), np.concatenate([[0], np.cumsum(counts)])


def rows(schema: pa.Schema, values: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*values, strict=True)) if values else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def grouped(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    return df.groupBy(key).applyInArrow(fn, schema)

"""Lexical retrieval packing: a sharded BM25 index hands each seed its unused neighbours.

Documents are tokenised once (a byte-level BPE) and end with ``END``. Whole windows of a long
document are sequences by themselves and never move. What is left of each document (its *tail*)
goes to a shard of the index. Shards are runs of ``shard`` tails in an order by content, so that
documents about the same meet: by the nearest of ``CENTROIDS`` points in the plane of the strongest
``AXES`` components of BM25 vectors (fitted on about ``SAMPLE`` documents, which only shapes the
order: every document is indexed), then by *signature* (the weightiest BM25 terms of the whole
document that some other document holds too). Partitions are ranges of that order, cut at quantiles
of the sample. A hash of id and ids deals equal places out to all ranges that they fill, so that rows
of equal or null ids, copies, or one hot source spread. Inverse document frequencies are counted over the whole corpus (at most one number per
vocabulary entry).

Within a shard, the longest unused tail is the seed. It queries the shard's inverted index with all
of its terms (``terms`` may limit them to the weightiest), and every unused neighbour that fits is
taken by falling BM25 score, then any unused tail; the first that does not fit is cut to fill the
window. So only the last window of a partition's shards has padding. A seed does not query other
shards; the README gives the recall against an index of everything.

Defined results: a null text counts as empty, one piece with ``END`` alone; rows of equal ids, or
without one, are packed apart; ties go by order within the shard; an empty table gives none. Ids
must be whole numbers. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, parts_for, steps, stored

WIDTH = 2048
END = 1
SHARD = 1024
K1, B = 1.2, 0.75
#: A term that one in so many tails of a shard holds is common.
COMMON = 8
#: Terms of a signature, and the bits of each.
SIGNATURE, BITS = 3, 21
#: Documents that the order is fitted on (expected; four times as many at most), weightiest terms of each, components, points.
SAMPLE, WEIGHTIEST, AXES, CENTROIDS = 2048, 512, 6, 32
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a ``tokenizers`` byte-level BPE file, added tokens included, without special ones around a text.

    What lies between added tokens is encoded by the same vocabulary as ranks (a faster encoder of
    the same ids; tests compare the two).
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.ordinary = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if not any(x in text for x in self.added):
            return self.ordinary(text)
        out = []
        for x in self.cut.split(text):
            out.extend([self.added[x]] if x in self.added else self.ordinary(x))
        return out


def encoder(path: str | None = None) -> Encoder:
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Rows doc_id, n (tokens with END), ids (binary, little-endian, as wide as the vocabulary needs: ``Encoder.kind``), counts.

    ``counts`` is null but in a row that each task ends with, which has nothing else: pairs of an id and the documents that
    hold it; -1 stands for the documents, -2 for their tokens.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        n, total, held = 0, 0, np.zeros(encode.size, np.int64)
        width, place = "H" if encode.kind == "<u2" else "I", np.zeros(encode.size, np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for part in steps(batches, "text", STEP):
            size, ids = [], []
            for t in part.column(1).to_pylist():
                own = array(width, encode(t or ""))
                own.append(END)
                size.append(len(own))
                ids.append(own.tobytes())
                x, at = np.frombuffer(own, encode.kind), np.arange(len(own))
                place[x] = at
                held[x[place[x] == at]] += 1  # each id once, at its last place
            n += len(ids)
            total += sum(size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        at = np.flatnonzero(held)
        counts = np.column_stack([np.concatenate([[-2, -1], at]), np.concatenate([[total, n], held[at]])]).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def document_frequencies(counts: DataFrame, size: int) -> tuple[int, np.ndarray, float]:
    """Number of documents, of those that hold each id, and their mean length, from ``counts`` of ``tokenise``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "df"])

    rows = counts.select("counts").where("counts is not null").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    got = {r.id: r.df for r in rows}  # at most one row per vocabulary entry
    out = np.zeros(size, np.int64)
    for i, n in got.items():
        if i >= 0:
            out[i] = n
    n = got.get(-1, 0)
    return n, out, got.get(-2, 0) / max(1, n)


def _gain(idf: np.ndarray, tf: np.ndarray, length: np.ndarray | float, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, width: int = WIDTH, terms: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its tail, length); every id of every tail in exactly one."""
    n = len(tails)
    length = np.array([len(t) for t in tails], np.int64)
    key, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64) << 32, length) | np.concatenate(tails), return_counts=True)
    doc, term = key >> 32, np.unique(key & 0xFFFFFFFF, return_inverse=True)
    idf, term = idf[term[0]], term[1]
    gain = _gain(idf[term], tf, length[doc], length.mean())
    by_term = np.argsort(term, kind="stable")
    post_doc, post_gain = doc[by_term], gain[by_term]
    begin = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
    # terms that many tails hold are rows of a small matrix, the others posting lists
    held = np.diff(begin)
    common = np.flatnonzero(held * COMMON >= n)
    row = np.full(len(idf), -1)
    row[common] = np.arange(len(common))
    table = np.zeros((len(common), n), np.float32)
    often = row[term] >= 0
    table[row[term[often]], doc[often]] = gain[often]
    of_doc = np.searchsorted(doc, np.arange(n + 1))

    rest, at = length.copy(), np.zeros(n, np.int64)
    order = np.argsort(-length, kind="stable")
    first, out = 0, []
    while True:
        while first < n and not rest[order[first]]:
            first += 1
        if first == n:
            return out
        seed = int(order[first])
        sequence, room = [(seed, int(at[seed]), int(rest[seed]))], width - int(rest[seed])
        rest[seed] = 0
        if room:
            a, b = of_doc[seed], of_doc[seed + 1]
            asked = term[a:b] if terms is None else term[a:b][np.argsort(-gain[a:b], kind="stable")[:terms]]
            rare = asked[row[asked] < 0]
            size = held[rare]
            where = np.repeat(begin[rare] - np.cumsum(size) + size, size) + np.arange(size.sum())
            score = np.bincount(post_doc[where], post_gain[where], n) + table[row[asked[row[asked] >= 0]]].sum(0)
            score[rest == 0] = 0
            near = np.flatnonzero(score)
            near = near[np.argsort(-score[near], kind="stable")]
            size, at_near, cut = rest[near], 0, -1
            while room and at_near < len(near):  # all that fit in a row, then on to the next that fits
                held_to = np.cumsum(size[at_near:])
                k = int(np.searchsorted(held_to, room, side="right"))
                took = near[at_near : at_near + k]
                sequence.extend(zip(took.tolist(), at[took].tolist(), rest[took].tolist(), strict=True))
                room -= int(held_to[k - 1]) if k else 0
                rest[took] = 0
                at_near += k
                if at_near < len(near):
                    cut = int(near[at_near]) if cut < 0 else cut
                    fits = size[at_near:] <= room
                    at_near = at_near + int(fits.argmax()) if fits.any() else len(near)
            k = first
            while room:
                if cut < 0:
                    while k < n and not rest[order[k]]:
                        k += 1
                    if k == n:
                        break
                    cut = int(order[k])
                take = min(room, int(rest[cut]))
                sequence.append((cut, int(at[cut]), take))
                at[cut] += take
                rest[cut] -= take
                room -= take
                cut = -1
        out.append(sequence)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def whole_windows(tokens: DataFrame, kind: str, width: int = WIDTH) -> DataFrame:
    """Pieces of ``width`` ids; their sequences count from 2 ** 62 up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (1 << 62) + (TaskContext.get().partitionId() << 40)
        for part in steps(batches, "ids"):
            rows = []
            for d, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                x = np.frombuffer(x, kind)
                for a in range(0, len(x) - width + 1, width):
                    rows.append((d, a, width, len(x), number, 0, x[a : a + width].astype("<u4").tobytes()))
                    number += 1
            yield _table(rows)

    return tokens.where(F.col("n") >= width).mapInArrow(run, PIECES)


@dataclass
class Weights:
    """What turns ids into BM25 vectors, and the order by content."""

    kind: str
    frequency: np.ndarray
    idf: np.ndarray
    mean: float
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # vocabulary x AXES
    points: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # CENTROIDS x AXES
    cuts: list[tuple[int, int]] = field(default_factory=list)  # (point, signature) where ranges begin

    def vector(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms that other documents hold too, heaviest first, and their weights."""
        term, tf = np.unique(x, return_counts=True)
        some = self.frequency[term] > 1
        term = term[some].astype(np.int64)
        gain = _gain(self.idf[term], tf[some], len(x), self.mean)
        order = np.argsort(-gain, kind="stable")
        return term[order], gain[order]

    def place(self, x: np.ndarray) -> tuple[int, int]:
        """Nearest point and signature."""
        return self.place_of(*self.vector(x))

    def range_of(self, point: int, sig: int, tie: int) -> int:
        """The range that a place is in; one of those that it fills, by ``tie``."""
        low, high = (bisect(self.cuts, (point, sig)) for bisect in (bisect_left, bisect_right))
        return low + tie % (high - low + 1)

    def place_of(self, term: np.ndarray, gain: np.ndarray) -> tuple[int, int]:
        sig = sum((int(t) & ((1 << BITS) - 1)) << BITS * (SIGNATURE - 1 - i) for i, t in enumerate(term[:SIGNATURE]))
        at = gain @ self.axes[term] / max(1e-9, float(np.sqrt(gain @ gain)))
        return int(((self.points - at) ** 2).sum(1).argmin()), sig


def fit_order(tokens: DataFrame, w: Weights, n: int, ranges: int = 1) -> None:
    """Components of a sample's BM25 vectors by subspace iteration, points among them by k-means, and where ``ranges`` begin."""
    every = max(1, n // SAMPLE)
    rows = tokens.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(every)) == 0).limit(4 * SAMPLE).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "ids"):
            got = [w.vector(np.frombuffer(x, w.kind)) for x in part.column(1).to_pylist()]
            cut = [(t[:WEIGHTIEST].astype("<i8").tobytes(), g[:WEIGHTIEST].astype("<f8").tobytes()) for t, g in got]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cut], pa.binary()) for k in (0, 1)], names=["t", "g"])

    got = sorted((bytes(r.t), bytes(r.g)) for r in rows.mapInArrow(run, "t binary, g binary").collect())
    rng = np.random.default_rng(0)
    axes = np.zeros((len(w.idf), AXES))
    if not got:
        w.axes, w.points = axes, np.zeros((1, AXES))
        return
    vectors = [(np.frombuffer(t, "<i8"), np.frombuffer(g, "<f8")) for t, g in got]
    row = np.repeat(np.arange(len(got)), [len(t) for t, _ in vectors])
    term = np.concatenate([t for t, _ in vectors])
    x = np.concatenate([g / max(1e-9, np.sqrt(g @ g)) for _, g in vectors])
    used, col = np.unique(term, return_inverse=True)
    sums = lambda at, values, size: np.column_stack([np.bincount(at, x * v, size) for v in values.T])
    left = np.linalg.qr(rng.normal(size=(len(got), AXES)))[0] if len(got) >= AXES else rng.normal(size=(len(got), AXES))
    for _ in range(8):
        right = sums(col, left[row], len(used))
        right /= np.maximum(np.sqrt((right**2).sum(0)), 1e-9)
        right = np.linalg.qr(right)[0] if len(used) >= AXES else right
        left = sums(row, right[col], len(got))
    axes[used] = right
    at = left
    points = at[rng.choice(len(at), min(CENTROIDS, len(at)), replace=False)]
    for _ in range(10):
        near = ((at[:, None] - points) ** 2).sum(2).argmin(1)
        points = np.array([at[near == k].mean(0) if (near == k).any() else points[k] for k in range(len(points))])
    w.axes, w.points = axes, points[np.lexsort(points.T[::-1])]
    places = sorted(w.place_of(t, g) for t, g in vectors)
    w.cuts = [places[len(places) * k // ranges] for k in range(1, ranges)]


def tails(tokens: DataFrame, w: Weights, width: int = WIDTH) -> DataFrame:
    """Rows range, point, sig, tie, doc_id, n, start, ids: what whole windows leave of each document, placed by all of it."""
    names = ["range", "point", "sig", "tie", "doc_id", "n", "start", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "ids"):
            rows = []
            for d, n, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                start = n // width * width
                if start == n:
                    continue
                x = np.frombuffer(ids, w.kind)
                point, sig = w.place(x)
                tie = zlib.crc32(ids, zlib.crc32(str(d).encode()))
                rows.append((w.range_of(point, sig, tie), point, sig, tie, d, n, start, x[start:].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "range" else pa.binary() if k == "ids" else pa.int64()) for c, k in zip(cols, names, strict=True)], names=names)

    return tokens.mapInArrow(run, "range int, point long, sig long, tie long, doc_id long, n long, start long, ids binary")


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, width: int = WIDTH, shard: int = SHARD, terms: int | None = None,
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit little-endian)."""
    size, kind = encoder(tokenizer).size, encoder(tokenizer).kind
    tokens = stored(tokenise(df, id_col, text_col, tokenizer), "tokens")
    n, frequency, mean = document_frequencies(tokens, size)
    tokens = tokens.where("counts is null").select("doc_id", "n", "ids")
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    ranges = max(1, min(parts_for(df), -(-n // shard)))
    weights = Weights(kind, frequency, idf, mean)
    fit_order(tokens, weights, n, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, []

        def packed(last: bool) -> pa.RecordBatch:
            """The held tails' pieces; what a window that is not full holds waits for the next shard."""
            nonlocal number, held
            rows, left, ids = [], [], [np.frombuffer(x[-1], kind) for x in held]
            for sequence in pack_shard(ids, idf, width, terms):
                if not last and sum(m for _, _, m in sequence) < width:
                    left += [(*held[d][:2], held[d][2] + a, ids[d][a : a + m].tobytes()) for d, a, m in sequence]
                    continue
                offset = 0
                for d, a, m in sequence:
                    doc, whole, start, _ = held[d]
                    rows.append((doc, start + a, m, whole, number, offset, ids[d][a : a + m].astype("<u4").tobytes()))
                    offset += m
                number += 1
            held = left
            return _table(rows)

        fresh = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                fresh += 1
                if fresh == shard:
                    yield packed(False)
                    fresh = 0
        if held:
            yield packed(True)

    by = tails(tokens, weights, width).repartitionById(ranges, F.col("range")).sortWithinPartitions("point", "sig", "tie", "doc_id", "n")
    return by.select("doc_id", "n", "start", "ids").mapInArrow(run, PIECES).unionAll(whole_windows(tokens, kind, width))

"""N-gram Jaccard join with signature trees.

A document is its set of distinct word shingles. Documents with equal sets are one *set*. Shingles
are counted by parts (see ``exchange``) over distinct sets. In the order rarest first, two sets
that link share a shingle among the first ``n - ceil(t n) + 1`` of each (prefix filter). A shingle
that one set alone holds links nothing, so only sets whose prefix reaches shared shingles go on,
with their shared shingles alone: an intersection needs no others.

Sets that share a prefix shingle are then compared. First each with one pivot per shingle, which
joins most groups of near copies at one comparison per set. Where sets of one shingle still lie in
different components, they form blocks (cut by size band and, if large, into pairs of chunks). In
a block, the sets are leaves of a signature tree whose nodes hold the OR of token bitmaps and size
ranges. A dual traversal drops node pairs whose greatest possible overlap is too small, or whose
sets are connected already; what reaches two leaves is verified exactly. So components are exact,
while groups are never gathered whole and never expanded into all pairs.

Defined results: null or empty texts have no shingles and link with nothing (a component of their
own id, null for a null id); fewer words than a shingle make one; an empty table gives none. Repeated
rows each keep their own; a null id never names a group that has another. Ties do not arise: the
smallest id names a group. Ids must be whole numbers; other columns are unchanged, whatever their
names. Shingles are told apart by 56 bits within a part of the key space, in counts and in the last
comparison alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, drop_stored, mix, steps, stored, window_starts, windows
from .exchange import block_words, blocks, from_low_bytes, gaps, grouped, low_bytes, part_of, parts_of, rows, scatter, small, ungaps, unsmall

WORDS = 4
#: Sets link when DEN * intersection >= NUM * union.
NUM, DEN = 85, 100
#: Sets in a chunk of a block.
CHUNK = 256
LEAF, FAN = 8, 4
#: Bytes of a shingle's key besides its part.
BYTES = 7
_ASK = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("at", pa.binary()), ("sid", pa.binary()), ("n", pa.binary()), ("first", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ordered by document and value, and where each begins."""
    at = window_starts(first, size)
    key, owner = [windows(h, size)[at]], [np.searchsorted(first, at, side="right") - 1]
    count = np.diff(first)
    for short in range(1, size):
        own = np.flatnonzero(count == short)
        if len(own):
            key.append(mix(windows(h, short)[first[own]] ^ U64(short)))
            owner.append(own)
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(first)))


def set_ids(key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, of two sums over its members and its size."""
    p = np.concatenate([[U64(0)], np.cumsum(mix(key))])
    q = np.concatenate([[U64(0)], np.cumsum(mix(key ^ U64(0x5851F42D4C957F2D)))])
    a, b = begin[:-1], begin[1:]
    return mix((p[b] - p[a]) ^ mix((q[b] - q[a]) ^ mix((b - a).astype(U64)))).view(np.int64)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows doc_id, n_shingles, sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            key, begin = shingles(*block_words(table, lower=True), size)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(np.diff(begin), pa.int64()), pa.array(set_ids(key, begin))], names=["doc_id", "n_shingles", "sid"]
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid long")


def _need(n: int | np.ndarray, num: int, den: int):
    """Least overlap of a set of n with any that it links with."""
    return -(-num * n // den)


def candidates(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Sets that may link: sid, n, prefix (shared shingles in it), members (its shared shingles, sorted), stored."""
    parts = parts_of(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            key, begin = shingles(*block_words(table, lower=True), size)
            sid, n = set_ids(key, begin), np.diff(begin)
            owner = np.repeat(np.arange(len(n)), n)
            out = []
            for p, i in scatter(part_of(key, parts), parts):
                own = np.unique(owner[i])
                out.append((p, low_bytes(key[i], BYTES), gaps(i), sid[own].astype("<i8").tobytes(), small(n[own]), small(begin[own])))
            yield rows(_ASK, out)

    def shared(_: tuple, table: pa.Table) -> pa.Table:
        keys, ids, ns = [], [], []
        for r in table.to_pylist():
            own = np.searchsorted(unsmall(r["first"]), ungaps(r["at"]), side="right") - 1
            keys.append(r["key"])
            ids.append(np.frombuffer(r["sid"], "<i8")[own])
            ns.append(unsmall(r["n"]).astype(np.int32)[own])
        key, sid, n = from_low_bytes(keys, BYTES), np.concatenate(ids), np.concatenate(ns)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        order = order[(np.diff(np.concatenate([np.flatnonzero(new), [len(k)]])) > 1)[np.cumsum(new) - 1]]
        key, sid, n = key[order], sid[order], n[order]
        order = np.lexsort((sid, key))
        key, sid, n = key[order], sid[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid, n = key[new], sid[new], n[new]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        df = np.repeat(*(np.diff(np.concatenate([head, [len(key)]])),) * 2)
        four = np.stack([sid, n.astype(np.int64), key.view(np.int64), df])[:, df > 1]
        return pa.Table.from_batches([rows(_SHARED, [(b, np.ascontiguousarray(four[:, i]).tobytes()) for b, i in scatter(part_of(mix(four[0].view(U64)), parts), parts)])])

    def choose(_: tuple, table: pa.Table) -> pa.Table:
        four = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in table["data"].to_pylist()], 1)
        sid, n, key, df = four[:, np.lexsort((four[2].view(U64), four[3], four[0]))]
        head = np.flatnonzero(np.diff(sid, prepend=~sid[:1]))
        size_, n = np.diff(np.concatenate([head, [len(sid)]])), n[head]
        reach = n - _need(n, num, den) + 1 - (n - size_)
        out = []
        for i in np.flatnonzero(reach > 0):
            own = key[head[i] : head[i] + size_[i]]
            out.append((int(sid[head[i]]), int(n[i]), own[: reach[i]].tolist(), np.sort(own.view(U64)).tobytes()))
        return pa.Table.from_batches([rows(_CANDIDATE, out)])

    asked = docs.select("text").mapInArrow(ask, "part int, key binary, at binary, sid binary, n binary, first binary")
    found = grouped(grouped(asked, "part", shared, "bucket int, data binary"), "bucket", choose, "sid long, n long, prefix array<long>, members binary")
    return stored(found, "candidates")


_CANDIDATE = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("members", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _links(n: int, m: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (n + m - both)


class Tree:
    """Signature tree: leaves hold sets of similar size; nodes the OR of bitmaps, size range, collisions."""

    def __init__(self, n: np.ndarray, members: list[np.ndarray], width: int):
        order = np.argsort(n, kind="stable")
        bits = np.zeros((len(n), width), bool)
        for i, j in enumerate(order):
            bits[i, (members[j] & U64(width - 1)).astype(np.int64)] = True
        sign = np.packbits(bits, axis=1).view(np.uint64)
        extra = np.array([len(members[j]) for j in order]) - bits.sum(1)
        self.order = order
        level = [(sign, n[order], n[order], extra)]
        for step in (LEAF, *[FAN] * 40):
            s, lo, hi, x = level[-1]
            if len(lo) == 1 and len(level) > 1:
                break
            at = np.arange(0, len(lo), step)
            level.append((np.bitwise_or.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(x, at)))
        self.level = level

    def top(self) -> tuple[int, int]:
        return len(self.level) - 1, 0

    def children(self, level: int, i: int) -> tuple[int, range]:
        step = LEAF if level == 1 else FAN
        return level - 1, range(i * step, min((i + 1) * step, len(self.level[level - 1][1])))


def tree_join(n, members, root: list[int], left: list[int], right: list[int] | None, num: int, den: int, allowed=None) -> list[tuple[int, int]]:
    """Links that connect components: pairs of positions. ``root`` names each position's component.

    Without ``right`` the left side is joined with itself. Sets connected on the way are not compared.
    """
    n = np.asarray(n, np.int64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    width = 256
    while width < min(1 << 15, 4 * int(n.max(initial=1))):
        width *= 2
    sides = [np.array(x, np.int64) for x in (left, right if right is not None else left)]
    trees = [Tree(n[x], [members[i] for i in x], width) if len(x) else None for x in sides]
    if not (trees[0] and trees[1]):
        return []
    if right is None:
        trees[1] = trees[0]
    x, y = trees
    out, stack = [], [(*x.top(), *y.top())]
    while stack:
        i, a, j, b = stack.pop()
        if right is None and i == j and a > b:
            continue
        s, lo, hi, e = (v[a] for v in x.level[i])
        t, lo2, hi2, e2 = (v[b] for v in y.level[j])
        if den * hi < num * lo2 or den * hi2 < num * lo:
            continue
        need = -(-num * (lo + lo2) // (num + den))
        if min(int(np.bitwise_count(s & t).sum()) + min(e, e2), hi, hi2) < need:
            continue
        if i == 0 and j == 0:
            p, q = int(sides[0][x.order[a]]), int(sides[1][y.order[b]])
            if p == q or (allowed is not None and not allowed(p, q)):
                continue
            u, v = find(root[p]), find(root[q])
            if u != v and _links(int(n[p]), int(n[q]), _overlap(members[p], members[q]), num, den):
                parent[u] = v
                out.append((p, q))
        elif i >= j:
            to, own = x.children(i, a)
            if right is None and i == j:  # open both, or half of a level's pairs would be lost
                to2, own2 = y.children(j, b)
                stack += [(to, c, to2, d) for c in own for d in own2]
            else:
                stack += [(to, c, j, b) for c in own]
        else:
            to, own = y.children(j, b)
            stack += [(i, a, to, c) for c in own]
    return out


def links(found: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that give the exact components of the candidates."""
    spark = found.sparkSession
    posts = found.select("sid", F.explode("prefix").alias("token"))
    pivots = posts.groupBy("token").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    star = posts.join(pivots, "token").where("sid <> pivot").select("sid", "pivot").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "x"):
            a, n, x, b, m, y = (c.to_pylist() for c in part.columns)
            ok = [_links(k, l, _overlap(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")), num, den) for k, p, l, q in zip(n, x, m, y, strict=True)]
            yield rows(_LINK, [(p, q) for p, q, good in zip(a, b, ok, strict=True) if good])

    one = found.select("sid", "n", F.col("members").alias("x"))
    two = found.select(F.col("sid").alias("pivot"), F.col("n").alias("m"), F.col("members").alias("y"))
    near = star.join(found.select("sid", "n"), "sid").join(two, "pivot").where((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num))
    first = near.drop("n").join(one, "sid").select("sid", "n", "x", "pivot", "m", "y").mapInArrow(verify, "a long, b long")
    first = stored(first, "star")
    joined = components(first)

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9)
    rest = posts.join(found.select("sid", "n"), "sid").join(joined.withColumnRenamed("id", "sid"), "sid", "left")
    rest = rest.select("token", "sid", F.coalesce("component", "sid").alias("root"), band.alias("own"))
    # sets that link lie in one band or in neighbouring ones: block b holds b and b - 1
    rest = stored(rest.withColumn("band", F.explode(F.array("own", F.col("own") + 1))), "posts")
    h = F.xxhash64("sid")
    block_ = rest.groupBy("token", "band").agg(
        F.count("*").alias("c"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), ((F.min("root") < F.max("root")) & (F.max("own") == F.col("band"))).alias("open")
    ).where("open")
    alone = block_.groupBy("band", "c", "s", "x").agg(F.min("token").alias("token"))  # blocks of the same sets count once
    size = alone.select("token", "band", F.ceil(F.col("c") / CHUNK).alias("chunks"))
    cut = rest.join(size, ["token", "band"]).withColumn("chunk", F.pmod(F.xxhash64("sid", "token"), F.col("chunks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cut = cut.select("token", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "own", "sid", "root")
    cut = cut.join(found.select("sid", "n", "members"), "sid")

    def block(key: tuple, table: pa.Table) -> pa.Table:
        _, b, i, j = (k.as_py() for k in key)
        table = table.sort_by("sid")
        sid, own, chunk = (table[c].to_pylist() for c in ("sid", "own", "chunk"))
        members = [np.frombuffer(x, "<u8") for x in table["members"].to_pylist()]
        left = [k for k, c in enumerate(chunk) if c == i]
        right = None if i == j else [k for k, c in enumerate(chunk) if c == j]
        got = tree_join(table["n"].to_numpy(), members, table["root"].to_pylist(), left, right, num, den, lambda p, q: own[p] == b or own[q] == b)
        return pa.Table.from_batches([rows(_LINK, [(sid[p], sid[q]) for p, q in got])])

    second = stored(cut.groupBy("token", "band", "i", "j").applyInArrow(block, "a long, b long"), "tree")
    drop_stored(rest)
    return first.union(second)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable, itself included)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = candidates(docs, size, num, den)
    joined = components(links(found, num, den)).select(F.col("id").alias("sid"), "component")
    named = stored(sets(docs, size), "sets")
    own = named.where("n_shingles > 0").join(joined, "sid", "left").select("doc_id", "sid", F.coalesce("component", "sid").alias("root"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # one row per set: groups of copies do not meet in this join
    of_set = own.select("sid", "root").distinct().join(least, "root").select("sid", "component_id")
    return named.join(of_set, "sid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows whose id is the smallest of its group; columns unchanged. Rows without an id stay."""
    gone = similar_groups(df, id_col=id_col, **options).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")



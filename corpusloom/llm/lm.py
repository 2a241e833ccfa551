"""Bigram language model by deleted interpolation.

P(w | v) = a2[b] c(v,w)/c(v) + a1[b] c(w)/N + a0[b]/(V+1), where b is the bucket (power of two) of
the context's count c(v). The weights of each bucket are learned by expectation-maximisation on
held-out counts: a fifth of the documents may not be learned from at all (``held_out``); of the
others, those with remainder 0 are the deleted part, on whose tokens the weights are fitted with
counts of the rest. The final counts are of all training documents.

Tokens are A-Z-lower-cased words and an end; the first word's context is an end. Null texts count
as empty: one end. Counts travel as in ``exchange``: each block of texts asks every part for the
counts of its own distinct words and bigrams, so all statistics are exact, grow with the corpus
and never meet in one place. Bigram keys are 48 bits within a part, word keys 64: counts of bigrams
that share a key add up, one in about 2 ** 48 / (distinct bigrams of a part).

Defined results: null and empty texts score their end alone; rows with a null id count as id "" (their
role is that text's) and keep a null id; repeated rows count as often as they come; an empty table
gives none, one without training documents gives scores from uniform weights. Ids must be whole
numbers; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_stored, mix, settled, stored
from .exchange import block_words, blocks, from_low_bytes, gaps, grouped, low_bytes, part_of, parts_of, rows, scatter, small, ungaps, unsmall

HELD_OUT, DELETED, MODULUS = 1, 0, 5
BUCKETS = 48
#: Steps per doubling in which EM sees the ratios of its components.
FINE = 4
ROUNDS = 200
#: Bytes of a key besides its part, for words and bigrams.
BYTES = {1: 8, 2: 6}
_END = U64(0xA5A5F00DFACE1234)
_PAIR = U64(0xC2B2AE3D27D4EB4F)
_ASK = pa.schema([("part", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("at", pa.binary()), ("key", pa.binary()), ("train", pa.binary()), ("deleted", pa.binary())])
_ANSWER = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("at", pa.binary()), ("train", pa.binary()), ("deleted", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_deleted", pa.int64()), ("v_rest", pa.int64())])
_ASK_SQL = "part int, block string, kind int, at binary, key binary, train binary, deleted binary"
_ANSWER_SQL = "block string, kind int, at binary, train binary, deleted binary, n long, v long, n_deleted long, v_rest long"


class Block:
    """Tokens of a block as local word numbers (0 is the end), with the words' hashes."""

    def __init__(self, table: pa.Table, number: int):
        h, first = block_words(table, lower=True)
        self.docs, self.role = table["doc_id"].to_pylist(), table["role"].to_numpy()
        self.n = np.diff(first) + 1
        words, inverse = np.unique(h, return_inverse=True)
        self.hash = np.concatenate([[_END], words])
        ends = np.cumsum(self.n) - 1
        self.token = np.zeros(int(self.n.sum()), np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = inverse + 1
        self.owner_role = np.repeat(self.role, self.n)
        # the same rows are read twice: where a block lies and what it holds is its name
        self.name = f"{TaskContext.get().partitionId()}-{number}-" + hashlib.blake2b(repr(self.docs).encode() + h.tobytes(), digest_size=12).hexdigest()

    def pairs(self) -> np.ndarray:
        before = np.concatenate([[0], self.token[:-1]])
        return before * len(self.hash) + self.token  # the token before a text is the last text's end


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for number, table in enumerate(blocks(batches)):
        b = Block(table, number)
        train, deleted = b.owner_role != HELD_OUT, b.owner_role == DELETED
        pair, at = np.unique(b.pairs(), return_inverse=True)
        first, second = np.divmod(pair, len(b.hash))
        for kind, where, key in ((1, b.token, b.hash), (2, at, mix(b.hash[first] * _PAIR ^ mix(b.hash[second])))):
            t, d = (np.bincount(where[m], minlength=len(key)) for m in (train, deleted))
            out = []
            for p, i in scatter(part_of(key, parts), parts):
                out.append((p, b.name, kind, gaps(i), low_bytes(key[i], BYTES[kind]), small(t[i]), small(d[i])))
            yield rows(_ASK, out)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    out = []
    for kind in (1, 2):
        t = table.filter(pa.compute.equal(table["kind"], kind))
        if not t.num_rows:
            continue
        packed = t["key"].to_pylist()
        keys = from_low_bytes(packed, BYTES[kind])
        train, deleted = (np.concatenate([unsmall(x) for x in t[c].to_pylist()]) for c in ("train", "deleted"))
        uniq, at = np.unique(keys, return_inverse=True)
        c, d = (np.bincount(at, x, len(uniq)).astype(np.int64) for x in (train, deleted))
        if kind == 1:
            out.append((None, 0, None, None, None, int(c.sum()), int((c > 0).sum()), int(d.sum()), int((c > d).sum())))
        lo = 0
        for name, x, g in zip(t["block"].to_pylist(), packed, t["at"].to_pylist(), strict=True):
            hi = lo + len(x) // BYTES[kind]
            out.append((name, kind, g, small(c[at[lo:hi]]), small(d[at[lo:hi]]), None, None, None, None))
            lo = hi
    return pa.Table.from_batches([rows(_ANSWER, out)])


_DOC = pa.schema([("doc_id", pa.int64()), ("role", pa.int32()), ("n", pa.int64()), ("word", pa.binary()), ("word_d", pa.binary()), ("pair", pa.binary()), ("pair_d", pa.binary())])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, table in enumerate(blocks(batches)):
        b = Block(table, number)
        yield rows(_TOKEN, [(b.name, -1, small(b.token), _ids(b.docs), small(b.n), small(b.role))])


_TOKEN = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("at", pa.binary()), ("train", pa.binary()), ("deleted", pa.binary()), ("role", pa.binary())])


def _ids(docs: list) -> bytes:
    return np.array([-(1 << 63) if d is None else d for d in docs], "<i8").tobytes()


def _join(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of a block's tokens, cut by document; those of the deleted part only where EM reads them."""
    mine = table.filter(pa.compute.equal(table["kind"], -1)).to_pylist()[0]
    token, n, role = unsmall(mine["at"]), unsmall(mine["deleted"]), unsmall(mine["role"])
    docs = np.frombuffer(mine["train"], "<i8")
    size = int(token.max()) + 1
    got = {}
    for kind, length in ((1, size), (2, None)):
        t = table.filter(pa.compute.equal(table["kind"], kind)).to_pylist()
        if kind == 2:
            before = np.concatenate([[0], token[:-1]])
            _, at = np.unique(before * size + token, return_inverse=True)
            length = int(at.max()) + 1
        else:
            at = token
        c, d, seen = np.zeros(length, np.int64), np.zeros(length, np.int64), 0
        for r in t:
            i = ungaps(r["at"])
            c[i], d[i] = unsmall(r["train"]), unsmall(r["deleted"])
            seen += len(i)
        if seen != length:
            raise RuntimeError("a block was answered in part: the input's rows changed their order between reads")
        got[kind] = c[at], d[at]
    out, lo = [], 0
    for doc, m, r in zip(docs.tolist(), n.tolist(), role.tolist(), strict=True):
        cut = slice(lo, lo + m)
        kept = [small(x[cut]) if r == DELETED or not of_deleted else None for k in (1, 2) for of_deleted, x in enumerate(got[k])]
        out.append((None if doc == -(1 << 63) else doc, r, m, *kept))
        lo += m
    return pa.Table.from_batches([rows(_DOC, out)])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """A stored row per document with its tokens' counts, and totals of the training documents."""
    spark = df.sparkSession
    parts = parts_of(spark)
    docs = df.select(
        df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % MODULUS).cast("int").alias("role")
    )
    docs = settled(docs)  # read twice
    asked = docs.mapInArrow(lambda batches: _ask(batches, parts), _ASK_SQL)
    answers = stored(grouped(asked, "part", _answer, _ANSWER_SQL), "counts")
    t = answers.where("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_deleted", "v_rest"))).first().asDict()
    tokens = docs.mapInArrow(_tokens, "block string, kind int, at binary, train binary, deleted binary, role binary")
    both = tokens.unionByName(answers.where("kind > 0").select("block", "kind", "at", "train", "deleted", F.lit(None).cast("binary").alias("role")))
    out = stored(grouped(both, "block", _join, "doc_id long, role int, n long, word binary, word_d binary, pair binary, pair_d binary"), "tokens")
    drop_stored(answers)
    return out, t


def _context(word: np.ndarray, ends: int) -> np.ndarray:
    return np.concatenate([[ends], word[:-1]])


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(c + 1.0)).astype(np.int64), BUCKETS - 1)


def fit(tokens: DataFrame, totals: dict[str, int]) -> np.ndarray:
    """Weights by bucket, columns uniform, word, bigram. The histogram is bounded by its bins."""
    n, v = max(1, totals["n"] - totals["n_deleted"]), totals["v_rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            keys = []
            for r in batch.to_pylist():
                word, wd, pair, pd = (unsmall(r[c]) for c in ("word", "word_d", "pair", "pair_d"))
                word, pair = word - wd, pair - pd
                context = _context(word, word[-1])
                one = np.where(word > 0, np.rint(FINE * np.log2(np.maximum(word, 1) / n * (v + 1))) + 200, 0)
                two = np.where(pair > 0, np.rint(FINE * np.log2(np.maximum(pair, 1) / np.maximum(context, 1) * (v + 1))) + 200, 0)
                keys.append((_bucket(context) << 40) | (np.maximum(one, 0).astype(np.int64) << 20) | np.maximum(two, 0).astype(np.int64))
            for k, c in zip(*(x.tolist() for x in np.unique(np.concatenate(keys), return_counts=True)), strict=True) if keys else ():
                total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["k", "c"])

    got = tokens.where(F.col("role") == DELETED).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    k = np.array([r.k for r in got], np.int64)
    c = np.array([r.c for r in got], np.float64)
    bucket, one, two = k >> 40, (k >> 20) & 0xFFFFF, k & 0xFFFFF
    p = np.stack([np.ones(len(k)), np.where(one > 0, 2.0 ** ((one - 200) / FINE), 0), np.where(two > 0, 2.0 ** ((two - 200) / FINE), 0)], 1)
    a = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = a[bucket] * p
        share *= (c / share.sum(1))[:, None]
        new = np.ones((BUCKETS, 3))  # one count each keeps every weight above zero
        np.add.at(new, bucket, share)
        new /= new.sum(1, keepdims=True)
        if np.abs(new - a).max() < 1e-9:
            break
        a = new
    return a


def score(tokens: DataFrame, totals: dict[str, int], weights: np.ndarray) -> DataFrame:
    n, v = totals["n"], totals["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                word, pair = unsmall(r["word"]), unsmall(r["pair"])
                context = _context(word, word[-1])
                a = weights[_bucket(context)]
                p = a[:, 0] / (v + 1) + a[:, 1] * word / max(1, n) + a[:, 2] * pair / np.maximum(context, 1)
                base = np.log10((word + 0.5) / (n + 0.5 * (v + 1))).sum()
                out.append((r["doc_id"], r["role"] == HELD_OUT, r["n"], int((word > 0).sum()), n, float(base), float(np.log10(p).sum())))
            yield rows(_SCORE, out)

    return tokens.select("doc_id", "role", "n", "word", "pair").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row. Learns, then scores every whole text."""
    tokens, totals = token_counts(df, id_col, text_col)
    return score(tokens, totals, fit(tokens, totals))

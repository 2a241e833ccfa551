"""Substring dedup by De Bruijn compaction.

Every run of ``K`` words is an edge between its first and last ``K - 1`` words. Edges are counted
by parts (see ``exchange``); an edge that occurs in more than one document gets its source: its
first place in the document with the smallest id. Where successive edges of a document have
successive sources the path between them does not branch, so they compact to one fragment
(document, start, edges, source document, source start). A fragment is verified by its source
coordinates: the words there and the document's own must give the same digest. Fragments
that meet at a node compact to paths, and Spark joins chain those of a document's stretches into
maximal repeated paths, which are cut out.

A word goes if an edge that covers it occurs in a document with a smaller id; edges are judged on
the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null texts have no words. Rows with a null
id come last. Rows are told apart by id and text; equal rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_stored, encoded, mix, steps, stored, window_starts, windows
from .exchange import block_words, blocks, from_low_bytes, gaps, grouped, low_bytes, offset, part_of, parts_of, rows, scatter, small, ungaps, unoffset, unsmall

K = 13
#: Words of a stretch that one bucket compacts, so that a long document is dealt out.
RANGE = 4096
#: Bytes of an edge's key besides its part.
BYTES = 7
LAST = (1 << 63) - 1  # stands for a null id: after all others
_ASK = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("at", pa.binary()), ("doc", pa.binary()), ("text", pa.binary()), ("first", pa.binary())])
_SIX = ("doc", "text", "at", "src_doc", "src_text", "src_at")
_EDGE = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _SIX)])
_EDGE_SQL = "bucket int, " + ", ".join(f"{c} binary" for c in _SIX)
_FRAGMENT = pa.schema([(c, pa.int64()) for c in ("doc", "k", "start", "edges", "src_doc", "src_k", "src_start", "path", "path_edges")])
_FRAGMENT_SQL = ", ".join(f"{c} long" for c in _FRAGMENT.names)


def _ask(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    for table in blocks(batches):
        h, first = block_words(table, lower=False)
        doc, text = table["doc"].to_numpy(), table["k"].to_numpy()
        at = window_starts(first, size)
        if not len(at):
            continue
        key = windows(h, size)[at]
        owner = np.searchsorted(first, at, side="right") - 1
        out = []
        for p, i in scatter(part_of(key, parts), parts):
            own = np.unique(owner[i])
            out.append((p, low_bytes(key[i], BYTES), gaps(at[i]), offset(doc[own]), text[own].astype("<i8").tobytes(), small(first[own])))
        yield rows(_ASK, out)


def _sources(buckets: int):
    def run(_: tuple, table: pa.Table) -> pa.Table:
        docs, texts, pos = [], [], []
        for r in table.to_pylist():
            at, first = ungaps(r["at"]), unsmall(r["first"])
            own = np.searchsorted(first, at, side="right") - 1
            docs.append(unoffset(r["doc"])[own])
            texts.append(np.frombuffer(r["text"], "<i8")[own])
            pos.append((at - first[own]).astype(np.int32))
        key = from_low_bytes(table["key"].to_pylist(), BYTES)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        many = (np.diff(np.concatenate([np.flatnonzero(new), [len(key)]])) > 1)[group]
        order, group = order[many], group[many]
        doc, text, at = np.concatenate(docs)[order], np.concatenate(texts)[order].astype(np.int64), np.concatenate(pos)[order].astype(np.int64)
        by = np.lexsort((at, text, doc, group))
        doc, text, at, group = doc[by], text[by], at[by], group[by]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        src = np.repeat(head, np.diff(np.concatenate([head, [len(group)]])))
        later = doc > doc[src]
        six = np.stack([doc[later], text[later], at[later], doc[src][later], text[src][later], at[src][later]])
        bucket = part_of(mix(six[1].view(U64) ^ mix(six[0].view(U64)) ^ mix((six[2] // RANGE).view(U64))), buckets)
        return pa.Table.from_batches([rows(_EDGE, [(b, *(offset(x) for x in six[:, i])) for b, i in scatter(bucket, buckets)])])

    return run


def _fragments(_: tuple, table: pa.Table) -> pa.Table:
    six = np.stack([np.concatenate([unoffset(x) for x in table[c].to_pylist()]) for c in _SIX])
    six = six[:, np.lexsort((six[2], six[1], six[0]))]
    step = np.diff(six, axis=1)
    goes_on = (step[[0, 1, 3, 4]] == 0).all(0) & (step[[2, 5]] == 1).all(0) & (six[2, 1:] % RANGE != 0)
    head = np.flatnonzero(np.concatenate([[True], ~goes_on])) if six.shape[1] else np.zeros(0, np.int64)
    edges = np.diff(np.concatenate([head, [six.shape[1]]]))
    d, k, p, sd, sk, sp = six[:, head]
    meets = np.zeros(len(head), bool)  # the fragment before it ends where it begins
    meets[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (p[1:] == p[:-1] + edges[:-1]) & (p[1:] // RANGE == p[:-1] // RANGE)
    first = np.flatnonzero(~meets)
    length = np.add.reduceat(edges, first) if len(first) else edges
    times = np.diff(np.concatenate([first, [len(head)]]))
    return pa.table([pa.array(x, pa.int64()) for x in (d, k, p, edges, sd, sk, sp, np.repeat(p[first], times), np.repeat(length, times))], schema=_FRAGMENT)


def _identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[id_col].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("k"), text.alias("text"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def repeated_fragments(docs: DataFrame, size: int = K) -> DataFrame:
    """Fragments with ``ok``: the words at both places give one digest. Stored."""
    spark = docs.sparkSession
    parts, buckets = parts_of(spark), parts_of(spark)
    asked = docs.select("doc", "k", "text").mapInArrow(lambda b: _ask(b, size, parts), "part int, key binary, at binary, doc binary, text binary, first binary")
    edges = grouped(asked, "part", _sources(buckets), _EDGE_SQL)
    found = stored(grouped(edges, "bucket", _fragments, _FRAGMENT_SQL), "fragments")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            out = []
            for doc, k, text, places in zip(*(part.column(i).to_pylist() for i in (0, 1)), encoded(part.column(2)), part.column(3).to_pylist(), strict=True):
                words = text.split()
                out += [(doc, k, p["start"], p["edges"], _digest(words[p["start"] : p["start"] + p["edges"] + size - 1])) for p in places]
            yield rows(schema, out)

    schema = pa.schema([("doc", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("edges", pa.int64()), ("digest", pa.binary())])
    own = ["doc", "k", "start", "edges"]
    sides = found.select(own).union(found.select("src_doc", "src_k", "src_start", "edges")).distinct()
    # a document's list is bounded by its own words: places are distinct
    wanted = sides.groupBy("doc", "k").agg(F.collect_list(F.struct("start", "edges")).alias("places"))
    made = docs.select("doc", "k", "text").join(wanted, ["doc", "k"]).mapInArrow(digests, "doc long, k long, start long, edges long, digest binary")
    made = stored(made.dropDuplicates(own), "digests")  # equal rows give equal digests
    source = made.select(F.col("doc").alias("src_doc"), F.col("k").alias("src_k"), F.col("start").alias("src_start"), "edges", F.col("digest").alias("expected"))
    checked = found.join(made, own).join(source, ["src_doc", "src_k", "src_start", "edges"]).select(*own, "path", "path_edges", (F.col("digest") == F.col("expected")).alias("ok"))
    out = stored(checked, "checked")
    drop_stored(found)
    drop_stored(made)
    return out


def paths(fragments: DataFrame, rounds: int = 40) -> DataFrame:
    """Maximal repeated paths of verified fragments: doc, k, start, edges.

    A stretch of ``RANGE`` words compacts its own fragments; stretches' paths that meet are chained by
    pointer doubling. A path with a fragment that failed falls back to its other fragments.
    """
    whole = fragments.groupBy("doc", "k", "path", "path_edges").agg(F.min("ok").alias("whole"))
    odd = fragments.where("ok").join(whole.where("not whole"), ["doc", "k", "path", "path_edges"], "left_semi").select("doc", "k", "start", "edges")
    f = whole.where("whole").select("doc", "k", F.col("path").alias("start"), F.col("path_edges").alias("edges")).union(odd)
    f = f.select("doc", "k", "start", (F.col("start") + F.col("edges")).alias("end"))
    met = f.select("doc", "k", F.col("end").alias("start")).distinct().withColumn("inner", F.lit(True))
    # a path's inner fragments begin where another of the same text ends
    link = stored(f.join(met, ["doc", "k", "start"], "left").withColumn("inner", F.col("inner").isNotNull()), "paths")
    for _ in range(rounds):
        ahead = link.select("doc", "k", F.col("start").alias("end"), F.col("end").alias("far"))
        new = stored(link.join(ahead, ["doc", "k", "end"], "left").select("doc", "k", "start", "inner", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")), "paths")
        done = new.where("moved").isEmpty()
        drop_stored(link)
        link = new.drop("moved")
        if done:
            break
    return link.where("not inner").select("doc", "k", "start", (F.col("end") - F.col("start")).alias("edges"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = K) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (text), kept_sha256."""
    docs = _identified(df, id_col, text_col)
    spans = paths(repeated_fragments(docs, size)).groupBy("doc", "k").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            out = []
            for doc, text, found in zip(part.column(0).to_pylist(), encoded(part.column(1)), part.column(2).to_pylist(), strict=True):
                words = text.split()
                keep = np.ones(len(words), bool)
                for s in found or ():
                    keep[s["start"] : s["start"] + s["edges"] + size - 1] = False
                kept = b" ".join(words if keep.all() else [w for w, x in zip(words, keep.tolist(), strict=True) if x])
                out.append((doc, len(words), int(len(words) - keep.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield rows(schema, out)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
    one = docs.join(spans, ["doc", "k"], "left").select("doc_id", "text", "spans")
    return one.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

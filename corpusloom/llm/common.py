"""Helpers shared by the operators: chunked Arrow iteration, vectorised word hashing, shared tables.

Words are cut on bytes: ``bytes.lower`` touches only A-Z and ``bytes.split`` cuts at exactly
``\\x20\\x09-\\x0D``, which are the word rules that the operators use.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
# Workers live through many stages: freed memory goes back at once, large arrays to the system.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD of the GNU C library
#: Characters that end an alphanumeric word: \x00-\x2F \x3A-\x40 \x5B-\x60 \x7B-\x7F; A-Z become a-z.
ALNUM = bytes(
    (c + 32) if 0x41 <= c <= 0x5A else 0x20 if (c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) else c
    for c in range(256)
)
#: Bytes of text that one vectorised step handles, unless a single text is longer.
STEP = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R, _Q = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def _inverse(a: np.uint64) -> np.uint64:
    return U64(pow(int(a), -1, 1 << 64))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(n, b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_RP, _QP = _Powers(_R), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of several texts: ``h`` their 64-bit hashes, ``first[i]:first[i+1]`` those of text i."""

    __slots__ = ("h", "first", "start", "end", "buf")

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.buf, np.uint8)
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _RP.get(len(b) + 1)
        p = np.zeros(len(b) + 1, U64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=p[1:])
        self.h = mix((p[self.end] - p[self.start]) * down[self.start])
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items, at its first item; the runs take no account of text ends."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = _QP.get(n + 1)
    p = np.zeros(n + 1, U64)
    np.cumsum(h * up[:n], out=p[1:])
    return mix((p[k:] - p[:-k]) * down[: n - k + 1])


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices at which a run of k words stays inside its text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    last = np.repeat(first[1:], np.diff(first))
    ok = np.arange(n) + k <= last
    return np.flatnonzero(ok)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterable[pa.RecordBatch], text: str, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum([0 if x is None else x for x in pc.binary_length(col).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` does it faster where there is nothing but ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


#: Rows of an Arrow batch: texts can be long, and both ends of the pipe hold whole batches.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where unset (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        at = f"file://{tempfile.gettempdir()}/corpusloom-checkpoints"
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return at


#: Whether Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder. It outlives lost executors and goes with the session at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the write's shuffle files go when it is done
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if reading it again gives the same rows in the same order; stored once if its plan shuffles or is random."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, "settled") if re.search(r"Exchange|\bSample\b|\brand\(|\buuid\(|InArrow|InPandas|PythonUDF|EvalPython", plan) else df


def drop_stored(df: DataFrame) -> None:
    """Removes a table made by ``stored`` once nothing reads it."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(df: DataFrame) -> int:
    """Partitions of explicit exchanges: what the session is tuned to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of links a-b (long ids): rows id, component = smallest id reachable.

    Each round takes the least label among neighbours and then the label's own label, so that
    long chains halve; every round is written to the shared folder. No group is gathered: hubs
    are reduced by ``min``, which combines before the shuffle.
    """
    both = stored(
        edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
        .union(edges.select(F.col(b).alias("id"), F.col(a).alias("to")))
        .where("id <> to")
        .distinct(),
        "links",
    )
    label = stored(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        new = label.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        up = new.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        new = stored(new.join(up, "next").select("id", F.least("next", "jump").alias("component"), "old"), "labels")
        done = new.where("component <> old").isEmpty()
        drop_stored(label)
        label = new.select("id", "component")
        if done:
            return label
    raise RuntimeError("components did not settle")

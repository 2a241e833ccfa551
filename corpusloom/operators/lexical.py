"""Per-text lexical measures. Inputs have text_id and tokens; results have one row per text.

Counting goes through (text, token) groups that combine before the shuffle, so a long text is not
one task; windows are partitioned by text and token, or by text and block, never by text alone.
"""

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import kept
from ..functions.wordlists import LATINATE, NOT_GERUNDS, POSSESSIVES, PRONOUNS
from .filters import spans

BLOCK, LEAST_BLOCK = 5000, 4000
#: Tokens that a worker numbers at once.
TOKENS = 1 << 20


def frequencies(texts: DataFrame) -> DataFrame:
    """Rows text_id, token, f. Counted within each Arrow batch first, so a row is shuffled for each text and token of a batch, not for each token."""
    kind = dict(texts.dtypes)["text_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ids = b.column(1), b.column(0).dictionary_encode("encode")
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            t = pa.table([ids.indices.take(pa.array(at)), lists.flatten()], ["id", "token"]).group_by(["id", "token"], use_threads=False).aggregate([([], "count_all")])
            made = pa.table([pa.chunked_array([ids.dictionary.take(c) for c in t["id"].chunks], b.column(0).type), t["token"], t["count_all"]], ["text_id", "token", "f"])
            yield from made.combine_chunks().to_batches(1 << 16)

    some = texts.select("text_id", "tokens").mapInArrow(run, f"text_id {kind}, token string, f long")
    return some.groupBy("text_id", "token").agg(F.sum("f").alias("f"))


def frequency_metrics(texts: DataFrame) -> DataFrame:
    """n_tokens, n_types, TTR, yules_k, avg_word_length, hapax_ratio, dis_ratio, word_burstiness; 0 where too short."""
    f = frequencies(texts)
    by = f.groupBy("text_id", "f").agg(F.count("*").alias("c"), F.sum(F.length("token")).alias("len"))
    up = Window.partitionBy("text_id").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # distinct frequencies: few
    by = by.withColumn("before", F.coalesce(F.sum("c").over(up), F.lit(0)))
    n, v = F.sum(F.col("f") * F.col("c")), F.sum("c")
    one = by.groupBy("text_id").agg(
        n.alias("n"), v.alias("v"), F.sum(F.col("f") * F.col("f") * F.col("c")).alias("s2"), F.sum(F.col("f") * F.col("len")).alias("chars"),
        F.sum(F.when(F.col("f") == 1, F.col("c"))).alias("once"), F.sum(F.when(F.col("f") == 2, F.col("c"))).alias("twice"),
        F.sum(F.col("f") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)).alias("ranked"),
    )
    n, v = F.col("n"), F.col("v")
    gini = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.col("ranked") / (v * n) - (v + 1) / v))
    zero = lambda ok, x: F.when(ok, x).otherwise(0.0)
    out = texts.select("text_id").distinct().join(one, "text_id", "left").fillna(0)
    return out.select(
        "text_id", n.alias("n_tokens"), v.alias("n_types"), zero(n > 0, v / n).alias("TTR"), zero(n >= 10, 1e4 * (F.col("s2") / (n * n) - 1 / n)).alias("yules_k"),
        zero(n > 0, F.col("chars") / n).alias("avg_word_length"), zero(n >= 10, F.col("once") / v).alias("hapax_ratio"),
        zero(n >= 10, F.col("twice") / v).alias("dis_ratio"), zero((n >= 10) & (v >= 2), gini).alias("word_burstiness"),
    )


def mattr(texts: DataFrame, width: int = 25) -> DataFrame:
    """Mean share of distinct tokens over all windows: a token is counted in the windows where it is the first of its type."""
    size = texts.select("text_id", F.size("tokens").alias("n"))
    before = Window.partitionBy("text_id", "token").orderBy("pos")
    w = T.long_form(texts).withColumn("prev", F.lag("pos", 1, -1).over(before)).join(size, "text_id")
    spans = F.least(F.col("pos"), F.col("n") - width) - F.greatest(F.col("prev") + 1, F.col("pos") - width + 1, F.lit(0)) + 1
    one = w.where(F.col("n") >= width).groupBy("text_id").agg((F.sum(F.greatest(spans, F.lit(0))) / (F.first("n") - width + 1) / width).alias("MATTR"))
    return texts.select("text_id").distinct().join(one, "text_id", "left").fillna(0.0, ["MATTR"])


def ngrams(toks: Column, n: int) -> Column:
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def unique_ngrams(texts: DataFrame) -> DataFrame:
    """Distinct adjacent pairs and triples."""
    return texts.select(
        "text_id", *(F.size(F.array_distinct(ngrams(F.col("tokens"), n))).cast("long").alias(name) for n, name in ((2, "unique_bigrams"), (3, "unique_trigrams")))
    )


def blocks(texts: DataFrame, size: int = BLOCK, least: int = LEAST_BLOCK) -> DataFrame:
    """Rows text_id, block, tokens: runs of ``size`` tokens; shorter than ``least`` are dropped."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1)), F.lit(size))
    cut = texts.select("text_id", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i, size))).alias("block", "tokens"))
    return cut.where(F.size("tokens") >= least)


def blocks_of_files(files: DataFrame, size: int = BLOCK, least: int = LEAST_BLOCK) -> DataFrame:
    """``blocks`` of texts given by files (text_id, file_id, ord, tokens; file ids are unique in a text): only runs of ``size`` tokens are gathered, never a text."""
    at = spans(files.select("text_id", "file_id", "ord", F.size("tokens").cast("long").alias("len"))).where("len > 0").select("text_id", "file_id", "start", "end")
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    cut = F.transform(F.sequence(first, last), lambda b: F.struct(
        b.alias("block"), F.greatest(b * size, F.col("start")).alias("at"),
        F.slice("tokens", (F.greatest(b * size, F.col("start")) - F.col("start") + 1).cast("int"), (F.least((b + 1) * size, F.col("end")) - F.greatest(b * size, F.col("start"))).cast("int")).alias("tokens"),
    ))
    pieces = files.select("text_id", "file_id", "tokens").join(at, ["text_id", "file_id"]).select("text_id", F.explode(cut).alias("p"))
    runs = pieces.groupBy("text_id", F.col("p.block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("p.at", "p.tokens"))).alias("runs"))  # ``size`` tokens each
    return runs.select("text_id", "block", F.flatten(F.transform("runs", lambda r: r["tokens"])).alias("tokens")).where(F.size("tokens") >= least)


def moving_unique_ngrams(texts: DataFrame, size: int = BLOCK, least: int = LEAST_BLOCK) -> DataFrame:
    """Means over blocks of distinct pairs and triples; ``texts`` may be files (``blocks_of_files``)."""
    b = blocks_of_files(texts, size, least) if "file_id" in texts.columns else blocks(texts, size, least)
    one = b.groupBy("text_id").agg(
        *(F.avg(F.size(F.array_distinct(ngrams(F.col("tokens"), n)))).alias(name) for n, name in ((2, "moving_unique_bigrams"), (3, "moving_unique_trigrams")))
    )
    return texts.select("text_id").distinct().join(one, "text_id", "left").fillna(0.0)


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the pairs (high, low): equal pairs, equal numbers."""
    return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]


def entropy_of(tokens: pa.ListArray, n: int) -> np.ndarray:
    """Cross entropy of each list of tokens under its own add-one model of order ``n``; 0 for fewer than n tokens. Counts are exact: tokens are numbered, not hashed."""
    size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(size))
    long = np.flatnonzero(size >= n)
    if not len(long):
        return out
    words = tokens.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2  # 0 and 1 are the marks
    doc = np.repeat(np.arange(len(size)), size)
    words, doc = words[size[doc] >= n], doc[size[doc] >= n]
    length = size[long] + n  # start marks and the end mark
    ends = np.cumsum(length)
    pad = np.zeros(int(ends[-1]), np.int64)
    inner = np.ones(len(pad), bool)
    inner[ends - 1] = False
    for i in range(n - 1):
        inner[ends - length + i] = False
    pad[inner], pad[ends - 1] = words, 1
    at = np.repeat(np.arange(len(long)), length)
    kinds = np.bincount(np.unique(at[inner] * (int(pad.max()) + 1) + pad[inner]) // (int(pad.max()) + 1), minlength=len(long))
    starts = np.ones(len(pad), bool)  # where a gram of n begins within its text
    for i in range(n - 1):
        starts[ends - 1 - i] = False
    p = np.flatnonzero(starts)
    context = at[p]
    for i in range(n - 1):
        context = _dense(context, pad[p + i])
    gram = _dense(context, pad[p + n - 1])
    count, total = np.bincount(gram)[gram], np.bincount(context)[context]
    bits = np.log2((count + 1) / (total + kinds[at[p]] + 2.0))
    out[long] = -np.bincount(at[p], bits, len(long)) / (size[long] + 1)
    return out


def ngram_entropy(texts: DataFrame, n: int) -> DataFrame:
    """Cross entropy in bits of the add-one conditional model of each text (a row each), with start and end marks. Counted within the text's row: nothing is shuffled."""
    kind = dict(texts.dtypes)["text_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, lo = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while lo < b.num_rows:  # about TOKENS at once, or one longer text
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(entropy_of(part.column(1), n))], ["text_id", f"ngram_entropy_{n}"])
                lo = hi

    return texts.select("text_id", "tokens").mapInArrow(run, f"text_id {kind}, ngram_entropy_{n} double")


def readability(df: DataFrame, text: str = "text") -> DataFrame:
    """readability (Flesch) and average_sentence_length of source texts."""
    s = df.select("text_id", T.sentences(F.col(text)).alias("s")).select("text_id", "s", F.flatten("s").alias("w"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    s = s.select(
        "text_id", F.size("s").alias("n_s"), F.size("w").alias("n_w"), F.size(F.filter("s", lambda x: F.size(x) > 0)).alias("n_full"), total(F.transform("w", T.syllables)).alias("syl")
    )
    ok = (F.col("n_s") > 0) & (F.col("n_w") > 0)
    flesch = 206.835 - 1.015 * (F.col("n_w") / F.col("n_s")) - 84.6 * (F.col("syl") / F.col("n_w"))
    return s.select("text_id", F.when(ok, flesch).otherwise(0.0).alias("readability"), F.when(F.col("n_full") > 0, F.col("n_w") / F.col("n_full")).otherwise(0.0).alias("average_sentence_length"))


def pronoun_switching(texts: DataFrame) -> DataFrame:
    """Changes between I, you and we words in succession, per 100 tokens."""
    groups = {w: g for g in ("i", "you", "we") for w in PRONOUNS[g].split()}
    code = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    seq = F.filter(F.transform("tokens", lambda t: F.element_at(code, t)), lambda g: g.isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))
    n = F.aggregate(seq, start, lambda a, g: F.struct(g.alias("last"), (a["n"] + F.when(a["last"] != g, 1).otherwise(0)).alias("n")))["n"]
    return texts.select("text_id", F.when(F.size("tokens") > 0, n / F.size("tokens") * 100).otherwise(0.0).alias("pronoun_switching"))


def latinate(toks: Column) -> Column:
    return F.size(F.filter(toks, lambda t: (F.length(t) >= 5) & t.rlike(f"({'|'.join(LATINATE)})$"))).cast("long")


def possessives(toks: Column) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(POSSESSIVES) | t.endswith("'s"))).cast("long")


def gerunds(toks: Column) -> Column:
    """Words in -ing of five letters or more, without the listed ones: the rule where no tagger is at hand."""
    return F.size(F.filter(toks, lambda t: t.rlike(r"^\p{L}{2,}ing$") & ~t.isin(NOT_GERUNDS))).cast("long")


def unique_words(toks: Column) -> Column:
    return F.size(F.array_distinct(F.filter(toks, lambda t: t.rlike("^[a-z]+('[a-z]+)?$") & (F.length(t) >= 2)))).cast("long")


def vocabulary_split(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """unique and total counts of words in and out of ``dictionary`` (column word); non-ASCII, long or non-letter tokens are out."""
    f = frequencies(texts).join(dictionary.select(F.lower("word").alias("token"), F.lit(True).alias("known")).distinct(), "token", "left")
    known = F.coalesce("known", F.lit(False)) & F.col("token").rlike("^[a-z']{1,30}$")
    one = f.groupBy("text_id").agg(
        F.count_if(known).alias("unique_non_oov_count"), F.count_if(~known).alias("unique_oov_count"),
        F.coalesce(F.sum(F.when(known, F.col("f"))), F.lit(0)).alias("total_non_oov_count"), F.coalesce(F.sum(F.when(~known, F.col("f"))), F.lit(0)).alias("total_oov_count"),
    )
    return texts.select("text_id").distinct().join(one, "text_id", "left").fillna(0)


def semantic_disparity(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 less the mean cosine of the distinct words' vectors (columns word, vector), by sums per dimension."""
    enough = texts.where(F.size("tokens") >= 20).select("text_id", F.explode(F.array_distinct("tokens")).alias("word"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.select("word", F.transform("vector", lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm)).alias("u"))
    e = enough.join(unit, "word").select("text_id", "word", F.posexplode("u").alias("d", "x"))
    d = e.groupBy("text_id", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    one = d.groupBy("text_id").agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n >= 10")
    one = one.select("text_id", (1 - (F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("semantic_disparity"))
    return texts.select("text_id").distinct().join(one, "text_id", "left").fillna(0.0)


def mtld_factors(toks: list[str], threshold: float = 0.72) -> float:
    """Factors of one direction, with the part of the last one."""
    seen: set[str] = set()
    n, factors, ratio = 0, 0.0, 1.0
    for t in toks:
        seen.add(t)
        n += 1
        ratio = len(seen) / n
        if ratio <= threshold:
            factors, n, ratio = factors + 1, 0, 1.0
            seen.clear()
    return factors + (1 - ratio) / (1 - threshold) if n else factors


def mtld(toks: str | Column) -> Column:
    """Mean of both directions of tokens by factors; a text without a factor counts as one."""

    def one(t) -> float:
        t = list(t)
        return sum(len(t) / (mtld_factors(x) or 1.0) for x in (t, t[::-1])) / 2 if t else 0.0

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "double")(toks)


def _crc32_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


#: Bits of the match finder's hash at LZMA's default of an 8 MB dictionary, and fewer that may do; strings that it follows in one search.
HASH_BITS, FEWER_BITS, DEPTH = 22, (16, 18, 20), 48
_CRC = _crc32_table()


def _hash_bits(data: bytes) -> int:
    """Bits of hash with which LZMA finds the same matches in ``data`` as with ``HASH_BITS``.

    A search walks a tree of the earlier places with the hash of the next four bytes. Places of other hashes in the same
    tree are never matches; they only count against ``DEPTH``. So the matches are the same if each tree has no more
    than ``DEPTH`` places or those of one full hash alone.
    """
    x = np.frombuffer(data, np.uint8)
    if len(x) <= DEPTH + 3:
        return FEWER_BITS[0]
    full = (_CRC[x[:-3]] ^ x[1:-2] ^ x[2:-1].astype(np.uint32) << 8 ^ _CRC[x[3:]] << 5) & np.uint32((1 << HASH_BITS) - 1)
    for bits in FEWER_BITS:
        if len(data) > 2 << bits:  # the dictionary holds the whole text
            continue
        rest = HASH_BITS - bits
        key = np.sort((full & np.uint32((1 << bits) - 1)) << rest | full >> bits)
        tree = key >> rest
        crowded = np.flatnonzero(tree[DEPTH:] == tree[:-DEPTH])
        ends = tree[crowded]
        if (key[np.searchsorted(tree, ends)] == key[np.searchsorted(tree, ends, "right") - 1]).all():
            return bits
    return HASH_BITS


def _lzma_size(text: str) -> int:
    """Bytes of a text compressed by LZMA's defaults. Their hash table alone takes longer to set up than a short text to compress, so a smaller one is used where it gives the same."""
    data = text.encode()
    bits = _hash_bits(data)
    return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": 2 << bits}]) if bits < HASH_BITS else lzma.compress(data))


def _compressed(tokens: Column, size: int, least: int) -> Column:
    """Struct all, blocks: n (tokens), raw (bytes) and c (bytes compressed) of a text and of each of its ``blocks``; a text is joined and cut in one pass."""

    def measured(toks: list[str]) -> tuple[int, int, int]:
        j = " ".join(t for t in toks if t is not None)
        return len(toks), len(j.encode()), _lzma_size(j) if j else 0

    def run(s: pd.Series) -> pd.DataFrame:
        every, parts = [], []
        for t in s:
            t = [] if t is None else list(t)
            cut = [t[i : i + size] for i in range(0, len(t), size)]
            every.append(measured(t))
            parts.append([every[-1] if len(p) == len(t) else measured(p) for p in cut if len(p) >= least])
        names = ("n", "raw", "c")
        return pd.DataFrame({"all": [dict(zip(names, x)) for x in every], "blocks": [[dict(zip(names, x)) for x in p] for p in parts]})

    one = "struct<n:long,raw:long,c:long>"
    return F.pandas_udf(run, f"struct<all:{one},blocks:array<{one}>>")(tokens)


def compression(texts: DataFrame) -> DataFrame:
    """compression, normalized_compression_ratio and their means over blocks. Each text is read and compressed once; what is joined is a kept table of sizes."""
    t = kept(texts.select("text_id", _compressed(F.col("tokens"), BLOCK, LEAST_BLOCK).alias("m")).select("text_id", "m.all.*", "m.blocks"), "compressed")
    full = t.select("text_id", F.when(F.col("n") > 0, F.col("c") / F.col("raw")).otherwise(0.0).alias("compression"), F.when(F.col("n") > 0, F.col("c") / (F.col("n") * 4.5)).otherwise(0.0).alias("normalized_compression_ratio"))
    b = t.select("text_id", F.inline("blocks"))
    b = b.groupBy("text_id").agg(F.avg(F.col("c") / F.col("raw")).alias("moving_lzma_cr"), F.avg(F.col("c") / (F.col("n") * 4.5)).alias("window_normalized_lzma_cr"))
    return full.join(b, "text_id", "left").fillna(0.0)


def greedy_chunks(toks: str | Column, size: int, pieces=None) -> Column:
    """Tokens packed in order while their pieces stay within ``size``; a token beyond it is a chunk of its own.

    ``pieces`` counts a token's model pieces (one each by default); it travels to the workers.
    """
    count = pieces or (lambda t: 1)

    def one(t) -> list[str]:
        out, held, n = [], [], 0
        for x in t:
            k = count(x)
            if held and n + k > size:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(x)
            n += k
        return [*out, " ".join(held)] if held else out

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "array<string>")(toks)


def sentiment(scores: DataFrame, edge: float = 0.05) -> DataFrame:
    """positivity and volatility of chunk scores (text_id, score): positive over positive and negative, 0.5 without either; population deviation."""
    pos, neg = F.count_if(F.col("score") >= edge), F.count_if(F.col("score") <= -edge)
    return scores.groupBy("text_id").agg(
        F.when(pos + neg > 0, pos / F.nullif(pos + neg, F.lit(0))).otherwise(0.5).alias("positivity"), F.stddev_pop("score").alias("volatility")
    )


def words_per_file(files: DataFrame) -> DataFrame:
    """Mean tokens of a text's files that have any."""
    return files.where(F.size("tokens") > 0).groupBy("text_id").agg(F.avg(F.size("tokens")).alias("avg_words_per_video"))


def model_score(texts: DataFrame, scorer, name: str, chunk: int = 1024, most: int = 6, chars: int = 24_000) -> DataFrame:
    """text_id, ``name``: mean of a model's score over at most ``most`` evenly spaced chunks of a text, ``chars`` characters each.

    ``scorer`` takes a list of texts and gives a number for each, or None; it travels to the workers. Null where a text has no chunk.
    """
    n = F.size("parts")
    at = F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(i * (n - 1) / max(1, most - 1)).cast("int")))
    some = texts.select("text_id", T.chunks(F.col("tokens"), chunk).alias("parts"))
    some = some.select("text_id", F.explode_outer(F.when(n > 0, F.transform(at, lambda i: F.substring(F.get("parts", i), 1, chars)))).alias("part"))

    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype="float64")
        if known.any():
            out[known] = [float("nan") if x is None else float(x) for x in scorer(s[known].tolist())]
        return out

    scored = some.withColumn("x", F.pandas_udf(run, "double")("part"))
    return scored.groupBy("text_id").agg(F.avg(F.when(~F.isnan("x"), F.col("x"))).alias(name))

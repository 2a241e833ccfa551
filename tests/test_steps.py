"""Steps that read all texts: each text is cut into tokens once, and what is made of it is as before."""

import lzma
import random

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical, style


def test_profiles_cut_a_text_once(spark, monkeypatch):
    planned, kept = [], style.kept
    monkeypatch.setattr(style, "kept", lambda df, name: planned.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    rows = [("a", "I'm here, the THE"), ("a", "zebra DON'T y'all"), ("b", "The"), ("c", "?"), ("d", None), (None, "the she")]
    p = style.profiles(spark.createDataFrame(rows, "text_id string, text string").select("text_id", T.tokens(F.col("text")).alias("tokens")))
    rate = {(r.text_id, r.word): r.rate for r in p.collect()}
    assert rate["a", "the"] == 2 / 10 and rate["a", "do"] == rate["a", "not"] == rate["a", "you"] == rate["a", "am"] == 1 / 10 and rate["b", "the"] == 1.0
    assert {t for t, _ in rate} == {"a", "b", None} and len(rate) == 3 * 130
    assert [s.count("regexp_extract_all") for s in planned] == [1]


def test_fewer_bits_give_the_sizes_of_the_defaults():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 7))) for _ in range(2000)]
    texts = ["".join(r.choices(letters, k=n)) for letters in ("ab", "abcdefgh ", "aé²") for n in (1, 50, 51, 52, 600, 9000, 70000)]
    texts += ["a" * n for n in (3, 4, 51, 52, 53, 131072, 131073)] + [" ".join(r.choices(words, k=n)) for n in (10, 200, 1500, 6000, 25000)]
    assert [lexical._lzma_size(t) for t in texts] == [len(lzma.compress(t.encode())) for t in texts]
    bits = [lexical._hash_bits(" ".join(r.choices(words, k=n)).encode()) for n in (10, 200, 25000)]
    assert bits[:2] == [16, 16] and bits[2] > 16  # most texts are short; a long one keeps a hash that tells its words apart


def test_a_crowded_tree_of_several_hashes_needs_more_bits():
    """Four letters whose hashes agree in 16 bits and not in 22."""
    crc = lambda c: int(lexical._CRC[c])
    full = lambda a, b, c, d: (crc(a) ^ b ^ c << 8 ^ crc(d) << 5) & 0x3FFFFF
    letters, seen = range(97, 123), {}
    for four in ((a, b, c, d) for a in letters for b in letters for c in letters for d in letters):
        other = seen.setdefault(full(*four) & 0xFFFF, four)
        if full(*other) != full(*four):
            break
    data = b"  ".join(bytes(x) for x in (other, four) for _ in range(40))
    assert lexical._hash_bits(data) > 16 and lexical._hash_bits(b"  ".join([bytes(four)] * 80)) == 16


def test_compression_reads_and_compresses_once(spark):
    rows = [(1, "to be or not to be " * 2), (2, ""), (3, "a b c d e f g " * 900), (4, "x" * 9), (5, "q w e r t y " * 700), (5, "zz"), (6, "u v " * 4600)]
    df = spark.createDataFrame(rows, "text_id int, text string").select("text_id", T.tokens(F.col("text")).alias("tokens"))
    got = lexical.compression(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Python" not in plan  # both sides read the kept sizes

    def size(toks):
        return len(lzma.compress(" ".join(toks).encode()))

    want = []
    for i, text in rows:
        t = text.split()
        parts = [p for k, s in rows if k == i for u in [s.split()] for p in [u[x : x + 5000] for x in range(0, len(u), 5000)] if len(p) >= 4000]
        raw = len(" ".join(t).encode())
        mean = lambda f: sum(map(f, parts)) / len(parts) if parts else 0.0  # noqa: B023, E731
        want.append((i, size(t) / raw if t else 0.0, size(t) / (len(t) * 4.5) if t else 0.0, mean(lambda p: size(p) / len(" ".join(p).encode())), mean(lambda p: size(p) / (len(p) * 4.5))))
    key = lambda rs: sorted((str(r[0]), *(round(x, 9) for x in r[1:])) for r in rs)
    assert key(map(tuple, got.collect())) == key(want)

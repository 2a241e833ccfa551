"""Hand-made cases that the test tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clusters, explore, export, filters, lexical, records, style, vectors
from corpusloom.plans import registry
from corpusloom.sources import files
from corpusloom.streaming import subtitles


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "text_id int, text string").withColumn("tokens", T.tokens(F.col("text")))


def one(df, column):
    return [r[column] for r in df.orderBy(df.columns[0]).collect()]


def test_tokens(spark):
    got = one(texts(spark, "Don't 'quote' it''s", None, "½ x² A_b", "café"), "tokens")
    assert got == [["don't", "quote", "it", "s"], [], ["½", "x²", "a_b"], ["cafe"]]


def test_pieces_and_phrases(spark):
    t = texts(spark, "that's that", "of the of the", "what the the a cat")
    assert one(t.select("text_id", T.pattern_count(T.joined(F.col("tokens")), [r"\bthat\b"]).alias("n")), "n")[0] == 2
    assert one(t.select("text_id", T.pattern_count(T.joined(F.col("tokens")), [r"\bof the\b"]).alias("n")), "n")[1] == 2
    got = registry.measure(t, ["article_count", "article_count_raw"]).orderBy("text_id").collect()[2]
    assert (got.article_count, got.article_count_raw) == (1, 1)
    assert one(t.select("text_id", T.pieces(F.col("tokens")).alias("p")), "p")[0] == ["that", "s", "that"]


def test_profile_contractions(spark):
    p = {(r.text_id, r.word): r.rate for r in style.profiles(texts(spark, "i'm, she", "okay, the")).collect()}
    assert (p[0, "i"], p[0, "am"], p[0, "he"]) == pytest.approx((1 / 3,) * 3)
    assert (p[1, "okay"], p[1, "the"]) == (0, 0.5)
    assert len({w for _, w in p}) == 130


def test_blocks(spark):
    t = spark.createDataFrame([(0, ["a"] * 8999), (1, ["a"] * 9000)], "text_id int, tokens array<string>")
    got = {(r.text_id, r.block): len(r.tokens) for r in lexical.blocks(t).collect()}
    assert got == {(0, 0): 5000, (1, 0): 5000, (1, 1): 4000}


def test_mtld(spark):
    t = spark.createDataFrame([(0, [f"w{i}" for i in range(40)]), (1, []), (2, ["a", "a"] * 10)], "text_id int, tokens array<string>")
    got = one(t.select("text_id", lexical.mtld("tokens").alias("m")), "m")
    assert got[0] == 40 and got[1] == 0 and 1 <= got[2] <= 20


def test_mattr_by_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 30, 120)]
    t = spark.createDataFrame([(0, words), (1, words[:20])], "text_id int, tokens array<string>")
    want = np.mean([len(set(words[i : i + 25])) / 25 for i in range(96)])
    assert one(lexical.mattr(t), "MATTR") == pytest.approx([want, 0.0])


def test_fighting_words_rank_and_ties(spark):
    f = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("a", "z", 5), ("b", "x", 5), ("b", "y", 5), ("b", "q", 50)], "text_id string, token string, f long")
    for rank, word in ((1, "x"), (2, "y"), (1000, "z")):  # x and y tie: by the word; the last where there are fewer
        assert {r.text_id: r.word for r in style.fighting_words(f, rank).collect()}["a"] == word
    alone = style.fighting_words(f.where("text_id = 'a'"), 1).first()
    assert alone.z is None and alone.word is None


def test_limits(spark):
    df = spark.createDataFrame([("t", f, f"{f}", [str(i) for i in range(a, b)]) for f, a, b in (("f1", 1, 4), ("f2", 4, 7), ("f3", 7, 11))], "text_id string, file_id string, ord string, tokens array<string>")
    first = filters.first_tokens(df, 6)
    assert filters.texts_of(filters.newest_tokens(first, 2)).first().tokens == ["5", "6"]
    assert filters.texts_of(filters.newest_whole_files(df, 5)).first().tokens == ["6", "7", "8", "9", "10"]
    assert [r.file_id for r in filters.recent_files(df, 1).collect()] == ["f3"]


def test_missing_dates_and_durations(spark):
    df = spark.createDataFrame([(1, "20200101", 10), (2, None, None), (3, "20210101", 99)], "id int, day string, duration int")
    assert filters.date_range(df, "day").count() == 3
    assert one(filters.date_range(df, "day", "20200101", "20201231"), "id") == [1]
    assert one(filters.duration_range(df, "duration", 5), "id") == [1, 3]
    assert one(filters.duration_range(df, "duration", 0, 50), "id") == [1]


def test_regressions(spark):
    df = spark.createDataFrame([(float(x), 3 + 2 * x + 0.5 * x * x, 4.0) for x in range(10)], "x double, y double, c double")
    q = explore.quadratic_fit(df, "x", "y").first()
    assert (q.a, q.b, q.c) == pytest.approx((3, 2, 0.5))
    flat = explore.linear_fit(df.withColumn("k", F.lit(1.0)), "k", "y").first()
    assert flat.slope == 0
    assert explore.pearson(df, "x", "c").first().r is None
    s = spark.createDataFrame([(float(x), 1 / (1 + math.exp(-(x - 5)))) for x in range(11)], "x double, y double")
    fit = explore.logistic_fit(s, "x", "y")
    assert fit["b1"] > 0 and -fit["b0"] / fit["b1"] == pytest.approx(5, abs=0.2)
    z = spark.createDataFrame([(0.0,), (1.96,)], "z double").select(explore.normal_cdf(F.col("z")).alias("p"))
    assert [r.p for r in z.collect()] == pytest.approx([0.5, 0.975], abs=1e-4)
    curve = explore.curve(F.col("x") * 2, 0, 10, spark)
    assert curve.count() == 101 and curve.agg(F.max("y")).first()[0] == 20


def test_numbers_and_durations(spark):
    df = spark.createDataFrame([(0.5,), (-0.00001,), (12.0,), (1.23456,)], "v double").select(T.trimmed(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["0.5", "0", "12", "1.2346"]
    df = spark.createDataFrame([("01:02:03",), ("2:30",), ("",), (None,)], "d string").select(T.seconds(F.col("d")).alias("s"))
    assert [r.s for r in df.collect()] == [3723, 150, 0, 0]
    assert spark.range(1).select(export.xor_hex(F.lit("Hé"), "key").alias("x")).first().x == bytes(a ^ b for a, b in zip("Hé".encode(), b"key")).hex()


def test_sources(spark, tmp_path):
    d = tmp_path / "in" / "Chan" / "txt_files"
    d.mkdir(parents=True)
    (d / "Title [abcdefghijk].txt").write_text("Hello world")
    (d / "plain.name.txt").write_text("x")
    got = {r.file_id: (r.text_id, r.content) for r in files.text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"abcdefghijk": ("Chan", "Hello world"), "name": ("Chan", "x")}
    (tmp_path / "m.json").write_text('[{"id": "a", "title": "old"}, {"id": "a", "title": "new", "duration": 5}, {"title": "no id"}]')
    rows = files.metadata(spark, str(tmp_path / "m.json")).collect()
    assert [(r.id, r.title, r.duration, r.view_count) for r in rows] == [("a", "new", 5, 0)]
    lines = spark.createDataFrame([("# note",), ("https://x/watch?v=abcdefghijk",), ("ABCDEFGHIJK.txt",), ("short",)], "line string")
    assert {r.id for r in files.ignore_list(lines).collect()} == {"abcdefghijk", "ABCDEFGHIJK"}
    assert files.directory_documents(spark, str(tmp_path / "in")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.vtt").write_text("WEBVTT\n\n00:00.000 --> 00:01.000\nhi there\nhi there\nyou\n")
    for _ in range(2):
        subtitles.convert(spark, str(tmp_path / "v"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(60)
    assert [(r.file_id, r.content) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", "hi there you")]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(3, 8)
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.02, 8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id int, vector array<double>")
    for made in (clusters.hdbscan(v, 5), clusters.leiden(v, 8), clusters.kmeans(v, 3)):
        label = {r.id: r.label for r in made.collect()}
        assert len({label[i] for i in range(3)}) == 3 and all(label[i] == label[i % 3] for i in range(60))
    assert clusters.layout(v).count() == 60
    assert vectors.knn_edges(vectors.cosine_pairs(v, 2), 3).where("src >= dst").count() == 0


def test_topics(spark):
    mix, words = clusters.topics(texts(spark, "cat dog cat dog", "sun moon sun moon", "cat dog cat"), 2)
    assert [r.s for r in mix.groupBy("text_id").agg(F.sum("prob").alias("s")).collect()] == pytest.approx([1, 1, 1])
    assert words.count() == 2


def test_records(spark):
    lines = spark.createDataFrame([("processing: Foo,",), ("foo",), ("Bar;",), ("",)], "line string")
    assert {r.key for r in records.handles(lines).collect()} == {"foo", "bar"}
    assert registry.measure(texts(spark, "a b"), ["how_count"]).columns == ["text_id", "how_count"]
    with pytest.raises(KeyError):
        registry.measure(texts(spark, "a b"), ["nothing_of_the_kind"])


def test_chunks_and_sentiment(spark):
    t = spark.createDataFrame([(0, ["aa", "b", "ccc", "d"]), (1, [])], "text_id int, tokens array<string>")
    assert one(t.select("text_id", lexical.greedy_chunks("tokens", 3, len).alias("c")), "c") == [["aa b", "ccc", "d"], []]
    assert one(t.select("text_id", T.chunks(F.col("tokens"), 3).alias("c")), "c") == [["aa b ccc", "d"], []]
    s = lexical.sentiment(spark.createDataFrame([(0, 0.5), (0, -0.5), (0, 0.3), (1, 0.0)], "text_id int, score double")).orderBy("text_id").collect()
    assert s[0].positivity == pytest.approx(2 / 3) and s[1].positivity == 0.5 and s[1].volatility == 0

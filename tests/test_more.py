"""Operators that the test tables do not reach, and results against values worked out by hand."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ranges
from corpusloom.functions import text as T
from corpusloom.operators import clusters, explore, export, filters, lexical
from corpusloom.plans import cache, registry
from corpusloom.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_numbering_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 17 == 0 else int(x)) for i, x in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "id long, x long").repartition(7)
    for down in (False, True):
        got = [r.id for r in ranges.numbered(df, "n", "x", F.asc("id"), descending=down).orderBy("n").collect()]
        last = down  # nulls first going up, last going down
        assert got == [i for i, _ in sorted(rows, key=lambda r: ((r[1] is None) == last, -(r[1] or 0) if down else r[1] or 0, r[0]))]
    distinct = df.groupBy("x").count().where("x is not null")
    total = 0
    for r in sorted(ranges.running_sum(distinct, "s", "x", "count").collect()):
        total += r["count"]
        assert r.s == total
    assert ranges.numbered(df.limit(0), "n", "x").collect() == []


def test_percentiles_of_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0), (4, None)], "id int, x double")
    assert {r.id: r.percentile for r in explore.percentiles(df, "x").collect()} == {1: pytest.approx(200 / 3), 2: pytest.approx(200 / 3), 3: 100.0}
    assert [(r.x, round(r.share, 4)) for r in explore.ecdf(df, "x").orderBy("x").collect()] == [(2.0, 0.6667), (5.0, 1.0)]


def test_word_z_scores_need_three_values_and_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", 4.0), ("c", 4.0), ("c", 4.0)], "word string, v double")
    got = sorted((r.word, round(r.z, 4)) for r in explore.word_z_scores(df, "v").collect())
    assert got == [("a", -1.2247), ("a", 0.0), ("a", 1.2247)]


def test_plain_words_of_a_pattern_list_count_as_before(spark):
    patterns = [r"\bred\b", r"\bblue\b", r"\bsky blue\b", r"\bgreen\b", r"\bgo\w*\b"]
    df = spark.createDataFrame([("red it's blue sky blue green's goes Red reddish éred",), ("",)], "j string")
    one = df.select(T.pattern_count(F.lower("j"), patterns).alias("n"), sum((T.pattern_count(F.lower("j"), [p]) for p in patterns), F.lit(0)).alias("m")).collect()
    assert [r.n for r in one] == [r.m for r in one] == [7, 0]


def test_niche_metrics(spark):
    text = "Thank you, please! My dog and a cat can't be seen. I don't know, isn't it um uh 6 7 either"
    names = ["thank_you_count", "please_count", "dog_count", "cat_count", "animal_count", "i_dont_know_count", "modal_negation_count", "tag_question_count", "disfluency_cluster_count", "67_count", "peak_comedy_count"]
    df = spark.createDataFrame([("a", text)], "text_id string, text string")
    got = registry.measure(df, names, registry.gaming_registry()).first()
    assert [got[n] for n in names] == [1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 0]
    assert registry.measure(df, ["narration_continuation_ratio"]).first()[1] == pytest.approx(1 / len(T_tokens(spark, text)) * 1000)  # "and" alone: "either" asks for a line end
    assert {"minecraft_lexicon_density", "vehicle_lexicon_density"} <= registry.gaming_registry().keys()
    assert registry.measure(df, ["minecraft_lexicon_density"], registry.gaming_registry(terms={"minecraft_lexicon_density": ["dog", "cat"]})).first()[1] == 2.0


def T_tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0]


def test_metric_cache(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    rows = [("a", ["1", "2"], "you know the cat"), ("b", ["3"], "the the"), ("c", [], "")]

    def texts(rows):
        df = spark.createDataFrame(rows, "text_id string, ids array<string>, text string")
        return df.select("text_id", cache.fingerprint(F.col("ids")).alias("fingerprint"), T.tokens(F.col("text")).alias("tokens"))

    def parts():
        return sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path / "metrics") for f in fs)

    got = {r.text_id: r.article_count for r in cache.measure_cached(texts(rows), path, ["article_count"]).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 0.0}
    n = parts()
    assert {r.text_id: r.article_count for r in cache.measure_cached(texts(rows), path, ["article_count"]).collect()} == got and parts() == n  # nothing new
    changed = [("a", ["1", "2"], "not read"), ("b", ["3", "4"], "the cat the dog a")]
    both = {r.text_id: (r.article_count, r.pronoun_you_count) for r in cache.measure_cached(texts(changed), path, ["article_count", "pronoun_you_count"]).collect()}
    assert both == {"a": (1.0, 0.0), "b": (3.0, 0.0)} and parts() > n  # a keeps its count, lacks only the new metric


def test_labels_that_clash(spark, tmp_path):
    for p in ("a/b.txt", "a__b.txt", "c.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    got = {r.content: r.text_id for r in files.directory_documents(spark, str(tmp_path)).collect()}
    assert got == {"a/b.txt": "txt_a__b", "a__b.txt": "txt_a__b_1", "c.txt": "txt_c"}


def test_least_total(spark):
    df = spark.createDataFrame([("x", 1, ["a"] * 3), ("x", 2, ["a"] * 2), ("y", 3, ["a"])], "text_id string, file_id int, tokens array<string>")
    assert sorted(r.file_id for r in filters.least_total(df, 5).collect()) == [1, 2]
    assert {r.file_id: r.low_token_text for r in filters.least_total(df, 5, embedding_only=True).collect()} == {1: False, 2: False, 3: True}


def test_handles_and_channels(spark):
    cols = "channel_url string, url string, channel_id string, channel_name string"
    rows = [("https://v/@Ann", None, None, "x"), (None, "https://v/@bob?x", None, "x"), ("https://v/c/cat", None, None, "x"), (None, None, "@dan", "x"), (None, None, "UC" + "a" * 22, "Eve & Co.")]
    assert [r.handle for r in export.handle(spark.createDataFrame(rows, cols)).collect()] == ["Ann", "bob", "cat", "dan", "eveco."]
    v = spark.createDataFrame([("t", "2", "20200102", 5, "new"), ("t", "1", "20200101", 7, "old")], "text_id string, id string, upload_date string, duration int, channel_name string")
    one = export.channel_records(v).first()
    assert one.name == "old" and [tuple(x) for x in one.videos] == [("20200101", "1", 7), ("20200102", "2", 5)]


def test_semantic_disparity(spark):
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))
    v = spark.createDataFrame([(w, [float(a) for a in r]) for w, r in zip(words, x, strict=True)], "word string, vector array<double>")
    t = spark.createDataFrame([("a", words * 2), ("b", words[:3])], "text_id string, tokens array<string>")
    u = x / np.sqrt((x**2).sum(1))[:, None]
    want = 1 - ((u @ u.T).sum() - 12) / (12 * 11)
    got = {r.text_id: r.semantic_disparity for r in lexical.semantic_disparity(t, v).collect()}
    assert got["a"] == pytest.approx(want)


def test_whitening_and_sweeps(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(20, 3)) + [8, 0, 0], rng.normal(size=(20, 3)) - [8, 0, 0]])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    w = np.array([r.vector for r in clusters.whiten(v).orderBy("id").collect()])
    assert np.cov(w.T).round(6).tolist() == np.eye(w.shape[1]).tolist() or np.allclose(np.cov(w.T), np.eye(w.shape[1]), atol=1e-6)
    got = clusters.sweep(v, 0.5, 1.5, 3, k=6).collect()
    assert sorted({r.variant for r in got}) == [0.5, 1.0, 1.5] and len(got) == 120
    low = {r.id: r.label for r in got if r.variant == 0.5}
    assert len({low[i] for i in range(20)} & {low[i] for i in range(20, 40)}) == 0
    assert {r.variant for r in clusters.density_sweep(v, (3, 5)).collect()} == {3, 5}


def test_entry_without_the_optional_package(tmp_path):
    """The driver deletes the folder and the pipeline; other import errors must show."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'token_counts' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env).returncode == 0


def test_model_scores_of_evenly_spaced_chunks(spark):
    df = spark.createDataFrame([("a", [f"t{i}" for i in range(100)]), ("b", []), ("c", ["x"])], "text_id string, tokens array<string>")
    got = {r.text_id: r.first_token for r in lexical.model_score(df, lambda texts: [float(t.split()[0][1:] or 7) for t in texts], "first_token", chunk=10, most=3).collect()}
    assert got == {"a": pytest.approx((0 + 40 + 90) / 3, abs=4), "b": None, "c": 7.0}


def test_selected_names():
    names = registry.base_registry()
    assert registry.selected(names, metrics=False) == []
    assert all(n.endswith("_count") for n in registry.selected(names, counts_only=True))
    assert "discussion_commentary_count" not in registry.selected(names, fast=True) and "hedge_count" in registry.selected(names, fast=True)


def test_blocks_of_files_are_those_of_the_text(spark):
    from corpusloom.operators import filters

    rows = [("t", i, f"{i:02}", [f"w{(i * 7 + j) % 11}" for j in range(n)]) for i, n in enumerate([3, 0, 12, 1, 5, 9])] + [("u", 9, "09", ["a"]), ("v", 10, "10", [])]
    files = spark.createDataFrame(rows, "text_id string, file_id int, ord string, tokens array<string>")
    key = lambda df: sorted((r.text_id, r.block, tuple(r.tokens)) for r in df.collect())
    assert key(lexical.blocks_of_files(files, 5, 4)) == key(lexical.blocks(filters.texts_of(files), 5, 4))
    assert sorted(map(tuple, lexical.moving_unique_ngrams(files, 5, 4).collect())) == sorted(map(tuple, lexical.moving_unique_ngrams(filters.texts_of(files), 5, 4).collect()))
    plan = lexical.moving_unique_ngrams(files, 5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(ord" not in plan  # no text is gathered


def test_topics_of_texts_in_rows(spark):
    from corpusloom.operators import clusters

    rows = [("a", ["cat", "dog"]), ("a", ["cat", "dog", "cat"]), ("b", ["sun", "moon"]), ("b", []), ("none", [])]
    mix, words = clusters.topics(spark.createDataFrame(rows, "text_id string, tokens array<string>"), 2, rounds=5)
    total = {}
    for r in mix.collect():
        total[r.text_id] = total.get(r.text_id, 0) + r.prob
    assert set(total) == {"a", "b", "none"} and abs(total["a"] - 1) < 1e-6 and abs(total["b"] - 1) < 1e-6
    assert all(set(r["words"]) <= {"cat", "dog", "sun", "moon"} and len(r["words"]) == 4 for r in words.collect())


def test_entropy_by_hand(spark):
    from collections import Counter
    from math import log2

    rows = [(i, [f"w{(i * j * j) % 5}" for j in range(n)]) for i, n in enumerate([0, 1, 2, 3, 9, 40])] + [(9, None)]
    df = spark.createDataFrame(rows, "text_id int, tokens array<string>")
    for n in (2, 3):
        got = lexical.ngram_entropy(df, n)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        for r in got.collect():
            t = dict(rows)[r.text_id] or []
            pad = ["<s>"] * (n - 1) + t + ["</s>"]
            grams = Counter(tuple(pad[i : i + n]) for i in range(len(pad) - n + 1))
            total = Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
            want = -sum(c * log2((c + 1) / (total[g[:-1]] + len(set(t)) + 2)) for g, c in grams.items()) / (len(t) + 1) if len(t) >= n else 0.0
            assert abs(r[1] - want) < 1e-9


def test_median_without_one_task_of_all_values(spark):
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None, 9.0], [2.0, 2.0, 7.0, 8.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = explore.summary(df, "x")
        assert got.first().median == df.agg(F.percentile("x", 0.5)).first()[0]
        assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_read_the_texts_once(spark):
    from corpusloom.operators import style

    df = spark.createDataFrame([("a", ["i'm", "here", "the", "the"]), ("a", ["zebra", "don't"]), ("b", ["the"]), ("c", [])], "text_id string, tokens array<string>")
    p = style.profiles(df)
    rate = {(r.text_id, r.word): r.rate for r in p.collect()}
    assert rate["a", "the"] == 2 / 8 and rate["a", "i"] == 1 / 8 and rate["b", "the"] == 1.0 and not any(t == "c" for t, _ in rate)
    assert "tokens" not in style.z_scores(p)._jdf.queryExecution().optimizedPlan().toString()


ODD = [
    "i think i think the man's going to go ahead and going to going to", "you guys're don't you guys", "go over to to be fair oh no i can i", "ſorry ıı i'ı kıd kids kid's manſ mates mate²s", "²the the² 6 7 wee wee wee no nooo nuh uh",
    "dogs dog doggy cats' ducks goose geese shut up shutting up", "", "oh my big god oh my god may could have been", "hello_ helló hellóx chilling well done well well done",
]


def test_patterns_in_one_pass_count_as_each_alone(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "text_id int, text string").select("text_id", T.tokens(F.col("text")).alias("tokens"))
    table = registry.gaming_registry(patterns={"again_count": [r"\bwell done\b", r"\bwell\b", r"\bwell\b", r"\bwee wee\b"]}) | {n: b for n, b in registry.base_registry().items() if isinstance(b, registry.Patterns)}
    names = [n for n, b in table.items() if isinstance(b, registry.Patterns)]
    got = registry.measure(df, names, table).collect()
    j = T.joined(F.col("tokens"))
    want = df.select("text_id", *(sum((F.regexp_count(j, F.lit(f"(?iU){p}")).cast("long") for p in table[n].patterns), F.lit(0).cast("long")).alias(n) for n in names if not table[n].finish)).collect()
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert {n: g[n] for n in w.asDict()} == w.asDict()


def test_density_sweep_runs_kmeans_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 2), float(i % 3), 1.0]) for i in range(12)], "id long, vector array<double>")
    monkeypatch.setattr(clusters, "MOST", 8)
    ran, kmeans = [], clusters.kmeans
    monkeypatch.setattr(clusters, "kmeans", lambda v: ran.append(1) or kmeans(v))
    got = sorted(map(tuple, clusters.density_sweep(df, (3, 5)).collect()))
    assert len(ran) == 1 and got == sorted((n, r.id, r.label) for r in kmeans(df).collect() for n in (3, 5))


def test_frequencies_shuffle_no_row_per_token(spark):
    rows = [("a", ["x", "x", "y"]), (None, ["x"]), ("a", ["x"]), ("b", []), ("c", None)]
    got = lexical.frequencies(spark.createDataFrame(rows, "text_id string, tokens array<string>"))
    assert {(r.text_id, r.token): r.f for r in got.collect()} == {("a", "x"): 3, ("a", "y"): 1, (None, "x"): 1}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()

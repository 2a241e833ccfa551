"""Awkward rows given to the operators themselves: null and repeated rows, ties, clashing names, other id types, long texts."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, jaccard, licences, lines, lm, media, pack, pii, substrings, toxicity

CLASH = "doc h row number numbers key k k1 sid token tokens pos found old new gap part range ids kind at n w x size start items spans hits component component_id score label toxic wanted place head words".split()
LINE = "one line of some seven words here"
ROWS = [
    (None, f"{LINE}\nfirst of none"), (None, f"{LINE}\nsecond of none"), (None, None), (None, ""), (7, f"{LINE}\n{LINE}"), (7, f"{LINE}\n{LINE}"), (7, "another text of the same id"), (3, f"x\n{LINE}"), (9, " \n\t"),
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


ITEMS = [(1, "seven words here"), (2, "of some seven"), (None, None)]


def _model(spark):
    rows = [(i, "fine words of calm people here." if i % 3 else "you utter grumbler and blatherer.", int(i % 3 == 0)) for i in range(60)]
    return toxicity.train(spark.createDataFrame([(i, f"{t} {i}", x) for i, t, x in rows], "doc_id long, text string, toxic int"))


MAKES = {
    "media": lambda df: media.media_features(media.encode_media(df.select("doc_id", "text"))).drop("fingerprints"),
    "lm": lambda df: lm.score_documents(df), "pack": lambda df: pack.pack(df).drop("sequence_id", "offset"), "jaccard": lambda df: jaccard.similar_groups(df),
    "substrings": lambda df: substrings.remove_repeats(df), "licences": lambda df: licences.scan_licences(df),
    "scan": lambda df: decontaminate.scan(df, df.sparkSession.createDataFrame(ITEMS, "item_id long, text string"), window=3),
}


@pytest.mark.parametrize("name", MAKES)
def test_other_columns_change_nothing(plain, clashing, name):
    """Results with clashing columns are those without, and equal rows get equal results."""
    a, b = (collections.Counter(map(str, MAKES[name](df).collect())) for df in (plain, clashing))
    assert a == b
    if name != "pack":
        assert sum(a.values()) == len(ROWS)


def test_rows_keep_their_other_columns(spark, plain, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    model = _model(spark)
    made = {
        "lines": lambda df: lines.dedup_lines(df), "decontaminate": lambda df: decontaminate.decontaminate(df, items, window=3), "jaccard": lambda df: jaccard.keep_one(df),
        "clean": lambda df: toxicity.keep_clean(df, model), "pii": lambda df: pii.pseudonymise(df, "k"),
    }
    for name, make in made.items():
        one, two = make(plain), make(clashing)
        extra = [c for c in two.columns if c not in clashing.columns]
        assert two.columns == [*clashing.columns, *extra] and len(extra) == (name == "pii"), name
        assert collections.Counter((r.doc_id, r.text) for r in one.collect()) == collections.Counter((r.doc_id, r.text) for r in two.collect()), name
        assert all(r[c] == f"own {c}" for r in two.collect() for c in CLASH), name


def test_line_dedup_of_rows_without_ids(plain):
    """Rows without an id come last, told apart by their texts; equal rows count as one; a later line of a row goes too."""
    got = collections.Counter((r.doc_id, r.text) for r in lines.dedup_lines(plain).collect())
    assert got == {
        (3, f"x\n{LINE}"): 1, (7, ""): 2, (7, "another text of the same id"): 1, (9, " \n\t"): 1, (None, "first of none"): 1, (None, "second of none"): 1, (None, ""): 1, (None, None): 1,
    }


def test_line_dedup_of_text_ids(spark):
    df = spark.createDataFrame([("b", LINE), ("a", LINE), (None, LINE)], "doc_id string, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {"a": LINE, "b": "", None: ""}


def test_substrings_of_rows_without_ids(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(None, f"a {passage}"), (None, f"b {passage}"), (4, passage), (4, passage)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.kept) for r in substrings.remove_repeats(df).collect())
    assert got == {(4, passage): 2, (None, "a"): 1, (None, "b"): 1}


def test_groups_of_rows_without_ids(spark):
    text = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (5, text), (2, text), (None, "alone here"), (2, text)], "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.component_id) for r in jaccard.similar_groups(df).collect()) == {(None, 2): 1, (5, 2): 1, (2, 2): 2, (None, None): 1}


def test_counts_of_a_table_that_shuffles(spark, plain):
    """The language model reads its input twice; a shuffled one is stored first."""
    want = sorted(map(str, lm.score_documents(plain).collect()))
    assert sorted(map(str, lm.score_documents(plain.repartition(5, F.rand())).collect())) == want
    assert common.settled(plain) is plain and common.settled(plain.repartition(5)) is not plain


def test_very_long_texts_take_time_in_proportion(spark):
    """A line of many words, a text of many lines, a text that a cut leaves in many pieces."""

    def took(n):
        words = [f"w{i * 7919 % 100_003}" for i in range(n)]
        rows = [(1, " ".join(words)), (2, "\n".join(" ".join(words[i : i + 6]) for i in range(0, n, 6))), (3, " ".join(words[::-1]) + " x")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        items = spark.createDataFrame([(1, " ".join(words[10:18]))], "item_id long, text string")
        began = time.time()
        kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
        assert kept[1] == rows[0][1] and kept[2] == rows[1][1]
        cut = {r.doc_id: r.text for r in decontaminate.decontaminate(df, items, min_items=2).collect()}
        assert len(cut[1].split()) == n - 8 and len(cut[2].split()) == n - 8
        return time.time() - began

    took(2_000)
    small, large = took(10_000), took(100_000)
    assert large < 30 * small


def test_found_of_pseudonyms_gives_way(spark):
    df = spark.createDataFrame([("a@b.org", 1)], "text string, found int")
    one = pii.pseudonymise(df, "k").first()
    assert one.found == 1 and one.found_[0].kind == "email"

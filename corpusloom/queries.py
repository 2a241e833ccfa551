"""Queries over the test tables, by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import wordlists as W
from .operators import clusters, explore, export, filters, lexical, records, style, vectors
from .plans import registry
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Uses all cores where a small table is a few splits; a table of more splits than cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A text per document."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("text_id"), T.tokens(F.col("text")).alias("tokens"))


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their source."""
    return spread(table(spark, d, "documents").select("doc_id", "text", "source")).select(F.col("source").alias("text_id"), F.col("doc_id").alias("file_id"), F.col("doc_id").alias("ord"), T.tokens(F.col("text")).alias("tokens"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A row per document with its source as text: for operators that count by (text, token)."""
    return doc_files(spark, d).select("text_id", "tokens")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits``; minus zero becomes 0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- SQL pieces
TOK = r"""WITH tok AS (SELECT doc_id AS text_id, source, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*'), lambda x: lower(x)) AS t FROM documents),
lng AS (SELECT text_id, source, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tok)"""


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _r(x: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0"


def _set_sql(words) -> str:
    return f"CAST(len(list_filter(t, lambda x: x IN {_list(words)})) AS BIGINT)"


SPACED = "(' ' || array_to_string(t, '  ') || ' ')"


def _phrase_sql(p: str) -> str:
    s = " " + "  ".join(p.split()) + " "
    return f"CAST((length({SPACED}) - length(replace({SPACED}, '{s}', ''))) / {len(s)} AS BIGINT)"


def _words_sql(items) -> str:
    one = [w for w in items if " " not in w]
    return " + ".join([_set_sql(one), *(_phrase_sql(p) for p in items if " " in p)])


# ---------------------------------------------------------------- tokens and frequencies
@query("token_counts", f"{TOK} SELECT text_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_types FROM tok")
def token_counts(spark, d):
    return documents(spark, d).select("text_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_types"))


_FREQ = """, f AS (SELECT {key} AS text_id, token, count(*) AS f FROM lng GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY f, token) AS i FROM f),
m AS (SELECT text_id, sum(f) AS n, count(*) AS v, sum(f * f) AS s2, sum(f * length(token)) AS chars, sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS once,
  sum(CASE WHEN f = 2 THEN 1 ELSE 0 END) AS twice, sum(i * f) AS ranked FROM r GROUP BY 1),
a AS (SELECT b.text_id, coalesce(n, 0) AS n, coalesce(v, 0) AS v, s2, chars, once, twice, ranked FROM (SELECT DISTINCT {base} AS text_id FROM tok) b LEFT JOIN m USING (text_id))
SELECT text_id, CAST(n AS BIGINT) AS n_tokens, CAST(v AS BIGINT) AS n_types,
round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) + 0.0 AS "TTR", round(CASE WHEN n >= 10 THEN 1e4 * (s2 / (CAST(n AS DOUBLE) * n) - 1.0 / n) ELSE 0 END, 6) + 0.0 AS yules_k,
round(CASE WHEN n > 0 THEN chars / n ELSE 0 END, 6) + 0.0 AS avg_word_length, round(CASE WHEN n >= 10 THEN once / v ELSE 0 END, 6) + 0.0 AS hapax_ratio,
round(CASE WHEN n >= 10 THEN twice / v ELSE 0 END, 6) + 0.0 AS dis_ratio,
round(CASE WHEN n >= 10 AND v >= 2 THEN least(1.0, greatest(0.0, 2.0 * ranked / (CAST(v AS DOUBLE) * n) - (v + 1.0) / v)) ELSE 0 END, 6) + 0.0 AS word_burstiness FROM a"""


@query("frequency_metrics", TOK + _FREQ.format(key="text_id", base="text_id"))
def frequency_metrics(spark, d):
    return rounded(lexical.frequency_metrics(documents(spark, d)))


@query("frequency_metrics_by_source", TOK + _FREQ.format(key="source", base="source"))
def frequency_metrics_by_source(spark, d):
    return rounded(lexical.frequency_metrics(sources(spark, d)))


@query(
    "mattr_25",
    f"""{TOK}, p AS (SELECT l.text_id, pos, len(t) AS n, coalesce(lag(pos) OVER (PARTITION BY l.text_id, token ORDER BY pos), -1) AS prev FROM lng l JOIN tok USING (text_id)),
m AS (SELECT text_id, sum(greatest(least(pos, n - 25) - greatest(prev + 1, pos - 24, 0) + 1, 0)) / (max(n) - 24) / 25.0 AS x FROM p WHERE n >= 25 GROUP BY 1)
SELECT text_id, {_r("coalesce(x, 0)")} AS "MATTR" FROM tok LEFT JOIN m USING (text_id)""",
)
def mattr_25(spark, d):
    return rounded(lexical.mattr(documents(spark, d)))


def _grams(n: int) -> str:
    return f"list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' ')))"


@query(
    "unique_ngrams",
    f"{TOK} SELECT text_id, CAST(CASE WHEN len(t) >= 2 THEN len({_grams(2)}) ELSE 0 END AS BIGINT) AS unique_bigrams, CAST(CASE WHEN len(t) >= 3 THEN len({_grams(3)}) ELSE 0 END AS BIGINT) AS unique_trigrams FROM tok",
)
def unique_ngrams(spark, d):
    return lexical.unique_ngrams(documents(spark, d))


@query(
    "block_unique_ngrams",
    f"""{TOK}, o AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY text_id, pos) - 1 AS i FROM lng),
b AS (SELECT source, i // 5000 AS k, token, lead(token) OVER w AS n1, lead(token, 2) OVER w AS n2 FROM o WINDOW w AS (PARTITION BY source, i // 5000 ORDER BY i)),
c AS (SELECT source, k, count(*) AS n, count(DISTINCT CASE WHEN n1 IS NOT NULL THEN token || ' ' || n1 END) AS u2, count(DISTINCT CASE WHEN n2 IS NOT NULL THEN token || ' ' || n1 || ' ' || n2 END) AS u3 FROM b GROUP BY 1, 2)
SELECT s.source AS text_id, {_r("coalesce(avg(u2), 0)")} AS moving_unique_bigrams, {_r("coalesce(avg(u3), 0)")} AS moving_unique_trigrams FROM (SELECT DISTINCT source FROM tok) s LEFT JOIN c ON s.source = c.source AND c.n >= 4000 GROUP BY 1""",
)
def block_unique_ngrams(spark, d):
    return rounded(lexical.moving_unique_ngrams(doc_files(spark, d)))


def _entropy(n: int) -> str:
    start = ", ".join(["'<s>'"] * (n - 1))
    return f"""{TOK}, p AS (SELECT text_id, len(t) AS n, len(list_distinct(t)) AS v, list_concat([{start}], t, ['</s>']) AS pad FROM tok WHERE len(t) >= {n}),
g AS (SELECT text_id, n, v, unnest(list_transform(range(1, len(pad) - {n} + 2), lambda i: array_to_string(pad[i:i + {n - 2}], ' '))) AS c, unnest(pad[{n}:]) AS w FROM p),
k AS (SELECT text_id, n, v, c, w, count(*) AS k FROM g GROUP BY 1, 2, 3, 4, 5), s AS (SELECT *, sum(k) OVER (PARTITION BY text_id, c) AS ck FROM k),
e AS (SELECT text_id, -sum(k * log2((k + 1.0) / (ck + v + 2.0))) / (max(n) + 1) AS x FROM s GROUP BY 1)
SELECT text_id, {_r("coalesce(x, 0)")} AS ngram_entropy_{n} FROM tok LEFT JOIN e USING (text_id)"""


@query("ngram_entropy_2", _entropy(2))
def ngram_entropy_2(spark, d):
    return rounded(lexical.ngram_entropy(documents(spark, d), 2))


@query("ngram_entropy_3", _entropy(3))
def ngram_entropy_3(spark, d):
    return rounded(lexical.ngram_entropy(documents(spark, d), 3))


_GROUP = "CASE " + " ".join(f"WHEN token IN {_list(W.PRONOUNS[g].split())} THEN '{g}'" for g in ("i", "you", "we")) + " END"


@query(
    "pronoun_switching",
    f"""{TOK}, g AS (SELECT text_id, pos, {_GROUP} AS g FROM lng), h AS (SELECT text_id, g, lag(g) OVER (PARTITION BY text_id ORDER BY pos) AS p FROM g WHERE g IS NOT NULL),
s AS (SELECT text_id, sum(CASE WHEN g <> p THEN 1 ELSE 0 END) AS n FROM h GROUP BY 1)
SELECT text_id, {_r("CASE WHEN len(t) > 0 THEN coalesce(n, 0) / len(t) * 100 ELSE 0 END")} AS pronoun_switching FROM tok LEFT JOIN s USING (text_id)""",
)
def pronoun_switching(spark, d):
    return rounded(lexical.pronoun_switching(documents(spark, d)))


# ---------------------------------------------------------------- registry metrics
_SETS = registry._sets()


@query("token_set_counts", f"{TOK} SELECT text_id, " + ", ".join(f"{_set_sql(w)} AS {n}" for n, w in _SETS.items()) + " FROM tok")
def token_set_counts(spark, d):
    return registry.measure(documents(spark, d), list(_SETS))


_HEDGE = [w for p in W.PATTERNS["hedge_count"] for w in ({"seems?": ["seem", "seems"], "appears?": ["appear", "appears"]}.get(p[2:-2], [p[2:-2].lower()]))]
_PLAIN = {
    "hedge_count": _HEDGE, "custom_marker_count": ["i think", "probably", "i feel", "maybe"], "smore_markers_2_count": ["also", "too"],
    "demonstrative_count": [p[2:-2] for p in W.PATTERNS["demonstrative_count"]], "color_count": [*W.COLOURS, *W.COLOUR_PHRASES], "dev_specialty_count": ["this is a"],
    **{f"color_{c}_count": [c, *(c + e for e in ends.split("|"))] for c, ends in W.COLOUR_ENDINGS.items()},
}


@query("pattern_counts", f"{TOK} SELECT text_id, " + ", ".join(f"{_words_sql(w)} AS {n}" for n, w in _PLAIN.items()) + " FROM tok")
def pattern_counts(spark, d):
    return registry.measure(documents(spark, d), list(_PLAIN))


_ENDS = "|".join(W.LATINATE)


@query(
    "word_form_counts",
    f"""{TOK} SELECT text_id, CAST(octet_length(encode(array_to_string(t, ' '))) AS BIGINT) AS byte_count,
CAST(len(list_filter(t, lambda x: length(x) >= 5 AND regexp_matches(x, '({_ENDS})$'))) AS BIGINT) AS latinate_word_ratio,
CAST(len(list_filter(t, lambda x: x IN {_list(W.POSSESSIVES)} OR x LIKE '%''s')) AS BIGINT) AS possessive_count,
CAST(len(list_filter(t, lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}ing') AND x NOT IN {_list(W.NOT_GERUNDS)})) AS BIGINT) AS gerund_count,
CAST(len(list_distinct(list_filter(t, lambda x: regexp_full_match(x, '[a-z]+(''[a-z]+)?') AND length(x) >= 2))) AS BIGINT) AS unique_words_count FROM tok""",
)
def word_form_counts(spark, d):
    return registry.measure(documents(spark, d), ["byte_count", "latinate_word_ratio", "possessive_count", "gerund_count", "unique_words_count"])


@query(
    "article_counts",
    f"""{TOK}, p AS (SELECT text_id, pos, token, lag(token) OVER w AS p1, lag(token, 2) OVER w AS p2 FROM lng WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
q AS (SELECT text_id, token IN ('the', 'a', 'an') AS art, coalesce(p1 IN ('the', 'a', 'an'), false) AS part, coalesce(token = 'the' AND p1 = 'what', false) AS used, coalesce(p1 = 'the' AND p2 = 'what', false) AS pused FROM p),
c AS (SELECT text_id, sum(CASE WHEN art AND NOT part THEN 1 ELSE 0 END) AS raw, sum(CASE WHEN art AND NOT used AND NOT (part AND NOT pused) THEN 1 ELSE 0 END) AS n FROM q GROUP BY 1)
SELECT text_id, CAST(coalesce(n, 0) AS BIGINT) AS article_count, CAST(coalesce(raw, 0) AS BIGINT) AS article_count_raw FROM tok LEFT JOIN c USING (text_id)""",
)
def article_counts(spark, d):
    return registry.measure(documents(spark, d), ["article_count", "article_count_raw"])


_DEICTIC = [p[2:-2] for p in W.PATTERNS["deictic_spatial_temporal"]]
_NARRATION = [p[2:-2] for p in W.PATTERNS["narration_continuation_ratio"] if p.startswith(r"\b")]  # one asks for a line end, which joined tokens lack


@query(
    "rates_per_1000",
    f"""{TOK} SELECT text_id, {_r(f"CASE WHEN len(t) >= 10 THEN ({_words_sql(_DEICTIC)}) / len(t) * 1000 ELSE 0 END")} AS deictic_spatial_temporal,
{_r(f"CASE WHEN len(t) > 0 THEN ({_words_sql(_NARRATION)}) / len(t) * 1000 ELSE 0 END")} AS narration_continuation_ratio FROM tok""",
)
def rates_per_1000(spark, d):
    return rounded(registry.measure(documents(spark, d), ["deictic_spatial_temporal", "narration_continuation_ratio"]))


#: Letters beyond ASCII as underscores: word characters to either engine.
ASCII = f"{TOK}, asc_ AS (SELECT text_id, t, translate(array_to_string(t, ' '), 'éóèñüçäöêßíáúàâîôûùïë', '_____________________') AS j FROM tok)"


def _regex_sql(patterns) -> str:
    """Sum of matches that do not overlap; for patterns without look-around."""
    return " + ".join("CAST(len(regexp_extract_all(j, '(?i)" + p.replace("'", "''") + "')) AS BIGINT)" for p in patterns)


_REGEX = ["discussion_commentary_count", "simile_count", "vulnerability", "family_exclamations", "smore_markers_3_count"]


@query("regex_counts", f"{ASCII} SELECT text_id, " + ", ".join(f"{_regex_sql(W.PATTERNS[n])} AS {n}" for n in _REGEX)
       + f", {_r('CASE WHEN len(t) >= 1 THEN (' + _regex_sql(W.PATTERNS['elaboration_explanation_ratio']) + ') / len(t) * 1000 ELSE 0 END')} AS elaboration_explanation_ratio, "
       + f"{_regex_sql(W.PATTERNS['exclamation_interjection'])} AS imperative_exclamation_count FROM asc_")
def regex_counts(spark, d):
    return rounded(registry.measure(documents(spark, d), [*_REGEX, "elaboration_explanation_ratio", "imperative_exclamation_count"]))


@query(
    "readability",
    f"""WITH s AS (SELECT doc_id AS text_id, list_filter(regexp_split_to_array(text, '[.!?]+(?:\\s+|$)'), lambda x: regexp_matches(x, '\\S')) AS s FROM documents),
w AS (SELECT text_id, len(s) AS ns, list_transform(s, lambda x: regexp_extract_all(x, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS l FROM s),
f AS (SELECT text_id, ns, len(list_filter(l, lambda x: len(x) > 0)) AS nf, flatten(l) AS a FROM w),
y AS (SELECT text_id, ns, nf, len(a) AS nw, list_sum(list_transform(list_transform(a, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda z: CASE WHEN z = '' THEN 0 ELSE
greatest(1, len(regexp_extract_all(z, '[aeiouy]+')) - CASE WHEN z LIKE '%e' AND len(regexp_extract_all(z, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)) AS sy FROM f)
SELECT text_id, {_r("CASE WHEN ns > 0 AND nw > 0 THEN 206.835 - 1.015 * (nw / ns) - 84.6 * (sy / nw) ELSE 0 END")} AS readability, {_r("CASE WHEN nf > 0 THEN nw / nf ELSE 0 END")} AS average_sentence_length FROM y""",
)
def readability(spark, d):
    return rounded(lexical.readability(spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("text_id"), "text")))


# ---------------------------------------------------------------- niche packs
_LETTERS = "abcdefghijklmnopqrstuvwxyzñ"


@query("letter_counts", f"{TOK}, j AS (SELECT text_id, array_to_string(t, ' ') AS j FROM tok) SELECT text_id, " + ", ".join(f"CAST(length(j) - length(replace(j, '{c}', '')) AS BIGINT) AS letter_{c}_count" for c in _LETTERS) + " FROM j")
def letter_counts(spark, d):
    return registry.measure(documents(spark, d), [f"letter_{c}_count" for c in _LETTERS], registry.gaming_registry())


_GAMING = ("the", "go", "man", "also", "too", "well", "you", "i", "no")
_GAMING_PHRASES = ("going_to", "over_to", "oh_no", "i_think", "well_done")


@query(
    "gaming_patterns",
    f"{TOK} SELECT text_id, " + ", ".join([*(f"{_set_sql([w])} AS {w}_count" for w in _GAMING if w != "no"), *(f"{_phrase_sql(p.replace('_', ' '))} AS {p}_count" for p in _GAMING_PHRASES)]) + " FROM tok",
)
def gaming_patterns(spark, d):
    return registry.measure(documents(spark, d), [f"{w}_count" for w in (*(g for g in _GAMING if g != "no"), *_GAMING_PHRASES)], registry.gaming_registry())


_AROUND = lambda ps: any("(?<" in p or "(?!" in p for p in ps)
_GAMING_ALL = {n: p for n, p in registry.gaming_patterns().items() if not _AROUND(p)}
_GAMING_AROUND = [n for n, p in registry.gaming_patterns().items() if _AROUND(p)] + ["peak_comedy_count"]


@query("gaming_all", f"{ASCII} SELECT text_id, " + ", ".join(f'{_regex_sql(p)} AS "{n}"' for n, p in _GAMING_ALL.items()) + " FROM asc_")
def gaming_all(spark, d):
    return registry.measure(documents(spark, d), list(_GAMING_ALL), registry.gaming_registry())


@query("gaming_lookaround")
def gaming_lookaround(spark, d):
    return registry.measure(documents(spark, d), _GAMING_AROUND, registry.gaming_registry())


_TERMS = {"minecraft_lexicon_density": ["the", "of"], "vehicle_lexicon_density": ["de", "der", "und"]}


@query("gaming_terms", f"{TOK} SELECT text_id, " + ", ".join(f"CAST({_set_sql(w)} AS DOUBLE) AS {n}" for n, w in _TERMS.items()) + " FROM tok")
def gaming_terms(spark, d):
    return registry.measure(documents(spark, d), list(_TERMS), registry.gaming_registry(terms=_TERMS))


@query("substituted_tokens", f"{TOK}, s AS (SELECT text_id, list_transform(t, lambda x: CASE x WHEN 'the' THEN 'a' WHEN 'der' THEN 'die' ELSE x END) AS t FROM tok) SELECT text_id, CAST(len(list_distinct(t)) AS BIGINT) AS n_types, {_set_sql(['a'])} AS n_a FROM s")
def substituted_tokens(spark, d):
    t = documents(spark, d).select("text_id", T.substitute(F.col("tokens"), {"the": "a", "der": "die"}).alias("t"))
    return t.select("text_id", F.size(F.array_distinct("t")).cast("long").alias("n_types"), T.set_count(F.col("t"), ["a"]).alias("n_a"))


_EDU = {g: ps for g, ps in W.EDUCATIONAL_PHRASES.items() if not any(set(p) & set("?\\+") for p in ps)}


@query("educational_phrases", f"{TOK} SELECT text_id, " + ", ".join(f"{_words_sql(ps)} AS {g}_count" for g, ps in _EDU.items()) + " FROM tok")
def educational_phrases(spark, d):
    return registry.measure(documents(spark, d), [f"{g}_count" for g in _EDU], registry.educational_registry())


#: A small lexicon for the test tables; real ones are a table of (field, term).
_LEXICON = {"articles": ("the", "der", "las", "une"), "physics": ("in", "de", "la"), "mathematics": ("and", "und", "of"), "education": ("with", "par")}
_LEX_SQL = r"w AS (SELECT text_id, unnest(regexp_extract_all(lower(array_to_string(t, ' ')), '[a-zA-ZÀ-ÿ]+')) AS token FROM tok), " + "lex(field, term) AS (VALUES " + ", ".join(f"('{f}', '{t}')" for f, ts in _LEXICON.items() for t in ts) + ")"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in _LEXICON.items() for t in ts], "field string, term string")


@query("educational_lexicon", f"{TOK}, {_LEX_SQL} SELECT text_id, field, CAST(count(*) AS BIGINT) AS n FROM w JOIN lex ON token = term GROUP BY 1, 2")
def educational_lexicon(spark, d):
    return registry.lexicon_counts(documents(spark, d), _lexicon(spark))


@query("domain_breadth", f"{TOK}, {_LEX_SQL} SELECT text_id, CAST(count(DISTINCT field) AS BIGINT) AS academic_domain_breadth FROM w JOIN lex ON token = term GROUP BY 1")
def domain_breadth(spark, d):
    return registry.domain_breadth(registry.lexicon_counts(documents(spark, d), _lexicon(spark)))


@query(
    "vocabulary_split",
    f"""{TOK}, dict AS (SELECT DISTINCT token AS w FROM lng JOIN benchmark b ON false UNION SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) FROM benchmark),
f AS (SELECT text_id, token, count(*) AS f FROM lng GROUP BY 1, 2), k AS (SELECT text_id, f, w IS NOT NULL AND regexp_full_match(token, '[a-z'']{{1,30}}') AS k FROM f LEFT JOIN dict ON token = w)
SELECT tok.text_id, CAST(coalesce(sum(CASE WHEN k THEN 1 ELSE 0 END), 0) AS BIGINT) AS unique_non_oov_count, CAST(coalesce(sum(CASE WHEN NOT k THEN 1 ELSE 0 END), 0) AS BIGINT) AS unique_oov_count,
CAST(coalesce(sum(CASE WHEN k THEN f ELSE 0 END), 0) AS BIGINT) AS total_non_oov_count, CAST(coalesce(sum(CASE WHEN NOT k THEN f ELSE 0 END), 0) AS BIGINT) AS total_oov_count FROM tok LEFT JOIN k ON tok.text_id = k.text_id GROUP BY 1""",
)
def vocabulary_split(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return lexical.vocabulary_split(documents(spark, d), words)


# ---------------------------------------------------------------- corpus-wide
def _fighting(rank: str) -> str:
    return f"""{TOK}, f AS (SELECT source AS text_id, token, count(*) AS f FROM lng GROUP BY 1, 2), n AS (SELECT text_id, sum(f) AS n FROM f GROUP BY 1),
t AS (SELECT token, sum(f) AS e FROM f GROUP BY 1), a AS (SELECT sum(n) AS a FROM n),
c AS (SELECT f.text_id, f.token, CAST(f AS DOUBLE) AS f, CAST(e - f AS DOUBLE) AS r, CAST(n AS DOUBLE) AS n, CAST(a - n AS DOUBLE) AS nr, count(*) OVER (PARTITION BY f.text_id) AS v FROM f JOIN n USING (text_id) JOIN t USING (token), a WHERE f >= 5 AND a > n),
z AS (SELECT *, (ln((f + 0.01) / (n + 0.01 * v)) - ln((r + 0.01) / (nr + 0.01 * v))) / sqrt(1 / (f + 0.01) + 1 / (r + 0.01)) AS z FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY round(z, 9) DESC, token) AS rn FROM z)
SELECT n.text_id, {_r("z")} AS z, token AS word FROM n LEFT JOIN k ON n.text_id = k.text_id AND rn = least({rank}, v)"""


@query("fighting_words_peak", _fighting("1"))
def fighting_words_peak(spark, d):
    return rounded(style.fighting_words(lexical.frequencies(sources(spark, d)), 1))


@query("fighting_words_floor", _fighting("1000"))
def fighting_words_floor(spark, d):
    return rounded(style.fighting_words(lexical.frequencies(sources(spark, d)), style.FLOOR_RANK))


_SHE = "CASE token WHEN 'she' THEN 'he' WHEN 'her' THEN 'him' WHEN 'herself' THEN 'himself' WHEN 'okay' THEN 'ok' ELSE token END"
_PROFILE = f"""{TOK}, fw AS (SELECT unnest({[*W.FUNCTION_WORDS]}) AS word), e AS (SELECT source AS text_id, {_SHE} AS w, count(*) AS f FROM lng GROUP BY 1, 2), n AS (SELECT text_id, sum(f) AS n FROM e GROUP BY 1),
pr AS (SELECT n.text_id, word, coalesce(f, 0) / n AS rate FROM n CROSS JOIN fw LEFT JOIN e ON e.text_id = n.text_id AND w = word),
zz AS (SELECT text_id, word, rate, (rate - avg(rate) OVER (PARTITION BY word)) / CASE WHEN stddev_pop(rate) OVER (PARTITION BY word) = 0 THEN 1e-12 ELSE stddev_pop(rate) OVER (PARTITION BY word) END AS z FROM pr),
dl AS (SELECT x.text_id AS a, y.text_id AS b, avg(abs(x.z - y.z)) AS delta FROM zz x JOIN zz y ON x.word = y.word AND x.text_id <> y.text_id GROUP BY 1, 2)"""


@query("burrows_profile", f"{_PROFILE} SELECT text_id, word, {_r('rate', 9)} AS rate FROM pr")
def burrows_profile(spark, d):
    return rounded(style.profiles(sources(spark, d)), 9)


def _z(spark, d) -> DataFrame:
    return style.z_scores(style.profiles(sources(spark, d)))


def _pairs(spark, d) -> DataFrame:
    return style.both_ways(style.delta_pairs(_z(spark, d)))


@query("burrows_delta_pairs", f"{_PROFILE} SELECT a, b, {_r('delta')} AS delta, {_r('1 / (1 + delta)')} AS burrows_sim FROM dl WHERE a < b")
def burrows_delta_pairs(spark, d):
    return rounded(style.delta_pairs(_z(spark, d)))


@query("burrows_nearest", f"{_PROFILE}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(delta, 9), b) AS rank FROM dl) SELECT a, CAST(rank AS INTEGER) AS rank, b, {_r('delta')} AS delta FROM k WHERE rank <= 3")
def burrows_nearest(spark, d):
    return rounded(vectors.top_k(_pairs(spark, d), 3, "delta", nearest=False))


@query("delta_percentile", f"{_PROFILE}, p AS (SELECT a, b, round(delta, 9) AS delta FROM dl WHERE a < b) SELECT a, b, {_r('cume_dist() OVER (ORDER BY delta) * 100')} AS percentile FROM p")
def delta_percentile(spark, d):
    p = style.delta_pairs(_z(spark, d)).select("a", "b", F.round("delta", 9).alias("delta"))
    return rounded(explore.percentiles(p, "delta").select("a", "b", "percentile"))


@query(
    "pair_decomposition",
    f"""{_PROFILE}, w AS (SELECT x.word, x.z AS za, y.z AS zb, abs(x.z - y.z) AS diff, (x.z + y.z) / 2 AS mean_z FROM zz x JOIN zz y ON x.word = y.word AND x.text_id = 'src0' AND y.text_id = 'src1')
SELECT word, {_r("za")} AS za, {_r("zb")} AS zb, {_r("diff")} AS diff, {_r("mean_z")} AS mean_z, {_r("CASE WHEN sign(za) = sign(zb) THEN least(abs(za), abs(zb)) * exp(-diff) ELSE 0 END")} AS driver,
{_r("abs(mean_z) * exp(-diff)")} AS shared, {_r("diff / sum(diff) OVER () * 100")} AS share FROM w""",
)
def pair_decomposition(spark, d):
    return rounded(style.pair_decomposition(_z(spark, d), "src0", "src1"))


_CLUSTER = "CAST(substr(text_id, 4) AS INTEGER) % 3"


def _clusters(spark, d, name: str = "text_id") -> DataFrame:
    t = table(spark, d, "documents").select(F.col("source").alias(name)).distinct()
    return t.withColumn("cluster", F.substring(name, 4, 9).cast("int") % 3)


@query(
    "cluster_decomposition",
    f"""{_PROFILE}, m AS (SELECT {_CLUSTER} AS cluster, word, avg(z) AS mz, stddev_pop(z) AS sd FROM zz GROUP BY 1, 2)
SELECT cluster, word, {_r("mz")} AS mean_z, {_r("abs(mz) / sum(abs(mz)) OVER (PARTITION BY cluster) * 100")} AS share, CAST(sign(mz) AS INTEGER) AS sign,
{_r("CASE WHEN sd < 1e-12 AND mz = 0 THEN 0 WHEN sd < 1e-12 THEN 99 ELSE abs(mz) / sd END")} AS consistency FROM m""",
)
def cluster_decomposition(spark, d):
    return rounded(style.cluster_decomposition(_z(spark, d), _clusters(spark, d)))


@query(
    "burrows_capitals",
    f"""{_PROFILE}, g AS (SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INTEGER) % 3 AS g FROM documents),
s AS (SELECT x.g, x.id, coalesce(sum(delta), 0) / (count(delta) + 1) AS m FROM g x LEFT JOIN (SELECT a, b, delta, y.g AS h FROM dl JOIN g y ON b = y.id) p ON p.a = x.id AND p.h = x.g GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(m, 9), id) AS rn FROM s) SELECT g AS "group", id FROM k WHERE rn = 1""",
)
def burrows_capitals(spark, d):
    return vectors.medoids(_pairs(spark, d), _clusters(spark, d, "id").withColumnRenamed("cluster", "group"))


@query(
    "rate_context",
    f"""{_PROFILE} SELECT text_id, word, {_r("rate", 9)} AS rate, {_r("(rate - avg(rate) OVER w) / greatest(stddev_pop(rate) OVER w, 1e-9, avg(rate) OVER w * 1e-3)")} AS z,
{_r("cume_dist() OVER (PARTITION BY word ORDER BY round(rate, 12)) * 100")} AS percentile FROM pr WINDOW w AS (PARTITION BY word)""",
)
def rate_context(spark, d):
    p = style.rate_context(style.profiles(sources(spark, d)).withColumn("rate", F.round("rate", 12)))
    return p.select("text_id", "word", (F.round("rate", 9) + 0.0).alias("rate"), (F.round("z", 6) + 0.0).alias("z"), (F.round("percentile", 6) + 0.0).alias("percentile"))


@query(
    "cluster_summary",
    f"""{_PROFILE}, m AS (SELECT {_CLUSTER} AS cluster, word, avg(z) AS mz, count(*) AS n FROM zz GROUP BY 1, 2)
SELECT cluster, CAST(max(n) AS BIGINT) AS n, {_r("avg(abs(mz))")} AS mean_abs_z, max(n) = (SELECT count(DISTINCT text_id) FROM zz) AS whole_corpus FROM m GROUP BY 1""",
)
def cluster_summary(spark, d):
    return rounded(style.cluster_summary(_z(spark, d), _clusters(spark, d)))


@query(
    "top_contributors",
    f"""{_PROFILE}, w AS (SELECT x.word, abs(x.z - y.z) AS diff FROM zz x JOIN zz y ON x.word = y.word AND x.text_id = 'src0' AND y.text_id = 'src1'), s AS (SELECT word, diff / sum(diff) OVER () * 100 AS share FROM w),
k AS (SELECT *, row_number() OVER o AS rank, sum(share) OVER o AS c FROM s WINDOW o AS (ORDER BY round(share, 9) DESC, word)) SELECT CAST(rank AS INTEGER) AS rank, word, {_r("share")} AS share, {_r("c")} AS cumulative FROM k WHERE rank <= 12""",
)
def top_contributors(spark, d):
    return rounded(style.top_contributors(style.pair_decomposition(_z(spark, d), "src0", "src1")))


@query("aggregated_rate", f"{_PROFILE} SELECT text_id, {_r('sum(rate)', 9)} AS rate FROM pr WHERE word IN ('the', 'of', 'and') GROUP BY 1")
def aggregated_rate(spark, d):
    return rounded(style.aggregated_rate(style.profiles(sources(spark, d)), ["the", "of", "and"]), 9)


@query("words_per_file", f"{TOK} SELECT source AS text_id, {_r('avg(len(t))')} AS avg_words_per_video FROM tok WHERE len(t) > 0 GROUP BY 1")
def words_per_file(spark, d):
    return rounded(lexical.words_per_file(doc_files(spark, d)))


@query("style_communities")
def style_communities(spark, d):
    return clusters.communities_of_pairs(_pairs(spark, d), 5)


# ---------------------------------------------------------------- vectors
_COS = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS cosine FROM e x, e y WHERE x.id <> y.id)"""


@query("cosine_top_k", f"{_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS rank FROM p) SELECT a, CAST(rank AS INTEGER) AS rank, b, {_r('cosine')} AS cosine FROM k WHERE rank <= 10")
def cosine_top_k(spark, d):
    return rounded(vectors.neighbours(embeddings(spark, d), 10))


@query("cosine_farthest_k", f"{_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9), b) AS rank FROM p) SELECT a, CAST(rank AS INTEGER) AS rank, b, {_r('cosine')} AS cosine FROM k WHERE rank <= 10")
def cosine_farthest_k(spark, d):
    return rounded(vectors.neighbours(embeddings(spark, d), 10, nearest=False))


_MEAN = "SELECT {k} list(x ORDER BY d) AS m FROM (SELECT {k} d, avg(x) AS x FROM (SELECT {k} unnest(range(64)) AS d, unnest({v}) AS x FROM e) GROUP BY ALL) GROUP BY ALL"


@query("centre_distance", f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS ({_MEAN.format(k='', v='v')}) SELECT id, {_r('1 - list_cosine_similarity(v, m)')} AS centre_distance FROM e, c")
def centre_distance(spark, d):
    return rounded(vectors.centre_distance(embeddings(spark, d)))


@query(
    "semantic_capitals",
    f"""WITH e0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e0),
c AS ({_MEAN.format(k="label,", v="v")}), s AS (SELECT label, id, list_cosine_similarity(v, m) AS s FROM e JOIN c USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, id) AS rn FROM s)
SELECT label, id, {_r("s")} AS cosine FROM k WHERE rn = 1""",
)
def semantic_capitals(spark, d):
    return rounded(vectors.capitals(embeddings(spark, d), "label"))


@query("relationship_export", f"{_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS rank FROM p WHERE cosine > 0) SELECT a, CAST(rank AS INTEGER) AS rank, b, round(cosine, 3) + 0.0 AS similarity FROM k")
def relationship_export(spark, d):
    return records.relationships(embeddings(spark, d))


@query("knn_edges", f"{_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS rank FROM p) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM k WHERE rank <= 20")
def knn_edges(spark, d):
    return vectors.knn_edges(vectors.neighbours(embeddings(spark, d), 20), 20)


@query(
    "style_semantic_disagreement",
    f"""{_PROFILE}, emb AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS ({_MEAN.format(k="label,", v="v").replace("FROM e)", "FROM emb)")}),
b AS (SELECT a, b, round(delta, 9) AS x, round(1 - list_cosine_similarity(p.m, q.m), 9) AS y FROM dl JOIN c p ON a = 'src' || p.label JOIN c q ON b = 'src' || q.label),
r AS (SELECT a, rank() OVER (PARTITION BY a ORDER BY x) + (count(*) OVER (PARTITION BY a, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a ORDER BY y) + (count(*) OVER (PARTITION BY a, y) - 1) / 2.0 AS ry FROM b)
SELECT a AS text_id, {_r("1 - coalesce(corr(rx, ry), 0)")} AS burrows_cosine_disagreement FROM r GROUP BY 1""",
)
def style_semantic_disagreement(spark, d):
    c = vectors.centroid(embeddings(spark, d), "label").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("id"), "vector")
    y = vectors.cosine_pairs(c).select("a", "b", F.round(1 - F.col("cosine"), 9).alias("y"))
    x = _pairs(spark, d).select("a", "b", F.round("delta", 9).alias("x"))
    return rounded(style.disagreement(x.join(y, ["a", "b"])))


# ---------------------------------------------------------------- statistics
@query("metric_summary", f"SELECT count(l_extendedprice) AS n, {_r('avg(l_extendedprice)', 4)} AS mean, {_r('var_pop(l_extendedprice)', 2)} AS variance, {_r('stddev_pop(l_extendedprice)', 4)} AS std, {_r('median(l_extendedprice)', 4)} AS median FROM lineitem")
def metric_summary(spark, d):
    s = explore.summary(table(spark, d, "lineitem"), "l_extendedprice")
    return s.select("n", *((F.round(c, k) + 0.0).alias(c) for c, k in (("mean", 4), ("variance", 2), ("std", 4), ("median", 4))))


@query("pearson", f"SELECT count(*) AS n, {_r('corr(l_quantity, l_extendedprice)')} AS r, {_r('corr(l_quantity, l_extendedprice) ^ 2')} AS r2, CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem")
def pearson(spark, d):
    return rounded(explore.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("linear_fit", f"SELECT l_returnflag, {_r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {_r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, d):
    return rounded(explore.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 4)


@query(
    "quadratic_fit",
    f"""WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), p AS (SELECT m, l_quantity - m AS u, l_extendedprice AS y FROM lineitem, m),
s AS (SELECT max(m) AS m, CAST(count(*) AS DOUBLE) AS s0, sum(u) AS s1, sum(u^2) AS s2, sum(u^3) AS s3, sum(u^4) AS s4, sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2 FROM p),
k AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s),
c AS (SELECT m, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/det AS a, (s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2))/det AS b, (s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2))/det AS c FROM k)
SELECT {_r("a - b*m + c*m*m", 2)} AS a, {_r("b - 2*c*m", 3)} AS b, {_r("c", 4)} AS c FROM c""",
)
def quadratic_fit(spark, d):
    q = explore.quadratic_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return q.select((F.round("a", 2) + 0.0).alias("a"), (F.round("b", 3) + 0.0).alias("b"), (F.round("c", 4) + 0.0).alias("c"))


@query(
    "residual_rank",
    f"""WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), r AS (SELECT k, y - (i + s * x) AS e FROM p, f),
q AS (SELECT 'greatest' AS kind, row_number() OVER (ORDER BY round(abs(e), 9) DESC, k) AS rank, k, e FROM r UNION ALL SELECT 'least', row_number() OVER (ORDER BY round(abs(e), 9), k), k, e FROM r)
SELECT kind, CAST(rank AS INTEGER) AS rank, k AS o_orderkey, {_r("e", 3)} AS residual FROM q WHERE rank <= 5""",
)
def residual_rank(spark, d):
    return rounded(explore.residuals(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey"), 3)


@query("empirical_percentile", f"SELECT event_id, {_r('cume_dist() OVER (PARTITION BY event_type ORDER BY value) * 100')} AS percentile FROM events WHERE value IS NOT NULL")
def empirical_percentile(spark, d):
    return rounded(explore.percentiles(table(spark, d, "events"), "value", "event_type").select("event_id", "percentile"))


@query(
    "histogram",
    f"""WITH v AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice IS NOT NULL), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, CAST(least(60, greatest(10, ceil((max(v) - min(v)) / (3.49 * stddev_pop(v) * count(*) ^ (-1/3.0))))) AS BIGINT) AS k FROM v),
b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / k)), k - 1) AS BIGINT) AS bin, lo, (hi - lo) / k AS w, n FROM v, s)
SELECT bin, {_r("lo + bin * w", 4)} AS lo, {_r("lo + (bin + 1) * w", 4)} AS hi, count(*) AS n, round(count(*) / (n * w), 9) + 0.0 AS density FROM b GROUP BY bin, lo, w, b.n""",
)
def histogram(spark, d):
    h = explore.histogram(table(spark, d, "orders"), "o_totalprice")
    return h.select("bin", (F.round("lo", 4) + 0.0).alias("lo"), (F.round("hi", 4) + 0.0).alias("hi"), "n", (F.round("density", 9) + 0.0).alias("density"))


@query("value_ecdf", f"SELECT DISTINCT o_totalprice, {_r('cume_dist() OVER (ORDER BY o_totalprice)', 9)} AS share FROM orders")
def value_ecdf(spark, d):
    return explore.ecdf(table(spark, d, "orders"), "o_totalprice").select("o_totalprice", (F.round("share", 9) + 0.0).alias("share"))


@query("word_z_scores", f"{_PROFILE}, u AS (SELECT text_id, word, rate FROM pr), m AS (SELECT word, avg(rate) AS mu, stddev_pop(rate) AS sd FROM u GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(rate) > 0) SELECT text_id, word, {_r('(rate - mu) / sd')} AS z FROM u JOIN m USING (word)")
def word_z_scores(spark, d):
    return rounded(explore.word_z_scores(style.profiles(sources(spark, d)), "rate").select("text_id", "word", "z"))


@query("listed_sources", f"{TOK}, n AS (SELECT source, sum(len(t)) AS n FROM tok GROUP BY 1) SELECT source AS text_id, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, source) AS place FROM n WHERE lower(source) LIKE '%rc1%'")
def listed_sources(spark, d):
    n = sources(spark, d).groupBy("text_id").agg(F.sum(F.size("tokens")).cast("long").alias("n"))
    return explore.listed(n, "text_id", "n", "RC1").select("text_id", "n", "place")


@query(
    "logistic_fit",
    f"""WITH RECURSIVE m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx FROM lineitem),
p AS (SELECT (l_quantity - mx) / sx AS u, least(1 - 1e-6, greatest(1e-6, (l_extendedprice - lo) / (hi - lo))) AS t FROM lineitem, m),
r AS (SELECT 0 AS i, 0.0 :: DOUBLE AS w0, 0.0 :: DOUBLE AS w1 UNION ALL
SELECT i + 1, w0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
SELECT any_value(i) AS i, any_value(w0) AS w0, any_value(w1) AS w1, sum(t - q) AS g0, sum((t - q) * u) AS g1, sum(q * (1 - q)) + 1e-9 AS h00, sum(q * (1 - q) * u) AS h01, sum(q * (1 - q) * u * u) + 1e-9 AS h11
FROM (SELECT i, w0, w1, u, t, 1 / (1 + exp(-(w0 + w1 * u))) AS q FROM r, p WHERE i < 25) HAVING count(*) > 0))
SELECT {_r("lo")} AS low, {_r("hi")} AS high, {_r("w0 - w1 * mx / sx")} AS b0, {_r("w1 / sx")} AS b1 FROM r, m WHERE i = 25""",
)
def logistic_fit(spark, d):
    fit = explore.logistic_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(spark.createDataFrame([tuple(float(v) for v in fit.values())], ", ".join(f"{k} double" for k in fit)))


_ERF = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t"


@query("normal_cdf", f"""WITH e AS (SELECT event_id, (value - 50) / 25 AS z FROM events), q AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM e)
SELECT event_id, {_r("exp(-z * z / 2) / sqrt(2 * pi())")} AS pdf, {_r(f"(1 + sign(z) * (1 - {_ERF} * exp(-x * x))) / 2")} AS cdf FROM q""")  # fmt: skip
def normal_cdf(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("z"))
    return rounded(e.select("event_id", explore.normal_pdf(F.col("z")).alias("pdf"), explore.normal_cdf(F.col("z")).alias("cdf")))


# ---------------------------------------------------------------- limits and filters
_FILES = f"{TOK}, s AS (SELECT source, text_id AS file_id, len(t) AS n, sum(len(t)) OVER (PARTITION BY source ORDER BY text_id) AS e, sum(len(t)) OVER (PARTITION BY source) AS total FROM tok)"


def _held(df: DataFrame) -> DataFrame:
    return df.select("text_id", "file_id", F.size("tokens").cast("long").alias("n_tokens"), F.coalesce(F.element_at("tokens", 1), F.lit("")).alias("first"), F.coalesce(F.element_at("tokens", -1), F.lit("")).alias("last"))


def _held_sql(lo: str, hi: str) -> str:
    return f"""{_FILES}, k AS (SELECT s.source AS text_id, file_id, t[CAST(greatest(e - n, {lo}) - (e - n) + 1 AS BIGINT):CAST(least(e, {hi}) - (e - n) AS BIGINT)] AS t FROM s JOIN tok ON tok.text_id = file_id WHERE e > {lo} AND e - n < {hi})
SELECT text_id, file_id, CAST(len(t) AS BIGINT) AS n_tokens, coalesce(t[1], '') AS first, coalesce(t[-1], '') AS last FROM k"""


@query("first_n_tokens", _held_sql("0", "3000"))
def first_n_tokens(spark, d):
    return _held(filters.first_tokens(doc_files(spark, d), 3000))


@query("newest_n_tokens", _held_sql("total - 3000", "total"))
def newest_n_tokens(spark, d):
    return _held(filters.newest_tokens(doc_files(spark, d), 3000))


@query("newest_budget", _held_sql("total - 3000", "total"))
def newest_budget(spark, d):
    return _held(filters.newest_whole_files(doc_files(spark, d), 3000))


@query("span_overlap", f"{_FILES} SELECT source AS text_id, file_id, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM s WHERE e > 1000 AND e - n < 2000")
def span_overlap(spark, d):
    return filters.spans(doc_files(spark, d)).where("end > 1000 and start < 2000").select("text_id", "file_id", "start", "end")


@query("recent_files", "SELECT source AS text_id, doc_id AS file_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 10")
def recent_files(spark, d):
    return filters.recent_files(doc_files(spark, d), 10).select("text_id", "file_id")


@query("file_token_limit", f"{TOK} SELECT text_id AS file_id, CAST(least(len(t), 100) AS BIGINT) AS n_tokens FROM tok WHERE len(t) >= 25")
def file_token_limit(spark, d):
    return filters.file_limit(filters.least_tokens(doc_files(spark, d), 25), 100).select("file_id", F.size("tokens").cast("long").alias("n_tokens"))


@query("date_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19950101' AND '19951231'")
def date_range(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    return filters.date_range(o, "day", "19950101", "19951231").select("o_orderkey")


@query("duration_range", "SELECT event_id FROM events WHERE coalesce(value, 0) >= 20 AND coalesce(value, 1e300) <= 60")
def duration_range(spark, d):
    return filters.duration_range(table(spark, d, "events"), "value", 20, 60).select("event_id")


@query("ignore_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def ignore_anti(spark, d):
    return filters.ignore(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id").select("doc_id")


# ---------------------------------------------------------------- records
@query("dedupe_keep_first", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def dedupe_keep_first(spark, d):
    return records.keep_first(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


@query(
    "upsert_latest",
    """WITH o AS (SELECT conv_id AS id, role, turn AS stamp FROM conversations WHERE turn = 0), n AS (SELECT conv_id AS id, role, turn AS stamp FROM conversations WHERE turn = 1)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.role ELSE o.role END AS role, coalesce(o.stamp, n.stamp) AS stamp FROM o FULL JOIN n ON o.id = n.id""",
)
def upsert_latest(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role", F.col("turn").alias("stamp"))
    return records.upsert(c.where("stamp = 0"), c.where("stamp = 1"), "id", "stamp")


@query(
    "consistency_sets",
    """WITH u AS (SELECT doc_id AS id, 'a' AS s FROM labels UNION ALL SELECT doc_id, 'a' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'm' FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'f' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'x' FROM documents WHERE doc_id % 5 = 0),
g AS (SELECT id, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'm') AS m, count(*) FILTER (s = 'f') AS f, count(*) FILTER (s = 'x') AS x FROM u GROUP BY 1)
SELECT 'archive duplicate' AS issue, id FROM g WHERE a > 1 UNION ALL SELECT 'archived without metadata', id FROM g WHERE a > 0 AND m = 0 UNION ALL SELECT 'complete but not archived', id FROM g WHERE m > 0 AND f > 0 AND a = 0
UNION ALL SELECT 'metadata only', id FROM g WHERE m > 0 AND a = 0 AND x = 0 UNION ALL SELECT 'archived without alternate', id FROM g WHERE m > 0 AND a > 0 AND x = 0""",
)
def consistency_sets(spark, d):
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels")
    archive = labels.select(F.col("doc_id").alias("id")).union(labels.where("toxic = 1").select("doc_id"))
    return records.consistency(archive, docs.where("id % 3 <> 0"), docs.where("id % 2 = 0"), docs.where("id % 5 = 0"))


@query("failure_accounting", "SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_failures, count(*) FILTER (event_type NOT IN ('view', 'click')) >= 3 AS given_up FROM events GROUP BY 1")
def failure_accounting(spark, d):
    return records.failures(table(spark, d, "events"), "user_id", "event_type", passing=("view", "click"))


@query("stale_batches", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderdate DESC, o_orderdate, o_orderkey) - 1) / 25) AS BIGINT) AS batch FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY)")
def stale_batches(spark, d):
    o = table(spark, d, "orders").withColumn("stamp", F.col("o_orderdate")).withColumn("by", F.struct("o_orderdate", -F.col("o_orderkey")))
    return records.stale(o, "stamp", "by", "1998-01-01").select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("hashed_ids", "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || 'salt'), 1, 16) AS hashed FROM documents")
def hashed_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", records.hashed_id(F.col("doc_id").cast("string"), "salt").alias("hashed"))


@query("shards", "SELECT source, CAST(floor((row_number() OVER (ORDER BY source) - 1) / 8) AS BIGINT) AS shard FROM (SELECT DISTINCT source FROM documents)")
def shards(spark, d):
    return records.shards(table(spark, d, "documents").select("source").distinct(), "source", 8).select("source", F.col("shard").cast("long").alias("shard"))


# ---------------------------------------------------------------- sinks and sources
def _trim(x: str, decimals: int) -> str:
    t = f"rtrim(rtrim(printf('%.{decimals}f', {x}), '0'), '.')"
    return f"coalesce(CASE WHEN {t} IN ('-0', '') THEN '0' ELSE {t} END, '')"


_WIDE = ("n_tokens", "n_types", "TTR", "yules_k", "avg_word_length", "hapax_ratio", "dis_ratio", "word_burstiness")


@query("metrics_pivot", f"SELECT text_id, " + ", ".join(_trim(f'CAST("{c}" AS DOUBLE)', 6) + f' AS "{c}"' for c in _WIDE) + f" FROM ({TOK}{_FREQ.format(key='source', base='source')})")
def metrics_pivot(spark, d):
    return export.metrics_table(export.melt(lexical.frequency_metrics(sources(spark, d))))


@query(
    "similarity_table",
    f"""{_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS n, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9), b) AS f FROM p)
SELECT a AS text_id, 'closest' AS kind, CAST(n AS INTEGER) AS rank, b AS other, {_trim("cosine", 4)} AS score FROM k WHERE n <= 5 UNION ALL
SELECT a, 'farthest', CAST(f AS INTEGER), b, {_trim("cosine", 4)} FROM k WHERE f <= 5""",
)
def similarity_table(spark, d):
    return export.similarity_table(embeddings(spark, d), 5)


_VTT = ("WEBVTT", "Kind: captions", "", "1", "00:00:00.000 --> 00:00:02.000", "<c>Hello</c> there &amp; you [Music]", "Hello there you", "00:00:02.000 --> 00:00:04.000", "BOB: well then", "well then", "Hello there you")
_VTT_SQL = "WITH x AS (SELECT 'a' AS file_id, 'Hello there you well then Hello there you' AS content) SELECT * FROM x"


@query("vtt_clean", _VTT_SQL)
def vtt_clean(spark, d):
    return files.clean_subtitles(spark.createDataFrame([("a", i, line) for i, line in enumerate(_VTT)], "file_id string, pos int, line string"))


@query("least_total", f"{TOK}, s AS (SELECT source AS text_id, text_id AS file_id, CAST(sum(len(t)) OVER (PARTITION BY source) AS BIGINT) AS total_tokens FROM tok) SELECT *, total_tokens < 20000 AS low_token_text FROM s")
def least_total(spark, d):
    return filters.least_total(doc_files(spark, d), 20_000, embedding_only=True).select("text_id", "file_id", "total_tokens", "low_token_text")


@query("live_filter", "SELECT event_id FROM events WHERE NOT (coalesce(event_type = 'click', false) OR coalesce(value > 50, false))")
def live_filter(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "click").alias("was_live"), (F.col("value") > 50).alias("is_live"))
    return filters.exclude_live(e).select("event_id")


@query("exportable_rows", "SELECT event_id FROM events WHERE event_type = 'view' AND value * 20 >= 480 AND ts >= TIMESTAMP '2020-01-01' AND NOT value > 90")
def exportable_rows(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "Gaming").alias("category"), (F.col("value") * 20).alias("duration"), F.date_format("ts", "yyyyMMdd").alias("upload_date"),
        F.lit(False).alias("was_live"), (F.col("value") > 90).alias("is_live"),
    )
    return filters.exportable(e).select("event_id")


@query("listed_channels", "SELECT r_regionkey FROM region WHERE lower(r_name) IN ('africa', 'asia')")
def listed_channels(spark, d):
    lines = spark.createDataFrame([("processing: @africa,",), ("ASIA;",), ("Asia",), ("nowhere",), (" ",)], "line string")
    return records.channel_handles(lines, table(spark, d, "region"), name="r_name").select("r_regionkey")


# ---------------------------------------------------------------- corpus centre, contexts
@query("centre_deviation", f"{_PROFILE}, m AS (SELECT text_id, abs(rate - avg(rate) OVER (PARTITION BY word)) AS x FROM pr) SELECT text_id, {_r('avg(x)', 9)} AS centre_deviation FROM m GROUP BY 1")
def centre_deviation(spark, d):
    return rounded(style.centre_deviation(style.profiles(sources(spark, d))), 9)


@query(
    "cluster_against",
    f"""{_PROFILE}, m AS (SELECT {_CLUSTER} AS cluster, word, avg(z) AS mz, stddev_pop(z) AS sd FROM zz GROUP BY 1, 2), d AS (SELECT m.cluster, m.word, m.mz - o.mz AS mz, m.sd FROM m JOIN m o ON m.word = o.word AND o.cluster = 0 AND m.cluster <> 0)
SELECT cluster, word, {_r("mz")} AS mean_z, {_r("abs(mz) / sum(abs(mz)) OVER (PARTITION BY cluster) * 100")} AS share, CAST(sign(mz) AS INTEGER) AS sign,
{_r("CASE WHEN sd < 1e-12 AND mz = 0 THEN 0 WHEN sd < 1e-12 THEN 99 ELSE abs(mz) / sd END")} AS consistency FROM d""",
)
def cluster_against(spark, d):
    return rounded(style.cluster_decomposition(_z(spark, d), _clusters(spark, d), against=0))


@query(
    "cluster_rate_context",
    f"""{_PROFILE}, q1 AS (SELECT text_id, word, round(rate, 12) AS rate FROM pr), c1 AS (SELECT *, (rate - avg(rate) OVER w) / greatest(stddev_pop(rate) OVER w, 1e-9, avg(rate) OVER w * 1e-3) AS z,
avg(rate) OVER k AS cm, stddev_pop(rate) OVER k AS cs, min(rate) OVER k AS lo, max(rate) OVER k AS hi FROM q1 WINDOW w AS (PARTITION BY word), k AS (PARTITION BY {_CLUSTER}, word)),
n1 AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM c1)
SELECT text_id, word, {_r(f"(1 + sign(z) * (1 - {_ERF} * exp(-x * x))) / 2 * 100", 5)} AS normal_percentile, {_r("cm", 9)} AS cluster_mean, {_r("cs", 9)} AS cluster_sd, {_r("lo", 9)} AS cluster_low, {_r("hi", 9)} AS cluster_high FROM n1""",
)
def cluster_rate_context(spark, d):
    p = style.cluster_rate_context(style.profiles(sources(spark, d)).withColumn("rate", F.round("rate", 12)), _clusters(spark, d))
    return p.select("text_id", "word", (F.round("normal_percentile", 5) + 0.0).alias("normal_percentile"), *((F.round(c, 9) + 0.0).alias(c) for c in ("cluster_mean", "cluster_sd", "cluster_low", "cluster_high")))


@query(
    "named_capitals",
    f"""WITH e0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e0),
c AS ({_MEAN.format(k="label,", v="v")}), s AS (SELECT label, id, list_cosine_similarity(v, m) AS s FROM e JOIN c USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, id) AS rn FROM s)
SELECT label, id, p_name AS name FROM k LEFT JOIN part ON id = p_partkey WHERE rn = 1""",
)
def named_capitals(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return vectors.capital_names(vectors.capitals(embeddings(spark, d), "label"), names).select("label", "id", "name")


@query(
    "standardized_vectors",
    f"""WITH x AS (SELECT vec_id AS id, unnest(range(64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1)
SELECT id, CAST(d AS INTEGER) AS d, {_r("(x - m) / CASE WHEN s > 0 THEN s ELSE 1 END")} AS x FROM x JOIN m USING (d)""",
)
def standardized_vectors(spark, d):
    return rounded(clusters.standardize(embeddings(spark, d)).select("id", F.posexplode("vector").alias("d", "x")))


@query("nearest_resolution", "SELECT 1.35 :: DOUBLE AS variant, n_nationkey AS id, n_regionkey AS label FROM nation WHERE n_regionkey > 0")
def nearest_resolution(spark, d):
    n = table(spark, d, "nation").select(F.explode(F.array(F.lit(1.0), F.lit(1.2), F.lit(1.35))).alias("variant"), F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("label"))
    return export.nearest_resolution(n, 1.3)


@query(
    "recent_mean",
    f"""WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 10), x AS (SELECT label, unnest(range(64)) AS d, unnest(v) AS x FROM e)
SELECT label AS text_id, CAST(d AS INTEGER) AS d, {_r("avg(x)")} AS x FROM x GROUP BY 1, 2""",
)
def recent_mean(spark, d):
    f = table(spark, d, "embeddings").select(F.col("label").alias("text_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return rounded(vectors.recent_mean(f).select("text_id", F.posexplode("vector").alias("d", "x")))


@query(
    "bundle_shards",
    f"""{TOK}, n AS (SELECT source AS text_id, CAST(sum(len(t)) AS BIGINT) AS n_tokens, count(*) AS n_files FROM tok GROUP BY 1), s AS (SELECT *, (row_number() OVER (ORDER BY text_id) - 1) // 8 AS shard FROM n),
p AS (SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, min(text_id) AS first, CAST(to_json(list(struct_pack(text_id := text_id, n_tokens := n_tokens, n_files := n_files) ORDER BY text_id)) AS VARCHAR) AS payload FROM s GROUP BY 1)
SELECT *, sha256(payload) AS sha256 FROM p""",
)
def bundle_shards(spark, d):
    n = sources(spark, d).groupBy("text_id").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.count("*").alias("n_files"))
    return export.bundle(n, "text_id", 8).withColumn("shard", F.col("shard").cast("long"))


# ---------------------------------------------------------------- beyond SQL
@query("resolution_sweep")
def resolution_sweep(spark, d):
    return clusters.sweep(embeddings(spark, d))


@query("density_sweep")
def density_sweep(spark, d):
    return clusters.density_sweep(embeddings(spark, d))


_STEP = "CASE WHEN list_contains(a.w, b.w[1]) THEN 0 ELSE 1 END"


def _factors(t: str) -> str:
    """The state after a text: words seen since the last factor, tokens since then, factors."""
    seen = "CASE WHEN list_contains(a.w, b.w[1]) THEN a.w ELSE list_append(a.w, b.w[1]) END"
    step = f"CASE WHEN (len(a.w) + {_STEP}) / (a.n + 1) <= 0.72 THEN {{'w': [] :: VARCHAR[], 'n': 0, 'f': a.f + 1}} ELSE {{'w': {seen}, 'n': a.n + 1, 'f': a.f}} END"
    return f"list_reduce(list_transform({t}, lambda x: {{'w': [x], 'n': 0, 'f': 0.0 :: DOUBLE}}), lambda a, b: {step}, {{'w': [] :: VARCHAR[], 'n': 0, 'f': 0.0 :: DOUBLE}})"


def _length(s: str) -> str:
    f = f"{s}.f + CASE WHEN {s}.n > 0 THEN (1 - len({s}.w) / {s}.n) / (1 - 0.72) ELSE 0 END"
    return f"len(t) / CASE WHEN {f} = 0 THEN 1 ELSE {f} END"


@query("mtld", f"{TOK}, s AS (SELECT text_id, t, {_factors('t')} AS f, {_factors('list_reverse(t)')} AS g FROM tok) SELECT text_id, {_r('CASE WHEN len(t) > 0 THEN (' + _length('f') + ' + ' + _length('g') + ') / 2 ELSE 0 END')} AS \"MTLD\" FROM s")
def mtld(spark, d):
    return rounded(documents(spark, d).select("text_id", lexical.mtld("tokens").alias("MTLD")))


@query("compression")
def compression(spark, d):
    return rounded(lexical.compression(documents(spark, d)))


@query("lda_topics")
def lda_topics(spark, d):
    return clusters.topics(sources(spark, d))[0]


@query("kmeans")
def kmeans(spark, d):
    return clusters.kmeans(embeddings(spark, d))


@query("hdbscan")
def hdbscan(spark, d):
    return clusters.hdbscan(embeddings(spark, d))


@query("leiden")
def leiden(spark, d):
    return clusters.leiden(embeddings(spark, d), resolution=1.15)


@query("layout")
def layout(spark, d):
    return clusters.layout(embeddings(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each source its vocabulary richness and the source nearest to it in style."""
    rich = lexical.frequency_metrics(sources(spark, d)).select("text_id", "TTR", "hapax_ratio")
    near = vectors.top_k(_pairs(spark, d), 1, "delta", nearest=False).select(F.col("a").alias("text_id"), F.col("b").alias("nearest"), "delta")
    return rounded(rich.join(near, "text_id"))

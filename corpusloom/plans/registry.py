"""Metric registry: names to column builders over tokens, planned as one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wordlists as W
from ..operators import lexical

#: A builder takes the tokens and the joined text.
Builder = Callable[[Column, Column], Column]


#: Metrics that read a text many times, and those that need its sentences.
SLOW = {"MATTR", "MTLD", "compression", "ngram_entropy_2", "ngram_entropy_3", "discussion_commentary_count", "elaboration_explanation_ratio"}
SENTENCES = {"readability", "average_sentence_length"}


class Patterns:
    """A builder that counts patterns, so that ``measure`` can look for those of all metrics in one pass; ``finish`` makes the metric of the tokens and the count."""

    def __init__(self, patterns: list[str], finish: Callable[[Column, Column], Column] | None = None):
        self.patterns, self.finish = list(patterns), finish

    def __call__(self, t: Column, j: Column, found: Column | None = None, letters: Column | None = None) -> Column:
        n = T.pattern_count(j, self.patterns, found, letters)
        return self.finish(t, n) if self.finish else n


def _sets() -> dict[str, list[str]]:
    conj = {f"conjunction_{w}_count": [w] for w in sorted({*W.COORDINATORS, *W.SUBORDINATORS})}
    who = {f"{k}_count": v.split() for k, v in W.INTERROGATIVES.items()}
    pro = {f"pronoun_{k}_count": v.split() for k, v in W.PRONOUNS.items()}
    aux = {f"auxiliary_{k}_count": v.split() for k, v in W.AUXILIARIES.items()}
    every = lambda d: sorted({w for v in d.values() for w in v})
    return {
        **who, **conj, **pro, **aux, "conjunction_total_count": every(conj), "pronoun_total_count": every(pro), "auxiliary_total_count": every(aux),
        "pronoun_third_person_count": every({k: pro[f"pronoun_{k}_count"] for k in ("he", "she", "they")}),
        "self_mention_count": W.FIRST_PERSON, "subordinate_clause_count": W.SUBORDINATORS, "coordinate_clause_count": W.COORDINATORS, "quantifier_count": W.QUANTIFIERS,
    }


def base_registry() -> dict[str, Builder]:
    out: dict[str, Builder] = {}
    for name, words in _sets().items():
        out[name] = lambda t, j, words=words: T.set_count(t, words)
    for name, patterns in W.PATTERNS.items():
        if name.endswith("_count") or name in ("family_exclamations", "vulnerability"):
            out[name] = Patterns(patterns)
    for colour, ends in W.COLOUR_ENDINGS.items():
        out[f"color_{colour}_count"] = Patterns([rf"\b{colour}(?:{ends})?\b"])
    out["color_count"] = Patterns([rf"\b{c}\b" for c in (*W.COLOURS, *W.COLOUR_PHRASES)])
    for name in ("deictic_spatial_temporal", "elaboration_explanation_ratio", "narration_continuation_ratio"):
        least = 10 if name == "deictic_spatial_temporal" else 1
        out[name] = Patterns(W.PATTERNS[name], lambda t, n, least=least: F.when(F.size(t) >= least, n / F.size(t) * 1000).otherwise(0.0))
    out |= {
        "article_count": lambda t, j: T.article_count(j),
        "article_count_raw": lambda t, j: T.article_count(j, raw=True),
        "pronoun_article_ratio": lambda t, j: T.pattern_count(j, W.PATTERNS["pronoun_deictic"]) / (T.article_count(j) + 1),
        "imperative_exclamation_count": Patterns(W.PATTERNS["exclamation_interjection"]),
        "byte_count": lambda t, j: F.octet_length(j).cast("long"),
        "latinate_word_ratio": lambda t, j: lexical.latinate(t),
        "possessive_count": lambda t, j: lexical.possessives(t),
        "gerund_count": lambda t, j: lexical.gerunds(t),
        "unique_words_count": lambda t, j: lexical.unique_words(t),
    }
    return out


def gaming_patterns() -> dict[str, list[str]]:
    """Pattern lists of the niche counts: by rule (a stem with any ending, a word, a phrase), or listed."""
    # Metrics named after the stem that they count, the word, and the phrase.
    stems = (
        "volcano freak handsome easy bridge engineer subscribe chill editor tea blitz pasta bagel reckon sweat rat damage murder dude cheeky spanner wrench "
        "crazy sure sneaky dnf checkpoint mate bloody outrageous embarrass stop wait yoink lame upgrade sorry hello put bot lesbian moon max foreign heat booger probably"
    ).split()
    words = "unbelievably dang damn darn man ready you i go god goodness wa yonder also technically bro rubbish too brought took well the".split()
    phrases = (
        "you_guys going_to over_to i_can you_know_what there_we_go here_we_go look_at_that oh_no give_me hate_you love_you i_think i_feel i_swear i_can well_done hang_on hold_on hold_up "
        "to_be_fair to_be_honest real_quick what_do_you_mean son_of_a are_you_kidding nailed_it thanks_for_watching go_ahead make_sure makes_me good_question see_you_next_time "
        "hear_me_out whole_bunch take_care all_right"
    ).split()
    table = {f"{s}_count": [rf"\b{s}\w*\b"] for s in stems} | {f"{w}_count": [rf"\b{w}\b"] for w in words}
    return table | {f"{p}_count": [r"\b" + p.replace("_", r"\s+") + r"\b"] for p in phrases} | W.GAMING_LISTS


def gaming_registry(patterns: dict[str, list[str]] | None = None, terms: dict[str, list[str]] | None = None) -> dict[str, Builder]:
    """Niche counts: by rule (a stem counts with any ending, a phrase as its words, a letter as itself) or by list.

    ``patterns`` adds or replaces whole pattern lists by metric name; ``terms`` gives the tables of metrics that count
    tokens of a large vocabulary (``minecraft_lexicon_density``, ``vehicle_lexicon_density``; 0 where none is given).
    """
    table = gaming_patterns() | (patterns or {})
    out: dict[str, Builder] = {name: Patterns(p) for name, p in table.items()}
    out["peak_comedy_count"] = Patterns([*W.INSULTS, *W.GAMING_LISTS["bodily_humor"]])
    for name, words in ({"minecraft_lexicon_density": [], "vehicle_lexicon_density": []} | (terms or {})).items():
        out[name] = lambda t, j, words=words: T.set_count(t, words).cast("double") if words else F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyzñ":
        out[f"letter_{c}_count"] = lambda t, j, c=c: T.letter_count(j, c)
    return out


def educational_registry() -> dict[str, Builder]:
    """Phrase groups; the lexicon metrics are a join (``lexicon_counts``)."""
    as_pattern = lambda p: r"\b" + p.replace(" ", r"\s+") + r"\b"
    return {f"{g}_count": Patterns(map(as_pattern, ps)) for g, ps in W.EDUCATIONAL_PHRASES.items()}


def lexicon_counts(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows text_id, field, n, for a lexicon of (field, term). Only letters make words, so terms with digits or spaces never match.

    Words are counted per text before the join; the lexicon is broadcast by Spark while it is small.
    """
    w = texts.select("text_id", F.explode(F.regexp_extract_all(F.lower(T.joined(F.col("tokens"))), F.lit("[a-zA-ZÀ-ÿ]+"), F.lit(0))).alias("term"))
    c = w.groupBy("text_id", "term").agg(F.count("*").alias("c"))
    return c.join(lexicon.select("field", F.lower("term").alias("term")).distinct(), "term").groupBy("text_id", "field").agg(F.sum("c").alias("n"))


def domain_breadth(counts: DataFrame) -> DataFrame:
    """Fields with a hit: text_id, academic_domain_breadth."""
    return counts.where("n > 0").groupBy("text_id").agg(F.count_distinct("field").alias("academic_domain_breadth"))


def overview_lexicon(lexicon: DataFrame) -> DataFrame:
    """The lexicon with the overview groups as fields of their own: unions, so each word counts once."""
    out = lexicon.select("field", "term")
    for name, fields in W.OVERVIEWS.items():
        out = out.union(lexicon.where(F.col("field").isin(fields)).select(F.lit(name), "term"))
    return out.distinct()


def selected(registry: dict[str, Builder], *, metrics: bool = True, counts_only: bool = False, fast: bool = False, external: bool = False) -> list[str]:
    """Names that a run's flags leave: none without ``metrics``; counts alone; without the slow ones; sentence metrics with external documents alone."""
    if not metrics:
        return []
    names = [n for n in registry if n.endswith("_count") or not counts_only]
    names = [n for n in names if not (fast and n in SLOW)]
    return [n for n in names if external or n not in SENTENCES]


def measure(texts: DataFrame, names: list[str] | None = None, registry: dict[str, Builder] | None = None, source: str | None = "text") -> DataFrame:
    """Metrics of ``names`` (all by default) for rows with text_id and tokens or ``source``: one projection, no shuffle.

    Metrics not asked for are never planned.
    """
    registry = registry or base_registry()
    unknown = set(names or ()) - registry.keys()
    if unknown:
        raise KeyError(f"no such metric: {', '.join(sorted(unknown))}")
    if "tokens" not in texts.columns:
        texts = texts.withColumn("tokens", T.tokens(F.col(source)))
    joined, wanted = T.joined(F.col("tokens")), list(names or registry)
    patterns = list(dict.fromkeys(p for n in wanted if isinstance(registry[n], Patterns) for p in registry[n].patterns))
    base = texts.select("text_id", "tokens", joined.alias("joined"))
    found = T.hits(F.col("joined"), patterns)
    if patterns:
        base = base.select("*", T.folded(F.col("joined")).alias("letters"), *(() if found is None else (found.alias("found"),)))
    more = [None if found is None else F.col("found"), F.col("letters")]
    return base.select("text_id", *(registry[n](F.col("tokens"), F.col("joined"), *(more if isinstance(registry[n], Patterns) else ())).alias(n) for n in wanted))

"""Column functions over texts: tokens, joined text, pattern counts, sentences, chunks. All run in the JVM."""

from __future__ import annotations

import functools
import re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordlists import CONTRACTIONS

#: Letters, digits and underscore; an apostrophe only between them.
TOKEN = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*"
#: A pattern that is one word of plain letters.
_PLAIN = re.compile(r"\\b[A-Za-z]+\\b")
WORD = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; a null text has none. Extract first, then lower: some letters grow."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def substitute(toks: Column, words: dict[str, str]) -> Column:
    """Replaces whole tokens, before anything is counted."""
    out = lambda t: F.coalesce(_mapped(t, words), t)
    return F.transform(toks, out)


def _mapped(t: Column, words: dict[str, str]) -> Column:
    made = F.when(F.lit(False), F.lit(""))
    for k, v in words.items():
        made = made.when(t == k, v)
    return made


def joined(toks: Column) -> Column:
    return F.array_join(toks, " ")


def pieces(toks: Column) -> Column:
    """Words inside tokens: an apostrophe parts them."""
    return F.filter(F.flatten(F.transform(toks, lambda t: F.split(t, "'"))), lambda p: p != "")


#: Patterns that begin at a word and hold only letters: a word or phrase, one ending of several or none, or a stem with any ending.
_FORMS = re.compile(r"\\b([a-z]+(?:(?: |\\s\+)[a-z]+)*)(?:(\\w\*)|([a-z])\?|\(\?:([a-z|]+)\)\?)?\\b")


def forms(pattern: str) -> tuple[list[str], bool] | None:
    """The words and phrases that a pattern matches, and whether they are a stem; None for other patterns."""
    m = _FORMS.fullmatch(pattern)
    if m is None:
        return None
    base, stem, letter, ends = re.sub(r" |\\s\+", " ", m[1]), bool(m[2]), m[3], m[4]
    if letter:
        return [base, base + letter], False
    if stem and " " in base:
        return None
    return ([base, *(base + e for e in dict.fromkeys(ends.split("|")))] if ends else [base]), stem


def needed(pattern: str) -> list[str] | None:
    """Letters that every match holds, one of the list at least; None if there are none."""

    def of(seq) -> list[str] | None:
        found, run = [], ""
        for op, x in [*seq, (None, None)]:
            if op is _parser.LITERAL and "a" <= chr(x) <= "z":
                run += chr(x)
                continue
            if run:
                found.append([run])
                run = ""
            if op is _parser.SUBPATTERN:
                found.append(of(x[-1]))
            elif op is _parser.BRANCH:
                each = [of(b) for b in x[1]]
                found.append(None if None in each else sorted({w for e in each for w in e}))
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and x[0] > 0:
                found.append(of(x[2]))
        found = [f for f in found if f]
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)

    return of(_parser.parse(pattern))


#: Letters beyond ASCII that match s and i when case is ignored, and stay when a text is lower-cased.
_FOLDED = ("ſı", "si")


def folded(joined_text: Column) -> Column:
    return F.translate(F.lower(joined_text), *_FOLDED)


def hits(joined_text: Column, patterns: list[str]) -> Column | None:
    """In one pass over a text: at each word where one of the patterns with ``forms`` matches, the longest match, and a space. For ``pattern_count``."""
    known = [f for f in map(forms, patterns) if f]
    if not known:
        return None
    starts: dict[str, set[tuple[int, str]]] = {}
    for words, stem in known:
        for w in words:
            starts.setdefault(w[0], set()).add((-w.count(" "), w[1:].replace(" ", r"\s+") + (r"\w*" if stem else "")))
    every = "|".join(f"{c}(?:{'|'.join(r for _, r in sorted(rest))})" for c, rest in sorted(starts.items()))
    found = F.regexp_extract_all(joined_text, F.lit(rf"(?iU)\b(?=((?:{every})\b))"), F.lit(1))
    return F.transform(found, lambda h: F.concat(F.translate(F.lower(h), *_FOLDED), F.lit(" ")))


def pattern_count(joined_text: Column, patterns: list[str], found: Column | None = None, letters: Column | None = None) -> Column:
    """Sum over the patterns of their matches that do not overlap, ignoring case, with Unicode word classes.

    Plain words are looked up among the text's words, all in one pass; only other patterns scan the text each. With ``found`` (``hits`` of these
    patterns or more), words, stems and phrases are counted there; with ``letters`` (``folded``), a text that lacks what a pattern needs is not scanned.
    """
    out = F.lit(0).cast("long")
    if found is not None:
        known = {p: f for p in patterns if (f := forms(p)) is not None and not any(_overlaps(w) for w in f[0])}
        single = [w for words, stem in map(known.get, [p for p in patterns if p in known]) if not stem and " " not in words[0] for w in words]
        single = single if len(set(single)) == len(single) else []
        if single:
            out = F.size(F.filter(found, lambda h: F.substring_index(h, " ", 1).isin(single))).cast("long")
        for p in [p for p in patterns if p in known]:
            words, stem = known[p]
            if stem or " " in words[0] or not single:
                out = out + _begin(found, [w if stem else w + " " for w in words])
        patterns = [p for p in patterns if p not in known]
    plain = [p for p in patterns if _PLAIN.fullmatch(p)]
    if len(plain) > 2 and len(set(map(str.lower, plain))) == len(plain):
        patterns = [p for p in patterns if p not in plain]
        out = F.size(F.filter(F.split(joined_text, "[ ']"), lambda w: w.isin([p[2:-2].lower() for p in plain]))).cast("long")
    for p in patterns:
        one = F.regexp_count(joined_text, F.lit(f"(?iU){p}")).cast("long")
        need = needed(p) if letters is not None else None
        out = out + (one if not need else F.when(_any(F.contains(letters, F.lit(w)) for w in need), one).otherwise(F.lit(0).cast("long")))
    return out


def _overlaps(phrase: str) -> bool:
    """Whether two matches of a phrase can share words."""
    w = phrase.split(" ")
    return any(w[k:] == w[:-k] for k in range(1, len(w)))


def _begin(found: Column, starts: list[str]) -> Column:
    return F.size(F.filter(found, lambda h: _any(F.startswith(h, F.lit(x)) for x in starts))).cast("long")


def _any(conditions) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def set_count(toks: Column, words: list[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(list(words)))).cast("long")


def letter_count(joined_text: Column, letter: str) -> Column:
    return ((F.length(joined_text) - F.length(F.replace(joined_text, F.lit(letter), F.lit("")))) / len(letter)).cast("long")


def article_count(joined_text: Column, *, raw: bool = False) -> Column:
    """Runs of articles count once; unless ``raw``, "what the" counts for none."""
    t = joined_text if raw else F.regexp_replace(joined_text, r"(?iU)\bwhat\s+the\b", "__WHAT_THE__")
    t = F.regexp_replace(t, r"(?iU)\b(the|a|an)\b(?:\s+(?:the|a|an)\b)+", "$1")
    return pattern_count(t, [r"\bthe\b", r"\ba\b", r"\ban\b"])


def expand(toks: Column) -> Column:
    """Contractions as words, for style profiles."""
    return F.flatten(F.transform(toks, lambda t: F.split(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONTRACTIONS.items() for x in kv)), t), t), " ")))


def sentences(text: Column) -> Column:
    """Word lists of the sentences that are not blank."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]+(?:\s+|$)"), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")
    return F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))


def syllables(word: Column) -> Column:
    """Vowel groups; a final e does not count unless alone; at least 1 where there are letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0)))


def trimmed(value: Column, decimals: int = 4) -> Column:
    """Fixed decimals without trailing zeros; minus zero is 0."""
    s = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(s.isin("-0", ""), "0").otherwise(s)


def seconds(literal: Column) -> Column:
    """HH:MM:SS, MM:SS or SS to seconds; empty is 0."""
    parts = F.reverse(F.split(F.coalesce(literal, F.lit("")), ":"))
    weigh = F.transform(parts, lambda p, i: F.coalesce(p.try_cast("double"), F.lit(0.0)) * F.pow(F.lit(60.0), i))
    return F.aggregate(weigh, F.lit(0.0), lambda a, x: a + x)


def chunks(toks: Column, size: int) -> Column:
    """Runs of ``size`` tokens as texts; the last may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(toks, i, size), " ")), lambda c: c != "")


def long_form(df: DataFrame, key: str = "text_id", toks: str = "tokens") -> DataFrame:
    """Rows key, pos (from 0), token."""
    return df.select(key, F.posexplode(toks).alias("pos", "token"))

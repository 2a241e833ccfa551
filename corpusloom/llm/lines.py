"""Line dedup: an exact set-similarity join with DataFrame functions alone.

A line is its set of distinct word shingles (lower-cased words; a line of fewer words is one
shingle). Lines of the words of an earlier line go first; what is left has one line for each
sequence of words. Shingles are ordered by the first letter of their first word (``FIRST``, then
``SECOND``, then others), then by hash, so that most lines give the head of their order to one
pattern, without their other shingles being built; a line that has too few of them is cut whole.
Two sets that match share the ``SHARE`` least of their common shingles within the first
``n - ceil(t n) + SHARE`` of each (prefix filter; all of a smaller set). A line that shares fewer
with all others goes before any pair is made. Pairs are cut by what is known of both: matching
sets differ by at most ``(1 - t) / (1 + t)`` of their sizes' sum. The rest is verified by its
Jaccard similarity, on whole sets.

A line goes if an earlier line (by document id, hash of its text, then line) matches it; earlier
lines are those of the input, whether they stay or not. First each line is paired with the first
line of each of its shingles (its *pivot*), and lines that share a shingle of at most ``SMALL``
lines with one another. What is then unmatched and shares enough shingles of larger groups is
joined again, by all its shingles, with their exact counts as rarity. There, too, a group of more
than ``SMALL`` is not paired within itself: its lines are compared with its first line and then
joined by what sets them apart from it (``_apart``), so that a group of near copies costs by its
lines and not by their square.

Defined results: lines without words stay; null texts stay null, empty ones empty; an empty table
gives an empty one. Ids may be of any type that has an order (whole numbers by value, others as
text); rows without an id come last. Rows of equal id and text count as one, rows of equal id and
different texts do not. Equal similarity and repeated lines need no tie rule: any earlier match
removes. A table's other columns, whatever their names, are unchanged. Lines are told apart by
128 bits of hash; shingles are compared by 64 bits within one pair of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import drop_stored, stored

SHINGLE = 5
#: Sets match when DEN * intersection >= NUM * union.
NUM, DEN = 8, 10
#: Tokens that two matching sets share in their prefixes at least, if they have so many; two bits hold it.
SHARE = 3
#: Sets of a token that are all paired.
SMALL = 8
#: Times that lines far from the first of their group are given another first.
ROUNDS = 8
#: First letters that lead the order of shingles, and the places of a line from which they alone are tried first.
FIRST, SECOND = (("a", "f"), 40), (("a", "o"), 8)
#: Lines that a side may name for it to be broadcast (about 40 bytes each).
FEW = 1_000_000
#: Stand for a missing id: whole numbers, and texts.
LAST, LAST_TEXT = (1 << 63) - 1, chr(0x10FFFF)
_BLANKS = "\t\x0B\f\r"
#: Bits of a shingle's hash in the order, below its letter's rank.
HASH = 61


def _plain(text: Column) -> Column:
    """Lower case, one blank between words; lines may still begin and end with one."""
    odd = F.contains(text, F.lit("  "))
    for c in _BLANKS:
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.regexp_replace(text, f"[ {_BLANKS}]+", " ")).otherwise(text))


def _row(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What names a row: its id and a hash of its text."""
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    doc = F.coalesce(df[id_col].cast("long"), F.lit(LAST)) if whole else F.coalesce(df[id_col].cast("string"), F.lit(LAST_TEXT))
    return [doc.alias("doc"), F.xxhash64(df[text_col]).alias("h")]


def _barrier(df: DataFrame, *columns: Column) -> DataFrame:
    """Columns computed once and kept: projections above would copy an expression into each place that names it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _found(line: Column, letters: tuple[str, str] | None = None) -> Column:
    """Shingles of a plain line of ``SHINGLE`` words or more, one for each place, or those whose first word begins with these letters."""
    skip, first = (rf"(?:[^{letters[0]}-{letters[1]} ][^ ]* )*+", rf"[{letters[0]}-{letters[1]}][^ ]*") if letters else ("", "[^ ]+")
    return F.regexp_extract_all(line, F.lit(rf"\G{skip}(?=({first}{' [^ ]+' * (SHINGLE - 1)}))[^ ]+ "), F.lit(1))


def _tokens(found: Column) -> Column:
    """Shingles as numbers in the order: by the rank of their first letter, then by hash."""

    def one(s: Column) -> Column:
        rank = F.when((s >= FIRST[0][0]) & (s < chr(ord(FIRST[0][1]) + 1)), F.lit(0)).when((s >= SECOND[0][0]) & (s < chr(ord(SECOND[0][1]) + 1)), F.lit(1 << HASH)).otherwise(F.lit(2 << HASH))
        return F.shiftrightunsigned(F.xxhash64(s), 64 - HASH).bitwiseOR(rank.cast("long"))

    return F.array_distinct(F.transform(found, one))


def _prefixes(lines: DataFrame) -> DataFrame:
    """Rows sid, doc, h, number, m (places), end, known (tokens up to ``end``, in order) of plain lines ``raw`` of ``SHINGLE`` words or more."""
    name = [F.col(c) for c in ("doc", "h", "number", "raw", "m", "k")]
    places = F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit(" "), F.lit(""))) - (SHINGLE - 2)
    one = _barrier(lines, *name[:4], places.alias("m")).where("m > 0").withColumn("k", _reach(F.col("m")) - 1 + SHARE)
    # distinct shingles are m at most, so k are enough; all shingles of lower rank are known if k of them are found
    enough = lambda a: F.size(a) >= F.col("k")
    one = _barrier(one, *name, F.when(F.col("m") >= FIRST[1], _tokens(_found(F.col("raw"), FIRST[0]))).alias("a"))
    second = F.when(~F.coalesce(enough("a"), F.lit(False)) & (F.col("m") >= SECOND[1]), _tokens(_found(F.col("raw"), SECOND[0])))
    one = _barrier(one, *name, F.col("a"), second.alias("b"))
    end = F.when(enough("a"), F.lit((1 << HASH) - 1)).when(enough("b"), F.lit((2 << HASH) - 1)).otherwise(F.lit(LAST))
    known = F.when(enough("a"), F.col("a")).when(enough("b"), F.col("b")).otherwise(_tokens(_found(F.col("raw"))))
    one = _barrier(one, *name[:3], F.col("m"), end.alias("end"), F.sort_array(known).alias("known"))
    sid = F.shiftleft(F.monotonically_increasing_id(), 2).bitwiseOR(F.least(F.size("known"), F.lit(SHARE)).cast("long"))
    return one.select(sid.alias("sid"), "doc", "h", "number", "m", "end", "known")


def _reach(n: Column) -> Column:
    """Shingles of a set of n of which any that matches must hold one."""
    return n - F.ceil(n * NUM / DEN).cast("int") + 1


def _few(df: DataFrame, column: str) -> bool:
    return (df.agg(F.sum(F.size(column))).first()[0] or 0) <= FEW


def _sized() -> Column:
    return (F.col("n") * DEN >= F.col("a_n") * NUM) & (F.col("a_n") * DEN >= F.col("n") * NUM)


def _candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs sid, a_sid that share a token and pass the length and positional filters."""
    a = earlier.select("token", *(F.col(c).alias(f"a_{c}") for c in ("sid", "n", "pos")))
    both = later.join(a, "token").where("sid <> a_sid").where(_sized())
    left = F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos"))
    return both.where(left * (NUM + DEN) >= (F.col("n") + F.col("a_n")) * NUM).select("sid", "a_sid")


def _live(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` with ``live``: its set is not among those that go already."""
    return df.join(gone.distinct().withColumn("was", F.lit(True)), "sid", "left").withColumn("live", F.col("was").isNull()).drop("was")


def _deltas(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows sid, q, n, q_n, head, live, m, match, far, d of pairs (sid, q): d holds the m tokens in which a set and that of q differ.

    d is null where the set holds less than half of q's, so that it is never much larger than the
    set. ``far`` holds for those, and for sets that may match one of them: matching sets a, b have
    ``|q - b| <= |q - a| + |a - b|``, so both have a d or both are far.
    """
    y = sets.select(F.col("sid").alias("q"), F.col("n").alias("q_n"), F.col("set").alias("q_set"))
    both = pairs.join(sets, "sid").join(y, "q")
    name = [F.col(c) for c in ("sid", "q", "n", "q_n", "head", "live")]
    one = _barrier(both, *name, F.array_except("set", "q_set").alias("own"), F.array_except("q_set", "set").alias("lack"))
    m = F.size("own") + F.size("lack")
    match = m * (DEN + NUM) <= (F.col("n") + F.col("q_n")) * (DEN - NUM)
    far = F.size("lack") * 2 > F.col("q_n") - _most(F.col("n")) * 2
    return one.select(*name, m.alias("m"), match.alias("match"), far.alias("far"), F.when(F.size("lack") * 2 <= F.col("q_n"), F.concat("own", "lack")).alias("d"))


def _most(n: Column) -> Column:
    """Tokens in which a set of n and one that matches it differ, at most."""
    return F.floor(n * (DEN - NUM) / NUM).cast("int")


def _apart(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs sid, a_sid that may match by their deltas from one q, the later of them live; and the table that they are read from.

    With a and b the deltas, sets differ in ``|a| + |b| - 2 |a & b|`` tokens. A live set does not
    match q, which is earlier, so matching sets share tokens of their deltas; the smaller delta
    lacks at most half of the tokens in which the sets differ, the larger all of them, and one
    that is not live less than half of its own (prefix filter on deltas, rarest tokens first).
    """
    name, both = ["sid", "q", "n", "q_n", "m", "head", "live"], DEN + NUM
    each = deltas.where("d is not null").select(*name, F.explode("d").alias("token"))
    token = Window.partitionBy("q", "token")
    common = each.withColumn("c", F.count("*").over(token)).withColumn("any", F.max("live").over(token)).where("c > 1 and any")
    own = common.groupBy(*name).agg(F.array_sort(F.collect_set(F.struct("c", "token"))).alias("own"))  # bounded by a line and q
    alone, m, most = F.col("m") - F.size("own"), F.col("m"), _most(F.col("n"))
    least = F.ceil((m * both + (F.col("q_n") - F.col("n")) * (DEN - NUM) + 1) / (2 * both)).cast("int")  # shared with a live set
    reach = lambda k: F.when(F.col("live"), k + 1).otherwise(F.least(k, m - least) + 1)
    own = own.withColumn("alone", alone).withColumn("probe", reach(most)).withColumn("index", reach(F.floor(most / 2).cast("int")))
    own = own.where("probe > alone").select(*name, "alone", "index", F.posexplode(F.slice("own", F.lit(1), F.col("probe") - F.col("alone"))).alias("at", "x"))
    posts = stored(own.select(*name, (F.col("alone") + F.col("at")).alias("pos"), "index", "x.token"), "posts")
    a = posts.where("pos < index").select("q", "token", *(F.col(c).alias(f"a_{c}") for c in ("sid", "n", "m", "head", "live", "pos")))
    pairs = posts.join(a, ["q", "token"]).where((F.col("m") > F.col("a_m")) | (F.col("m") == F.col("a_m")) & (F.col("sid") > F.col("a_sid"))).where(_sized())
    pairs = pairs.where(F.when(F.col("a_head") < F.col("head"), F.col("live")).otherwise(F.col("a_live")))
    left = F.least(m - F.col("pos"), F.col("a_m") - F.col("a_pos"))
    return pairs.where(left * (2 * both) >= (m + F.col("a_m")) * both - (F.col("n") + F.col("a_n")) * (DEN - NUM)).select("sid", "a_sid"), posts


def _settled(short: DataFrame, sets: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` and the later sets that match another by the tokens of their prefixes (rows sid, n, head, pos, token)."""
    found, tables, rest, most = [], [], short, short.count() * SMALL
    for turn in range(1, ROUNDS + 1):
        rest = _live(rest, gone)
        group = rest.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("head", "sid"))["sid"].alias("q"), F.max("live").alias("any"))
        dealt = stored(rest.join(group.where("c > 1 and any").drop("any"), "token"), "dealt")
        large = dealt.where(F.col("c") > SMALL)
        deltas = stored(_deltas(large.where("sid <> q").select("sid", "q", "live").distinct(), sets), "deltas")
        gone = gone.union(deltas.where("live and match").select("sid"))
        pairs, posts = _apart(_live(deltas.drop("live"), gone))
        small = dealt.where(F.col("c") <= SMALL)
        found += [pairs, _candidates(small.join(gone, "sid", "left_anti"), small)]
        tables += [dealt, deltas, posts]
        rest = large.join(deltas.where("far").select("sid", "q"), ["sid", "q"], "left_semi").select("sid", "n", "head", "pos", "token")
        square = rest.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
        if square <= most or turn == ROUNDS:  # no more than ``SMALL`` for each row of ``short``, or lines that no first line is near to
            if square:
                found.append(_candidates(rest.join(gone, "sid", "left_anti"), rest))
            break
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    last = _matched(stored(pairs.distinct(), "pairs"), sets)
    out = stored(gone.union(last).distinct(), "gone")
    for t in (*tables, last):
        drop_stored(t)
    return out


def _alike(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of these pairs whose known tokens, as far as both are known, differ by no more than matching sets may."""
    x = lines.select("sid", "m", "end", "known")
    y = x.select(*(F.col(c).alias(f"a_{c}") for c in x.columns))
    both = found.join(x, "sid").join(y, "a_sid").select("sid", "a_sid", (F.col("m") + F.col("a_m")).alias("m"), "end", "a_end", "known", "a_known")
    cut = lambda c, own, other: F.when(F.col(own) > F.col(other), F.size(F.filter(c, lambda t: t <= F.col(other)))).otherwise(F.size(c))
    apart = cut("known", "end", "a_end") + cut("a_known", "a_end", "end") - F.size(F.array_intersect("known", "a_known")) * 2
    out = stored(both.where(apart * (DEN + NUM) <= F.col("m") * (DEN - NUM)).select("sid", "a_sid"), "alike")
    drop_stored(found)
    return out


def _matched(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The later sets of those of these pairs that match."""
    sets = sets.select("sid", "head", "set")
    y = sets.select(F.col("sid").alias("a_sid"), F.col("head").alias("a_head"), F.col("set").alias("a_set"))
    both = found.join(sets, "sid").join(y, "a_sid").where((F.size("set") * DEN >= F.size("a_set") * NUM) & (F.size("a_set") * DEN >= F.size("set") * NUM))
    both = both.withColumn("i", F.size(F.array_intersect("set", "a_set")))
    both = both.where(F.col("i") * DEN >= (F.size("set") + F.size("a_set") - F.col("i")) * NUM)
    out = stored(both.select(F.when(F.col("a_head") < F.col("head"), F.col("sid")).otherwise(F.col("a_sid")).alias("sid")).distinct(), "matched")
    drop_stored(found)
    return out


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows doc, h, numbers: lines whose words are those of an earlier one; and ``docs`` with equal rows once."""
    place, key = F.struct("doc", "h", "number"), ["k1", "k2"]
    lines = docs.select("doc", "h", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("number", "raw")).withColumn("raw", F.btrim("raw"))
    lines = stored(lines.select("doc", "h", "number", (F.col("raw") != "").alias("some"), F.xxhash64("raw").alias("k1"), F.xxhash64(F.lit(SHINGLE), "raw").alias("k2")), "lines")
    many = lines.where("some").groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key)
    twice = stored(lines.where("some").join(many.hint("shuffle_hash"), key), "twice")
    heads = twice.groupBy(key).agg(F.min(place).alias("head"))
    again = twice.join(heads, key).where(place > F.col("head"))
    again = stored(again.groupBy("doc", "h").agg(F.collect_set("number").alias("numbers")), "again")  # bounded by a document's lines
    rows = stored(lines.where("number = 0").groupBy("doc", "h").agg(F.count("*").alias("c")).where("c > 1").select("doc", "h"), "rows")
    drop_stored(lines)
    drop_stored(twice)
    if rows.isEmpty():
        return again, docs
    return again, docs.join(rows, ["doc", "h"], "left_anti").unionByName(docs.join(rows, ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"]))


def later_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc, h (what names a row), numbers (sorted array): the lines that go. A stored table."""
    docs = df.select(*_row(df, id_col, text_col), F.col(text_col).alias("text")).where("text is not null")
    again, docs = _copies(docs)
    side = F.broadcast(again) if _few(again, "numbers") else again
    one = docs.join(side, ["doc", "h"], "left")
    one = _barrier(one, F.col("doc"), F.col("h"), F.split(_plain(F.col("text")), "\n").alias("all"), F.col("numbers"))
    every = F.sequence(F.lit(0), F.size("all") - 1)
    one = _barrier(one, F.col("doc"), F.col("h"), F.col("all"), F.when(F.col("numbers").isNull(), every).otherwise(F.array_except(every, "numbers")).alias("kept"))
    rows = F.transform("kept", lambda i: F.struct(i.alias("number"), F.btrim(F.get("all", i)).alias("raw")))
    heads = stored(_prefixes(one.select("doc", "h", F.inline(rows))), "heads")  # the ids are fixed by the write

    # a set with a match shares SHARE tokens of its prefix with it; the others go before any pair is made
    token, line = Window.partitionBy("token"), Window.partitionBy("sid")
    posts = heads.select("sid", F.explode(F.slice("known", F.lit(1), _reach(F.col("m")) - 1 + SHARE)).alias("token"))
    shared = stored(posts.withColumn("c", F.count("*").over(token)).where("c > 1").select("sid", "token"), "shared")
    live = shared.withColumn("c", F.count("*").over(line)).where(F.col("c") >= F.col("sid").bitwiseAND(3)).select("sid", "token")
    live = stored(live, "live")
    drop_stored(shared)
    light = heads.select("sid", F.struct("doc", "h", "number").alias("head"), "m", "end", "known").join(live.select("sid").distinct(), "sid")
    light = stored(light, "places")
    drop_stored(heads)
    heads = light
    pivoted = live.withColumn("c", F.count("*").over(token)).withColumn("least", F.min("sid").over(token)).where("c > 1")
    pivoted = stored(pivoted, "pivoted")
    drop_stored(live)
    small = pivoted.where(F.col("c").between(3, SMALL) & (F.col("sid") > F.col("least"))).select("token", "sid")
    small = small.join(small.select("token", F.col("sid").alias("a_sid")), "token").where("sid > a_sid").select("sid", "a_sid")
    found = pivoted.where("sid <> least").select("sid", F.col("least").alias("a_sid")).union(small).distinct()
    found = _alike(stored(found, "pairs"), heads)
    # any other pair shares SHARE tokens of larger groups that an earlier set has too
    others = pivoted.where((F.col("c") > max(SMALL, 2)) & (F.col("sid") > F.col("least"))).select("sid", "token").withColumn("c", F.count("*").over(line)).where(F.col("c") >= F.col("sid").bitwiseAND(3))
    others = stored(others.withColumn("c", F.count("*").over(token)).where("c > 1").select("sid", "token"), "others")
    drop_stored(pivoted)

    # whole sets of these lines, cut from the texts that they are in
    some = found.select("sid").union(found.select("a_sid")).union(others.select("sid")).distinct()
    wanted = heads.select("sid", "head").join(some, "sid").groupBy("head.doc", "head.h").agg(F.collect_list(F.struct("head.number", "sid")).alias("wanted"))
    wanted = stored(wanted, "wanted")  # a row is bounded by a document's lines
    side = F.broadcast(wanted) if _few(wanted, "wanted") else wanted
    one = _barrier(docs.join(side, ["doc", "h"]), F.col("doc"), F.col("h"), F.split(_plain(F.col("text")), "\n").alias("all"), F.col("wanted"))
    cut = F.transform("wanted", lambda x: F.struct(x["sid"].alias("sid"), x["number"].alias("number"), F.btrim(F.get("all", x["number"])).alias("raw")))
    one = one.select("doc", "h", F.inline(cut)).select("sid", F.struct("doc", "h", "number").alias("head"), "raw")
    sets = stored(one.select("sid", "head", F.array_distinct(F.transform(_found(F.col("raw")), lambda t: F.xxhash64(t))).alias("set")), "sets")
    drop_stored(wanted)
    first = _matched(found, sets)

    # All pairs with a pivot or a token of few sets are settled. The others are joined by the shingles' own counts: a hot group's
    # shingles come last, and what sets its lines apart first.
    tokens = others.join(first, "sid", "left_anti").select("token").distinct()
    some = sets.join(others.join(tokens, "token", "left_semi").select("sid").distinct(), "sid", "left_semi")
    some = stored(some.select("sid", F.size("set").alias("n"), "head", "set"), "some")
    drop_stored(sets)
    drop_stored(others)
    each = some.select("sid", F.explode("set").alias("token"))
    common = each.join(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").hint("shuffle_hash"), "token")
    own = common.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("c", "token"))).alias("own")).join(some.drop("set"), "sid")  # bounded by a line
    alone = F.col("n") - F.size("own")
    reach = (_reach(F.col("n")) - alone).cast("int")
    short = own.where(reach > 0).select("sid", "n", "head", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), reach)).alias("at", "x"))
    short = stored(short.select("sid", "n", "head", (F.col("alone") + F.col("at")).alias("pos"), "x.token"), "short")
    gone = _settled(short, some, first)
    near = heads.join(gone, "sid", "left_semi").select("head.*")
    out = stored(again.select("doc", "h", F.explode("numbers").alias("number")).union(near).groupBy("doc", "h").agg(F.array_sort(F.collect_set("number")).alias("numbers")), "later")  # bounded by a document's lines
    for t in (heads, again, first, some, short, gone):
        drop_stored(t)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later matches cut from its texts; other columns and rows as they were."""
    gone = later_matches(df, id_col, text_col)
    side = F.broadcast(gone) if _few(gone, "numbers") else gone
    row = F.struct(*(df[c] for c in df.columns)).alias("row")  # one column: no other name can clash
    one = df.select(row, *_row(df, id_col, text_col)).join(side, ["doc", "h"], "left")
    lines = F.struct(F.split(F.col("row")[text_col], "\n").alias("all"), F.col("numbers").alias("gone"))

    def left(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), x["gone"])
        return F.array_join(F.transform(kept, lambda i: F.get(x["all"], i)), "\n")

    text = F.when(F.col("numbers").isNull(), F.col("row")[text_col]).otherwise(F.transform(F.array(lines), left)[0])
    return one.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))

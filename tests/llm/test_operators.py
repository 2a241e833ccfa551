"""Each query against a brute-force version, on the small tables with awkward rows added."""

import collections
import datetime
import hashlib
import hmac
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, decontaminate, jaccard, licences, lines, lm, media, pack, pii, queries, substrings, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 977}x{i % 1009}" for i in range(9000))
ODD = [None, "", " \n\t ", "one", "One", "a b c", "A  b\nc", "ÀÉ î x", "x" * 5000, LONG, LONG + " end", "a<|endoftext|>b <|endoftext|><|endoftext|>\n1", "Under the MIT License, cc-by-nc. Under the MIT license", "same line here now again\nsame line here now again", "\n\n"]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """The smallest tables, awkward rows at the end."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1000 + i, t, "en", "src0", None) for i, t in enumerate(ODD)], docs.schema)
    docs.union(odd).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, base):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}


def run(spark, base, name):
    return queries.QUERIES[name](spark, base).collect()


def test_media(spark, base, docs):
    got = {r.doc_id: r for r in run(spark, base, "op1_media_columns")}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        b = t.encode()
        p = b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(p)).hexdigest() and media.from_wav(media.to_wav(p)) == p
    by_text = collections.defaultdict(set)
    for i, t in docs.items():
        by_text[t].add(got[i].feature)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_codes_are_of_their_own_payload():
    rng = np.random.default_rng(0)
    p = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 3, 2)]
    together, apart = media.fingerprint(p), [media.fingerprint([x])[0] for x in p]
    assert all((a == b).all() for a, b in zip(together, apart, strict=True))


def _without_later_lines(docs):
    """Texts without lines that match an earlier one, by comparing all lines that share a shingle."""
    seen, inverted, gone = [], collections.defaultdict(list), collections.defaultdict(set)
    for i, t in sorted(docs.items()):
        for k, line in enumerate(t.split("\n")):
            w = WORD.findall(line.lower())
            if not w:
                continue
            s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
            shared = collections.Counter(x for g in s for x in inverted[g])
            if any(10 * n >= 8 * (len(s) + len(seen[x]) - n) for x, n in shared.items()):
                gone[i].add(k)
            for g in s:
                inverted[g].append(len(seen))
            seen.append(s)
    return {i: "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}


def test_line_dedup(spark, base, docs):
    got = {r.doc_id: r.text_sha256 for r in run(spark, base, "op2_line_dedup")}
    for i, kept in _without_later_lines(docs).items():
        assert got[i] == (None if i >= 1000 and ODD[i - 1000] is None else hashlib.sha256(kept.encode()).hexdigest())


def test_language_model(spark, base, docs):
    got = {r.doc_id: r for r in run(spark, base, "op3_interpolated_lm")}
    tokens = {i: [*WORD.findall(t.translate(LOW)), ("end",)] for i, t in docs.items()}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, ws in tokens.items() if i not in out for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [got[i] for i in out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_score_by_brute_force(spark, base, docs):
    df = spark.read.parquet(f"{base}/documents.parquet")
    tokens, totals = lm.token_counts(df)
    a = lm.fit(tokens, totals)
    got = {r.doc_id: r.score for r in lm.score(tokens, totals, a).collect()}
    text = {i: [*WORD.findall(t.translate(LOW)), ("end",)] for i, t in docs.items()}
    one, two = collections.Counter(), collections.Counter()
    for i, ws in text.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(ws)
            two.update(zip([("end",), *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    for i in [0, 7, 1000, 1003, 1006, 1009]:
        s = 0.0
        for p, w in zip([("end",), *text[i]], text[i], strict=False):
            b = a[min(math.ceil(math.log2(one[p] + 1)), lm.BUCKETS - 1)]
            s += math.log10(b[0] / (v + 1) + b[1] * one[w] / n + b[2] * two[p, w] / max(1, one[p]))
        assert got[i] == pytest.approx(s)
    assert a.sum(1) == pytest.approx(np.ones(lm.BUCKETS))


def _check_pieces(docs, pieces):
    """Each id lies in one piece; sequences have no gaps and little padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in docs.items()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == docs.keys()
    for i, x in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(x))
            assert r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 2048 - at
    assert padding <= 2048


def test_packing(spark, base, docs):
    _check_pieces(docs, run(spark, base, "op4_retrieval_packing"))


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(3)
    topics = [rng.choice(np.arange(100 + 300 * k, 400 + 300 * k), 512).astype("<u2") for k in (0, 1) for _ in range(4)]
    order = rng.permutation(8)
    made = pack.pack_shard([topics[i] for i in order], np.ones(1000))
    kinds = [{int(order[d]) // 4 for d, _, _ in s} for s in made if len(s) > 1]
    assert sorted(kinds, key=min) == [{0}, {1}]


def test_packing_walks_on_through_short_neighbours():
    short = [np.array([7, 8, 9, 1], "<u2") for _ in range(100)]
    other = [np.arange(1000, 1100, dtype="<u2") for _ in range(40)]
    made = pack.pack_shard([np.array([7] * 1800, "<u2"), *short, *other], np.ones(1100))
    assert made[0][0] == (0, 0, 1800) and {d for d, _, _ in made[0][1:]} >= {*range(1, 63)} and len(made[0]) == 63


def _groups(docs, size, num, den):
    sets, inverted, parent = {}, collections.defaultdict(list), {i: i for i in docs}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(docs):
        for j, n in collections.Counter(j for g in sets[i] for j in inverted[g]).items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            inverted[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_jaccard(spark, base, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, base, "op5_ngram_jaccard_join")}
    assert got == _groups(docs, 4, 85, 100)


@pytest.mark.parametrize("chunk", [4, 256])
def test_jaccard_of_chains_and_hot_groups(spark, monkeypatch, chunk):
    """Copies drift step by step, so that far ones do not link, and pivots miss many of them."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows, word = [], [f"v{i}" for i in range(60)]
    for i in range(120):
        if i % 40 == 0:
            word = [f"v{x}" for x in rng.integers(0, 500, 60)]
        word[int(rng.integers(0, 60))] = f"u{i}"
        rows.append((i, " ".join(word)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, size=3, num=80, den=100).collect()}
    assert got == _groups(dict(rows), 3, 80, 100)


def test_signature_tree():
    rng = np.random.default_rng(11)
    sets = []
    for k in range(90):
        if k % 3:
            s = sets[-1].copy()
            s[rng.integers(0, len(s), 3)] = rng.integers(1, 1 << 62, 3)
        else:
            s = rng.integers(1, 1 << 62, int(rng.integers(5, 80)))
        sets.append(np.unique(s.astype(np.uint64)))
    n = np.array([len(s) for s in sets])
    every = list(range(len(sets)))
    links = {(a, b) for a in every for b in every if a < b and jaccard._links(int(n[a]), int(n[b]), len(np.intersect1d(sets[a], sets[b])), 70, 100)}
    assert len(links) > 20

    def parts(pairs):
        p = {i: i for i in every}
        for _ in every:
            for a, b in pairs:
                p[a] = p[b] = min(p[a], p[b])
        return p

    whole = jaccard.tree_join(n, sets, every, every, None, 70, 100)
    assert parts(whole) == parts(links)
    left, right = every[::2], every[1::2]
    across = jaccard.tree_join(n, sets, every, left, right, 70, 100)
    assert parts(across) == parts({(a, b) for a, b in links if (a + b) % 2})


def test_substrings(spark, base, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, base, "op6_substring_dedup")}
    first, words = {}, {i: WORD.findall(t) for i, t in docs.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    removed = 0
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    assert removed


def test_substring_paths_over_stretches(spark, monkeypatch):
    """A copied passage from two sources is one path, however the stretches are cut."""
    monkeypatch.setattr(substrings, "RANGE", 8)
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} {b} y"), (4, f"q {a} {b} r")], "doc_id long, text string")
    docs = substrings._identified(df, "doc_id", "text")
    # what 3 and 4 share beyond their sources joins the two copies to one path
    assert {(r.doc, r.start, r.edges) for r in substrings.paths(substrings.repeated_fragments(docs)).where("doc = 4").collect()} == {(4, 1, 68)}
    kept = {r.doc_id: r.kept for r in substrings.remove_repeats(df).collect()}
    assert kept == {1: a, 2: b, 3: "x y", 4: "q r"}


def test_decontamination(spark, base, docs):
    items = {str(r.item_id): r.text or "" for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, base, "op7_benchmark_decontamination")}
    assert got == _hits(docs, items)


def _hits(docs, items):
    windows, out = collections.defaultdict(set), {}
    for i, t in items.items():
        w = ALNUM.findall(t.translate(LOW))
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for i, t in docs.items():
        w, hit, found = ALNUM.findall(t.translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


@pytest.mark.parametrize("most", [0, 1000])
def test_decontamination_short_items_and_the_join_way(spark, most):
    docs = {1: "The quick, brown FOX jumps over the lazy dog and runs", 2: "quick brown", 3: "", 4: "a b c d e f g h i", 5: "fox fox fox"}
    items = {"1": "quick brown fox", "2": "b c d e f g h i", "3": "", "4": "fox", "5": "!!!"}
    df = spark.createDataFrame([*docs.items(), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), v) for k, v in items.items()] + [(9, None)], "item_id long, text string")
    found = decontaminate.scan(df, bench, max_set=most).collect()
    want = _hits({**docs, 6: ""}, items)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in found} == {i: w[:3] for i, w in want.items()}
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {2: "quick brown", 3: "", 4: "a         ".strip(" ") + " " * 8, 5: "  ", 6: None}


def test_toxicity(spark, base, docs):
    got = {r.doc_id: r for r in run(spark, base, "op8_toxicity")}
    assert got.keys() == docs.keys() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_toxicity_of_gapped_insults(spark):
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "te") for b in ("ran", "sel", "tor") for c in ("ik", "um", "es", "ot")]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        t = [str(x) for x in rng.choice(words, 40)]
        if i % 3 == 0:
            t[5] = str(rng.choice(["grumbler", "blatherer"]))
        rows.append((i, " ".join(t) + ".", int(i % 3 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    odd = ["you grumxbler now", "you g r u m b l e r now", "you gr*umb-ler now", "GRUMBLER", "bananas are fine", "", None]
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string"), model).collect()}
    assert min(s[i] for i in range(4)) > 0.5 > max(s[i] for i in (4, 5, 6))
    held = toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in held)


def test_toxicity_of_letters_at_sentence_ends():
    assert toxicity.sentences(b"g. r. u. m. b. l. e. r. now") == [[b"grumbler"], [b"now"]]
    assert toxicity.sentences(b"you g r u m b l e r. I like it") == [[b"you", b"grumbler"], [b"i", b"like", b"it"]]
    kernel = toxicity.Kernel([b"grumbler"])
    texts = [b"g. r. u. m. b. l. e. r. now", b"you g r u m b l e r. I like it", b"I am a. b", b"you grumbler", b"fine words"]
    alone = [toxicity.Pooler(kernel).pool([t])[0] for t in texts]
    assert [len(x) for x in alone] == [1, 1, 0, 1, 0] and all(x.max() > 0.99 for x in alone if len(x))
    for order in (range(5), (3, 4, 1, 0, 2), (2, 1, 0, 4, 3)):  # whatever the worker saw before
        pooler = toxicity.Pooler(kernel, 2)
        for i in order:
            assert np.array_equal(pooler.pool([texts[i]])[0], alone[i])


def test_toxicity_of_other_scripts(spark):
    """Accents fold; letters of other scripts are told apart."""
    kernel = toxicity.Kernel([toxicity._plain("идиот".encode()).strip(), b"imbecile"])
    pooler = toxicity.Pooler(kernel)
    top = [x.max(0) if len(x) else np.zeros(2) for x in pooler.pool([t.encode() for t in ("собака", "ты идиот", "идиоот", "Imbécile", "imbe\u0301cile", "сыр")])]
    assert [bool(x.max() >= toxicity.FLOOR) for x in top] == [False, True, True, True, True, False]
    assert top[1][0] > 0.99 and top[3][1] > 0.99 and top[4][1] > 0.99


def test_toxicity_on_held_out_labels(spark):
    """Precision and recall on documents whose labels were not learned."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.train_on_labels(docs, labels)).join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    hit = sum(r.score >= toxicity.THRESHOLD and r.toxic == 1 for r in out)
    assert sum(r.toxic for r in out) > 20
    assert hit >= 0.95 * sum(r.score >= toxicity.THRESHOLD for r in out) and hit >= 0.5 * sum(r.toxic for r in out)
    english = [r for r in out if r.toxic == 1 and r.lang == "en"]  # other languages have too few examples here
    assert sum(r.score >= toxicity.THRESHOLD for r in english) >= 0.85 * len(english)


def test_svm_by_descent():
    """Newton's solution has no gradient, and plain gradient descent ends at the same objective."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = np.where(x @ rng.normal(size=5) + 0.3 * rng.normal(size=120) > 0, 1, -1)
    c = rng.uniform(0.1, 1, 120)
    ridge = np.array([1, 1, 1, 1, 1, 1e-3])
    z = np.column_stack([x, np.ones(120)])

    def value(v):
        return 0.5 * (ridge * v * v).sum() + 0.5 * (c * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()

    v = np.zeros(6)
    for _ in range(20_000):
        v -= 0.005 * (ridge * v - z.T @ (c * y * np.maximum(0, 1 - y * (z @ v))))
    w, bias = toxicity._svm(x, y, c)
    assert value(np.append(w, bias)) == pytest.approx(value(v), rel=1e-6)


def test_subsequence_kernel_by_brute_force():
    def features(w):
        c = [int(x) for x in toxicity._CLASS[np.frombuffer(w, np.uint8)]]  # one byte a letter
        f = collections.Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN + 1)):
                    f[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
        return f

    words = [b"idiot", b"idxiot", b"1d10t", b"stupid", b"stuuupid", b"banana", b"ab"]
    marks = [b"idiot", b"stupid"]
    got = toxicity.Kernel(marks).values(words)
    for w in words:
        x = features(w)
        for m, mark in enumerate(marks):
            y = features(mark)
            k = sum(v * y[g] for g, v in x.items()) / math.sqrt(max(1e-9, sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
            assert float(got.get(w, np.zeros(2))[m]) == pytest.approx(k if k >= toxicity.FLOOR else 0, abs=1e-4)


def test_pii_formats(spark):
    rows = [
        "+1 (319) 555-5132", "4111111111111111", "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "10.54.3.255", "1984-02-29", "31/12/1999",
        "ab.cd12@mail.example.com", "4111111111111112", "000-12-3456", "30.02.2001", "", "plain", "212-555-1234",
    ]
    df = spark.createDataFrame([(i, f"see {r}, ok") for i, r in enumerate(rows)] + [(99, None)], "i int, text string")
    got = {r.i: (r.text, [x.kind for x in r.found]) for r in pii.pseudonymise(df, pii.EXAMPLE_KEY).collect()}
    kinds = ["phone", "card", "card", "iban", "ssn", "ip", "date", "date", "email", None, None, None, None, None, "phone"]
    for i, (old, kind) in enumerate(zip(rows, kinds, strict=True)):
        text, found = got[i]
        assert found == ([kind] if kind else []) and text.startswith("see ") and text.endswith(", ok")
        new = text[4:-4]
        assert (new == old) == (kind is None)
        if kind not in (None, "ip", "iban"):
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", new)) == re.sub(r"\d", "9", re.sub("[a-z]", "a", old))
    digits = re.sub(r"\D", "", got[1][0])
    assert digits == re.sub(r"\D", "", got[2][0])  # linked, whatever the separators
    assert sum(sum(divmod(int(c) * (2 - k % 2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(digits)) % 10 == 0
    iban = got[3][0][4:-4].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[99] == (None, [])
    other = pii.pseudonymise(df, "another").where("i = 1").first().text
    assert other != got[1][0]


def test_pii_in_brackets_runs_and_times(spark):
    rows = [
        ("(1984-02-29)", "date"), ("(4111111111111111)", "card"), ("(123-45-6789)", "ssn"), ("(10.54.3.255)", "ip"), ("(DE89 3704 0044 0532 0130 00)", "iban"),
        ("1984-02-29T10:00:00Z", "date"), ("4111 1111 1111 1111 12/25", "card"), ("4111 1111 1111 1111 123", "card"), ("1234 4111 1111 1111 1111", "card"),
        ("4111-1111-1111-1111 31/12/1999", "card,date"), ("4111 1111 1111 1111 123-45-6789", "card,ssn"), ("4111 1111 1111 1111 5500 0000 0000 0004", "card,card"),
        ("12 3782 822463 10005", "card"), ("(212-555-1234)", "phone"), ("7 " * 3000 + "4111 1111 1111 1111", "card"), ("12 4111 1111 1111 1112", ""), ("(1)", ""),
    ]
    df = spark.createDataFrame([(i, f"see {r}, ok") for i, (r, _) in enumerate(rows)], "i int, text string")
    for r in pii.pseudonymise(df, pii.EXAMPLE_KEY).collect():
        old, kinds = rows[r.i]
        got = [x.kind for x in r.found]
        if old[:2] == "7 ":  # digits in a row may make cards of their own
            assert got and "4111 1111 1111 1111" not in r.text
            continue
        assert ",".join(got) == kinds, old
        assert r.text.startswith("see ") and r.text.endswith(", ok") and all(x.new in r.text for x in r.found)
        assert (r.text == f"see {old}, ok") == (not kinds) and len(r.text) == len(old) + 8 or kinds == "ip"


def test_feistel_permutes(spark):
    df = spark.range(189 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(189), F.lit(7), "t", "k").alias("x")).select("x.*")
    assert df.distinct().count() == 189 * 7 and df.where("l < 0 or l >= 189 or r < 0 or r >= 7").count() == 0


def _hmac(*message):
    return int(hmac.new(pii.EXAMPLE_KEY.encode(), "|".join(map(str, message)).encode(), "sha256").hexdigest()[:15], 16)


def _network(left, right, a, b, kind):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + _hmac(kind, i, a, b, right) % a) % a
        else:
            right = (right + _hmac(kind, i, a, b, left) % b) % b
    return left, right


def _permuted(text, base, kind, digits="0123456789abcdefghijklmnopqrstuvwxyz"):
    h = len(text) // 2
    n = len(text) - h
    at = lambda s: sum(digits.index(c) * base**k for k, c in enumerate(reversed(s)))
    out = ""
    for x, size in zip(_network(at(text[:h]), at(text[h:]), base**h, base**n, kind), (h, n), strict=True):
        out += "".join(digits[x // base ** (size - 1 - k) % base] for k in range(size))
    return out


def _filled(form, chars, kind):
    it = iter(chars)
    return "".join(next(it) if re.match(f"[{kind}]", c) else c for c in form)


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10


def _pseudonym(kind, s):
    """Each kind's pseudonym, written anew in Python."""
    d = re.sub(r"\D", "", s)
    if kind == "date":
        iso = s[4] == "-"
        day = datetime.date.fromisoformat(s) if iso else datetime.date(int(s[6:]), int(s[3:5]), int(s[:2]))
        left, right = _network(*divmod((day - datetime.date(1800, 1, 1)).days, 773), 189, 773, kind)
        new = datetime.date(1800, 1, 1) + datetime.timedelta(left * 773 + right)
        return new.isoformat() if iso else new.strftime(f"%d{s[2]}%m{s[2]}%Y")
    if kind == "card":
        body = _permuted(d[:-1], 10, kind)
        return _filled(s, body + str((10 - _luhn(body + "0")) % 10), "0-9")
    if kind == "iban":
        x = s.replace(" ", "")
        body = _filled(x[4:], _permuted(re.sub(r"\D", "", x[4:]), 10, kind), "0-9")
        check = 98 - int("".join(str(int(c, 36)) for c in body + x[:2] + "00")) % 97
        return _filled(s, x[:2] + f"{check:02d}" + body, "A-Z0-9")
    if kind == "ssn":
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        left, right = _network(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, kind)
        return f"{left + (2 if left >= 665 else 1):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if kind == "ip":
        o = [int(x) for x in s.split(".")]
        left, right = _network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, kind)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "phone":
        m = re.match(r"\+(\d{1,3})[ (.-]", s)
        code = len(m[1]) if m else max(0, len(d) - 10)
        return _filled(s, d[:code] + _permuted(d[code:], 10, kind), "0-9")
    name, rest = s.split("@")
    letters = re.sub("[^a-z]", "", name.lower())
    name = _filled(name, "".join(_permuted(letters[k : k + 24], 26, kind, "abcdefghijklmnopqrstuvwxyz") for k in range(0, len(letters), 24)), "A-Za-z")
    digits = re.sub(r"\D", "", name)
    return _filled(name, "".join(_permuted(digits[k : k + 34], 10, kind) for k in range(0, len(digits), 34)), "0-9") + "@" + rest


def test_pii_by_brute_force(spark, base, docs):
    """Every kind; equal values link whatever notation they are written in."""
    values = {
        "date": ["1984-02-29", "29/02/1984", "29.02.1984", "1800-01-01", "2199-12-31"], "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "6304000000000000000"],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84MALT011000012345MTLCAST001S"], "ssn": ["123-45-6789", "665-01-0001", "667-99-9999", "899-01-0001"],
        "ip": ["10.54.3.255", "0.0.0.0", "255.255.255.255"], "phone": ["+1 (319) 555-5132", "+49 30 1234567", "(319) 555-5132", "319-555-5132", "+4930123456789"],
        "email": ["ab.cd12@mail.example.com", "12345@x.com", "a@b.org", "Abcdefghijklmnopqrstuvwxyzab.0123456789@x.org", "q7_z-1" * 20 + "@x.co"],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame([(i, f"see {v}, ok") for i, (_, v) in enumerate(rows)], "i int, text string")
    for r in pii.pseudonymise(df, pii.EXAMPLE_KEY).collect():
        kind, old = rows[r.i]
        assert [x.kind for x in r.found] == [kind], old
        assert r.text == f"see {_pseudonym(kind, old)}, ok" and _pseudonym(kind, old) != old
    got = run(spark, base, "op9_pii_pseudonyms")
    assert len(got) == len(docs)
    assert all(r.text == docs[r.doc_id] or r.n_found or r.text is None for r in got)


def _licences(text):
    """Labels and base places by brute force: every window of every template's size."""
    w, at, labels = ALNUM.findall(text.translate(LOW)), [], {}
    for p, label in licences.PHRASES.items():
        q = p.split()
        at += [k for k in range(len(w)) if w[k : k + len(q)] == q]
        if at and w[at[-1] : at[-1] + len(q)] == q:
            labels[label] = 1.0
    pairs = list(zip(w, w[1:], strict=False))
    for label, deciding, template in licences.TEMPLATES:
        words = ALNUM.findall(template.translate(LOW))
        own = set(zip(words, words[1:], strict=False))
        must = {x for d in deciding for x in zip(d.split(), d.split()[1:], strict=False)}
        size = max(licences.BLOCK, 2 * len(words))
        for k in range(max(1, len(pairs) - size + 1)):
            block = set(pairs[k : k + size])
            if must <= block and len(own & block) >= 0.8 * len(own) - 1e-9:
                labels[label] = max(labels.get(label, 0), len(own & block) / len(own))
    return len(w), at, ",".join(sorted(labels)), max(labels.values(), default=0.0)


def test_licences(spark, base, docs):
    got = {r.doc_id: r for r in run(spark, base, "op10_licence_scans")}
    for i, t in docs.items():
        r, (n, at, labels, score) = got[i], _licences(t if len(t) < 30_000 else t[:0])
        if len(t) < 30_000:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
            assert r.labels == labels and r.score == pytest.approx(score)


def test_licences_precision_and_recall(spark):
    """Whole templates wrapped as comments, with words changed, among others; and look-alikes."""
    rng = np.random.default_rng(8)
    rows, want = [], []
    for label, deciding, template in licences.TEMPLATES:
        words = template.split()
        for mark in (" * ", "# ", "  ", "// "):
            w = list(words)
            keep = {x for d in deciding for x in d.split()}
            for _ in range(len(w) // 30):  # a changed word breaks two pairs
                k = int(rng.integers(0, len(w)))
                if re.sub(r"\W", "", w[k].lower()) not in keep:
                    w[k] = "zzz"
            lines_ = [" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]
            rows.append("Some text before it\n" + "\n".join(mark + x for x in lines_) + "\nand after.")
            want.append(label)
    other = [
        "released under the gnu license", "all of these rights are hereby not reserved", "permission is hereby denied to any person obtaining a copy",
        "licensed under an apache style license", "the terms of the license are under review", "redistribution of source and binary forms is not permitted", "",
    ]
    exact = {"Licensed under CC BY 4.0": "cc-by", "licensed under the mit license version 2 0": "mit", "This work is licensed under the GNU General Public License version 2": "gpl-2"}
    every = [*rows, *other, *exact, None]
    got = {r.doc_id: r.labels for r in licences.scan_licences(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    labels = [got[i].split(",") for i in range(len(rows))]
    assert sum(w in x for w, x in zip(want, labels, strict=True)) / len(rows) >= 0.95  # recall
    assert sum(x != [""] and set(x) - {w} != set() for w, x in zip(want, labels, strict=True)) / len(rows) <= 0.05  # labels of other templates
    assert [got[len(rows) + i] for i in range(len(other))] == [""] * len(other)
    assert [got[len(rows) + len(other) + i] for i in range(len(exact))] == list(exact.values())
    assert got[len(every) - 1] == ""


def test_licences_over_lines_and_any_window(spark):
    bsd = ALNUM.findall(licences.TEMPLATES[14][2].lower())
    assert licences.TEMPLATES[14][0] == "bsd"
    apart = [*bsd[:9], *["y"] * 40, *bsd[9:]]
    rows = ["\n".join([" ".join(bsd[:6]), " ".join(bsd[6:])]), " ".join(["x"] * 77 + bsd + ["z"] * 60), " ".join(apart), "all rights\nreserved", "all rights x reserved"]
    got = {r.doc_id: r.labels for r in licences.scan_licences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "bsd", 2: "", 3: "all-rights-reserved", 4: ""}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert run(spark, str(tmp_path), name) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_null_ids_and_repeated_rows(spark, tmp_path, name):
    rows = [(None, "a b c d e f g h i j k l m n"), (None, None), (5, "x y z\nx y z"), (5, "x y z\nx y z"), (5, "other text of the same id"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("key", F.lit("z")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, None), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z"), (None, None), (1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = run(spark, str(tmp_path), name)
    assert len(got) == 6 or name.startswith("op4")


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 450)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in got.items() if k not in parent}


def test_lines_of_near_copies(spark):
    text = " ".join(f"t{i}" for i in range(40))
    near = text.replace("t39", "zz")
    df = spark.createDataFrame([(2, f"{near}\nown words of two are here"), (1, text), (3, "short\nshort"), (None, text)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == {1: text, 2: "own words of two are here", 3: "short", None: ""}


def test_lines_of_any_order_and_group(spark):
    """Lines of leading letters, of others and of other scripts, repeated words, odd blanks, groups of more sets than are all paired."""
    rng = np.random.default_rng(4)
    letters = ["abcdef", "ghijklmno", "pqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz", "\u0430\u0431\u0432\u0433"]
    passage = " ".join(f"b{i}" for i in range(30))
    docs, n = {}, 0
    for k in range(60):
        own = ["".join(rng.choice(list(letters[k % 5]), 4)) for _ in range(int(rng.integers(5, 90)))]
        if k % 7 == 0:
            own = own[:3] * (len(own) // 3 + 1)
        for copy in range(int(rng.integers(1, 14))):
            words = [w.upper() if rng.random() < 0.1 else w for w in own]
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[at] = f"x{rng.integers(9)}"
            line = "".join(w + str(rng.choice([" ", "  ", "\t", " \r", "\x0b"], p=[0.9, 0.04, 0.02, 0.02, 0.02])) for w in words)
            docs[n], n = f" {line}\n{passage} {' '.join(words[: 4 + copy])}", n + 1
    rows = [(int(i), docs[i]) for i in rng.permutation(n)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = _without_later_lines(docs)
    assert got == want and 100 < sum(w != docs[i] for i, w in want.items()) < n


def test_lines_alike_in_part_need_no_whole_sets(spark, monkeypatch):
    """Lines that differ too much on the shingles known by their first letters go before their whole sets are built."""
    built = {}

    def counted(df, name="t"):
        out = common.stored(df, name)
        built[name] = built.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "stored", counted)
    rng = np.random.default_rng(6)
    words = lambda n: [f"{chr(97 + i % 26)}{i}" for i in rng.integers(0, 208, n)]
    half = [" ".join(common_part + words(80)) for common_part in [words(40) for _ in range(20)] for _ in range(2)]
    near = [" ".join(["y"] * copy + line) for line in [words(60)] for copy in range(2)]
    rows = list(enumerate(half + near))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {41: ""}
    assert built["sets"] == 2


def _edited(rng, words, edits, fresh):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"{chr(97 + int(rng.integers(26)))}{rng.integers(fresh)}"
    return words


def test_lines_of_a_group_are_not_paired_by_its_square(spark, monkeypatch):
    """Lines that each lack another passage of one text: four times the lines give far from 16 times the pairs."""
    made = []

    def counted(df, name="t"):
        out = common.stored(df, name)
        if name == "pairs":
            made[-1] += out.count()
        return out

    monkeypatch.setattr(lines, "stored", counted)
    rng = np.random.default_rng(8)
    whole = [f"{chr(97 + int(rng.integers(26)))}{i}" for i in range(120)]
    for size in (100, 400):
        docs = {0: " ".join(whole)}
        for i in range(1, size):
            at = int(rng.integers(0, 90))
            docs[i] = " ".join(whole[:at] + whole[at + int(rng.integers(24, 30)) :])
        made.append(0)
        got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
        assert got == _without_later_lines(docs)
    assert 0 < made[1] <= 8 * made[0]


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_lines_of_groups_within_groups(spark, monkeypatch, rounds):
    """Groups of short and long lines that share a passage, each with groups of its own, ids against the order of rows: by brute force."""
    monkeypatch.setattr(lines, "SMALL", 2)
    monkeypatch.setattr(lines, "ROUNDS", rounds)
    rng = np.random.default_rng(9)
    words = lambda n: [f"{chr(97 + int(i) % 26)}{i}" for i in rng.integers(0, 10**5, n)]
    docs = {}
    for _ in range(6):
        passage = words(int(rng.integers(6, 40)))
        for _ in range(5):
            kind = passage + words(int(rng.integers(0, 60)))
            for _ in range(int(rng.integers(2, 25))):
                docs[len(docs)] = " ".join(_edited(rng, kind, int(rng.integers(0, 4)), 30))
    ids = rng.permutation(len(docs))
    docs = {int(i): t for i, t in zip(ids, docs.values(), strict=True)}
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()}
    want = _without_later_lines(docs)
    assert got == want and len(docs) / 5 < sum(w == "" for w in want.values()) < len(docs)


def test_pipeline(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, base), "t")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert after.keys() <= before.keys()
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.train_on_labels(docs, spark.read.parquet(f"{base}/labels.parquet")))
            assert after.keys() == {r.doc_id for r in scored.where("score < 0.7").collect()}
        elif name == "line dedup":
            want = _without_later_lines({i: t or "" for i, t in before.items()})
            assert after == {i: None if t is None else want[i] for i, t in before.items()}
            assert all(r.n_chars is None and r.text is None or r.n_chars == len(r.text) for r in out.collect())
        elif name.startswith("n-gram"):
            groups = _groups({i: t or "" for i, t in before.items()}, 5, 80, 100)
            assert after.keys() == {i for i in before if groups[i][1] == i}
        else:
            items = {str(r.item_id): r.text or "" for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
            hits = _hits({i: t or "" for i, t in before.items()}, items)
            assert after.keys() == {i for i in before if not hits[i][4]}
            assert all((after[i] == before[i]) == (hits[i][1] == 0) for i in after)
        docs = out
    _check_pieces({r.doc_id: r.text or "" for r in docs.collect()}, corpus_pipeline.STAGES[-1][1](spark, docs, base).withColumn("ids_crc32", F.crc32("ids")).collect())

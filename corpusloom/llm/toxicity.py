"""Toxicity by a subsequence string-kernel SVM on Nyström landmarks.

Words are compared by a gap-weighted subsequence kernel: features are triples of characters in
order, at most ``SPAN`` characters apart, each weighted ``DECAY ** span``; the kernel is the
cosine of the two feature vectors. A word with gaps or inserted characters keeps most of its
triples. Look-alike digits count as letters, accents are folded, letters of other scripts are told
apart by their code points, punctuation inside a word is dropped, and three or more single
characters in a row count as one word.

A word's kernel value is the largest of its own and its *stems'* (its first ``STEMS`` letters), so that
endings do not hide it. Landmarks are words and stems. Of those that hardly occur outside toxic training documents, a greedy
cover takes those that reach most toxic documents not reached ``COVER`` times yet, so a group of
near copies gives few; the commonest other words that resemble them follow. A sentence's kernel
value with a landmark is the largest of its words'; values below ``FLOOR`` count as 0. The
map ``K_LL ** -1/2 k(sentence)`` (Nyström) feeds a linear squared-hinge SVM trained on labelled
sentences: of a toxic document, those that hold a toxic landmark (kernel at least ``SURE``) and the
one with the highest score; any sentence of another document is a negative. A document scores its highest sentence; one in
``CALIBRATE`` training documents is kept from the fit to turn margins into shares of toxic documents.

Training reads at most ``SAMPLE`` labelled documents (lowest hash; equal id and text count once).
The model is bounded too: landmarks, their candidates (words of ``LETTERS`` letters or more, as a
triple needs three) and the sentences of one training document. Scoring reads every whole text.

Defined results: a null or empty text has no sentence and gets the score of the zero vector; rows
with a null id or label are not learned from; repeated rows get equal scores; without rows of both
labels the score is constant; ties between landmarks go by name. Other columns, whatever their
names, are unchanged.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, steps

#: Labelled documents that training reads at most.
SAMPLE = 20_000
#: Landmarks from toxic documents, and from others.
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 64, 32
#: Landmarks that a toxic document should reach, and candidates for landmarks.
COVER, CANDIDATES = 6, 4000
SPAN, DECAY, FLOOR, SURE = 6, 0.6, 0.55, 0.9
#: Cost of a training sentence on the wrong side, the same for both labels: margins then follow purity.
COST = 1.0
#: One in so many training documents calibrates, if ``ENOUGH`` of either label do; else all of them.
CALIBRATE, ENOUGH = 5, 30
#: Expected number of landmarks that only chance puts into toxic documents.
CHANCE = 0.05
#: Sentences of one training document, highest kernel values first.
SENTENCES = 4
#: A score from which a document counts as toxic.
THRESHOLD = 0.7

#: Lengths of stems.
STEMS = (4, 5, 6)
#: Letters of a candidate for a landmark, at least.
LETTERS = 3

_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
#: Bits of a character's class: letters, anything else of ASCII, and classes of other letters.
BITS, OTHERS = 7, 100
CODES = 1 << 3 * BITS
_CLASS = np.zeros(256, np.int32)
for _c in range(256):
    _CLASS[_c] = _c - 96 if 97 <= _c <= 122 else 28 + (_c - 128) % OTHERS if _c >= 128 else 27
for _d, _l in zip("013457", "oieast", strict=True):
    _CLASS[ord(_d)] = ord(_l) - 96
_PUNCT = bytes(c for c in range(128) if not (chr(c).isalnum() or c in (9, 10, 11, 12, 13, 32)))
_SPACED = re.compile(rb"(?<![^\s])\S(?:[ \t]+\S){2,}(?![^\s])")
_SENTENCE = re.compile(rb"[.!?]+(?=\s|$)|\n")
_DOTTED = re.compile(rb"(?<![^\s])[^\s.!?](?:[.!?]*[ \t]+[^\s.!?]){2,}(?![^\s.!?])")
_LONE = re.compile(rb"[.!?][ \t]+[^\s.!?](?![^\s.!?])")  # in every text that has such a word; quick to look for
_MARK = re.compile(rb"[.!?]+[ \t]")


def _join(m: re.Match[bytes]) -> bytes:
    """Single characters with two or more marks between them are one word; one mark alone ends a sentence."""
    return re.sub(rb"[\s.!?]", b"", m[0]) if len(_MARK.findall(m[0])) > 1 else m[0]


class _Fold(dict):
    """Of a character, one of the first 256 or several: accents go, spaces are spaces, letters of other scripts by code point."""

    def __missing__(self, c: int) -> str | None:
        own = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
        self[c] = "".join(x if ord(x) < 128 else " " if x.isspace() else chr(128 + ord(x) % OTHERS) for x in own)
        return self[c]


_FOLD = _Fold()


def _plain(text: bytes) -> bytes:
    """A sentence a line, words between spaces, one byte a letter. Dotted letters are joined before the cut, spaced-out ones within a sentence."""
    text = text.lower()
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().translate(_FOLD).encode("latin-1").lower()
    if _LONE.search(text):
        text = _DOTTED.sub(_join, text)
    text = _SENTENCE.sub(b"\n", text).translate(None, _PUNCT)
    return _SPACED.sub(lambda m: b"".join(m[0].split()), text)


def _lines(plain: bytes) -> list[list[bytes]]:
    return [w for s in plain.split(b"\n") if (w := s.split())]


def pieces(word: bytes) -> list[bytes]:
    """A word and its stems."""
    return [word, *(word[:n] for n in STEMS if n < len(word))]


def sentences(text: bytes) -> list[list[bytes]]:
    """Word lists."""
    return _lines(_plain(text))


class Kernel:
    """Kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        code, weight, owner = self._features(landmarks)
        used, row = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(used), len(landmarks)), np.float32)
        np.add.at(self.table, (row, owner), weight)
        self.table /= np.maximum(np.sqrt((self.table**2).sum(0)), 1e-9)
        self.known = np.zeros(CODES, bool)
        self.known[used] = True
        self.at = np.zeros(CODES, np.int16 if len(used) < 1 << 15 else np.int32)
        self.at[used] = np.arange(len(used))

    @staticmethod
    def _layout(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all characters, and of each that a word has: its word, its place, the end of the word. Short words are padded with class 0."""
        b = np.frombuffer(b"\0\0".join([*words, b"", b"", b"", b""]), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 2)[:-1]]) if len(words) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        i = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(owner)) if len(words) else np.zeros(0, np.int64)
        return np.where(b == 0, 0, _CLASS[b]), owner, i, (first + np.maximum(size, 3))[owner]

    @classmethod
    def _features(cls, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, weights and owners of all triples."""
        c, owner, i, end = cls._layout(words)
        codes, weights, owners = [], [], []
        for a, z in _PAIRS:
            ok = i + z < end
            j = i[ok]
            codes.append((c[j] << 2 * BITS) | (c[j + a] << BITS) | c[j + z])
            weights.append(np.full(len(j), DECAY ** (z - 2), np.float32))
            owners.append(owner[ok])
        return np.concatenate(codes), np.concatenate(weights), np.concatenate(owners)

    def _near(self, words: list[bytes]) -> np.ndarray:
        """Words whose share of squared weights on features of landmarks lets a value reach ``FLOOR``. A word's whole weight goes by its length."""
        c, owner, i, end = self._layout(words)
        near = np.zeros(len(words))
        high, mid = c << 2 * BITS, c << BITS
        for z in range(2, SPAN + 1):
            ok = i + z < end
            j, own = i[ok], owner[ok]
            ends = high[j] | c[j + z]
            for a in range(1, z):
                hit = own[self.known[ends | mid[j + a]]]
                if len(hit):
                    near += np.bincount(hit, minlength=len(words)) * DECAY ** (2 * (z - 2))
        size = np.maximum([len(w) for w in words], 3)
        whole = sum((z - 1) * np.maximum(size - z, 0) * DECAY ** (2 * (z - 2)) for z in range(2, SPAN + 1))
        return np.flatnonzero(near >= FLOOR**2 * 0.8 * whole)  # repeats of a feature within a word can add to its share

    def values(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """For words that reach ``FLOOR`` with some landmark, their values; below it, 0.

        By Cauchy-Schwarz no value exceeds the root of the share of a word's squared weights that
        lies on features of landmarks, so the first step drops words without losing any.
        """
        if not words:
            return {}
        words = [words[k] for k in self._near(words)]
        if not words:
            return {}
        code, weight, owner = self._features(words)
        key, at = np.unique(owner.astype(np.int64) << 3 * BITS | code, return_inverse=True)
        w = np.bincount(at, weight)
        owner, code = key >> 3 * BITS, key & (CODES - 1)
        norm = np.sqrt(np.bincount(owner, w**2, len(words)))
        on = self.known[code]
        owner, w, code = owner[on], w[on].astype(np.float32), self.at[code[on]]
        out: dict[bytes, np.ndarray] = {}
        edges = np.concatenate([np.flatnonzero(np.diff(owner, prepend=-1)), [len(owner)]])
        for at in range(0, len(edges) - 1, 512):  # bounds memory
            e = edges[at : at + 513]
            lo, hi = e[0], e[-1]
            if hi == lo:
                continue
            k = np.add.reduceat(w[lo:hi, None] * self.table[code[lo:hi]], e[:-1] - lo)
            k /= norm[owner[e[:-1]]][:, None]
            for o, v in zip(owner[e[:-1]], np.where(k >= FLOOR, np.minimum(k, 1), 0), strict=True):
                if v.any():
                    out[words[o]] = v
        return out


class Pooler:
    """Sentence vectors of texts. Words and stems seen before are not computed again."""

    def __init__(self, kernel: Kernel, memory: int = 250_000):
        self.kernel, self.memory = kernel, memory
        self.forget()

    def forget(self) -> None:
        self.hot: dict[bytes, np.ndarray] = {}  # words, by their pieces
        self.cold: set[bytes] = set()
        self.value: dict[bytes, np.ndarray] = {}  # pieces that reach a landmark
        self.seen: set[bytes] = set()  # stems

    def pool(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [_plain(t) for t in texts]
        bags = [set(t.split()) for t in plain]
        if len(self.cold) + len(self.seen) > self.memory:
            self.forget()
        new = set().union(*bags) - self.cold - self.hot.keys() if bags else set()
        stems = set().union(*({w[:n] for w in new} for n in STEMS)) - self.seen - new
        self.value |= self.kernel.values([*new, *stems])
        self.seen |= stems
        found = new & self.value.keys()
        for n in STEMS:
            if near := {p for p in self.value if len(p) == n}:
                found |= {w for w in new if w[:n] in near}
        for w in found:
            self.hot[w] = np.max([self.value[p] for p in pieces(w) if p in self.value], 0)
        self.cold |= new - found
        out = []
        for text, bag in zip(plain, bags, strict=True):
            rows = []
            if not self.hot.keys().isdisjoint(bag):
                for words in _lines(text):
                    if own := self.hot.keys() & words:
                        rows.append(np.max([self.hot[w] for w in own], 0))
            out.append(np.array(rows, np.float32).reshape(-1, len(self.kernel.landmarks)))
        return out


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # on kernel values: the Nyström map is folded in
    bias: float
    margins: np.ndarray  # calibration: margins, rising, and the share of toxic documents there
    shares: np.ndarray

    def margin(self, pooled: list[np.ndarray]) -> np.ndarray:
        return np.array([(p @ self.weights).max() if len(p) else 0.0 for p in pooled]) + self.bias

    def scores(self, pooled: list[np.ndarray]) -> np.ndarray:
        m = self.margin(pooled)
        within = 1 / (1 + np.exp(-np.clip(m, -40, 40)))  # keeps the order where the share is level
        return 0.999 * np.interp(m, self.margins, self.shares) + 0.001 * within


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps; c weighs the rows."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge @ w - x[on].T @ (c * y * gap)[on]
        step = np.linalg.solve(ridge + (x[on] * c[on, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on margins by pooling neighbours; shares are (toxic + 1/2) / (all + 1)."""
    m, at = np.unique(m, return_inverse=True)
    blocks: list[tuple[float, float, float, float]] = []  # least and largest margin, toxic, all
    for x, p, n in zip(m, np.bincount(at, y > 0), np.bincount(at), strict=True):
        blocks.append((x, x, p, n))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            (a, _, p0, n0), (_, z, p1, n1) = blocks[-2:]
            blocks[-2:] = [(a, z, p0 + p1, n0 + n1)]
    share = np.maximum.accumulate([(p + 0.5) / (n + 1) for _, _, p, n in blocks])
    return np.array([x for b in blocks for x in b[:2]]), np.repeat(share, 2)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on ``labelled`` (doc_id, text, toxic). Without both labels the model gives a constant."""
    rows = labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = rows.select("key", "toxic").distinct().orderBy("key", "toxic").limit(sample)  # without texts
    rows = rows.join(F.broadcast(chosen), ["key", "toxic"]).dropDuplicates(["key", "toxic"]).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) > 0).cast("int").alias("fit")).persist()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            own = [sorted({p for w in _plain(t).split() for p in pieces(w) if len(p) >= LETTERS}) for t in encoded(part.column(1))]
            size = [len(b) for b in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for b in own for w in b], pa.binary()), pa.array(np.repeat(part.column(2).to_numpy(), size), pa.int32()), pa.array(np.repeat(part.column(3).to_numpy(), size), pa.int64())],
                names=["w", "toxic", "h"],
            )

    try:
        total = {r.toxic: r["count"] for r in rows.where("fit = 1").groupBy("toxic").count().collect()}
        pos, neg = total.get(1, 0), total.get(0, 0)
        if not pos or not neg:
            return Model([b"landmark"], np.zeros(1), 0.0, np.zeros(1), np.array([0.05 if neg else 0.95 if pos else 0.5]))
        words = rows.where("fit = 1").select("doc_id", "text", "toxic", F.xxhash64("text").alias("h")).mapInArrow(bags, "w binary, toxic int, h long").distinct()
        # copies count once; the lists hold at most ``sample`` hashes
        words = words.groupBy("w").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"), F.collect_list(F.when(F.col("toxic") == 1, F.col("h"))).alias("docs")).persist()
        # so many toxic documents that chance gives hardly one such word among all that there are
        bound = math.log(CHANCE / max(1, words.where("n > 1").count()))
        least = max(2, math.ceil(bound / math.log(pos / (pos + neg))))
        rich = words.where(f"p >= {least} and (n - p) * 4 <= p").orderBy(F.desc("p"), "w").limit(CANDIDATES).collect()
        odds = math.log(pos / (pos + neg))
        sure = [r for r in rich if _choices(r.n, r.p) + r.p * odds <= bound]
        toxic = _cover({bytes(r.w): frozenset(r.docs) for r in sure}, {bytes(r.w): 4 * (r.n - r.p) for r in sure})
        near = Kernel(toxic or [b"landmark"])
        common = [bytes(r.w) for r in words.where("p * 10 < n").orderBy(F.desc("n"), "w").limit(CANDIDATES).select("w").collect()]
        alike = near.values(common)
        plain = [w for w in common if w in alike][:PLAIN_LANDMARKS]
        words.unpersist()
        landmarks = [*toxic, *plain] or [b"landmark"]
        kernel = Kernel(landmarks)
        weight = np.array([1.0] * len(toxic) + [-0.2] * (len(landmarks) - len(toxic)), np.float32)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pooler = Pooler(kernel)
            for part in steps(batches, "text"):
                out = []
                for x in pooler.pool(encoded(part.column(1))):
                    top = np.argsort(-(x @ weight), kind="stable")[:SENTENCES]
                    out.append((x[top] if len(x) else np.zeros((1, len(landmarks)), np.float32)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(out, pa.binary())], names=["doc_id", "toxic", "fit", "x"])

        got = sorted(rows.mapInArrow(vectors, "doc_id long, toxic int, fit int, x binary").collect(), key=lambda r: (r.doc_id, r.toxic, r.x))
    finally:
        rows.unpersist()
    every = [np.frombuffer(r.x, np.float32).reshape(-1, len(landmarks)) for r in got]
    labels, fit = np.array([1 if r.toxic else -1 for r in got]), np.array([r.fit for r in got]) > 0
    x, y = [v for v, f in zip(every, fit, strict=True) if f], labels[fit]
    gram = np.array([kernel_row for kernel_row in _gram(kernel)], np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    witness = [0] * len(x)
    for _ in range(4):
        bag = [v[sorted({k, *np.flatnonzero(v[:, : len(toxic)].max(1) >= SURE)})] if t > 0 and toxic else v for v, k, t in zip(x, witness, y, strict=True)]
        rows_y = np.repeat(y, [len(b) for b in bag])
        c = np.full(len(rows_y), COST)
        w, bias = _svm(np.concatenate(bag) @ root, rows_y, c)
        weights = root @ w
        again = [int(np.argmax(v @ weights)) for v in x]
        if again == witness:
            break
        witness = again
    model = Model(landmarks, weights, bias, np.zeros(1), np.zeros(1))
    apart = ~fit if min((labels[~fit] > 0).sum(), (labels[~fit] < 0).sum()) >= ENOUGH else np.ones(len(fit), bool)
    model.margins, model.shares = _calibrate(model.margin([v for v, f in zip(every, apart, strict=True) if f]), labels[apart])
    return model


def _choices(n: int, k: int) -> float:
    """Logarithm of the number of ways to choose k of n."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _cover(docs: dict[bytes, frozenset[int]], cost: dict[bytes, int]) -> list[bytes]:
    """Words in the order in which they reach most documents that were reached fewer than COVER times, less their cost."""
    reached: dict[int, int] = {}
    left, out = dict(docs), []
    gain = {w: len(d) - cost[w] for w, d in left.items()}
    while left and len(out) < TOXIC_LANDMARKS:
        w = max(left, key=lambda x: (gain[x], x))
        while True:  # gains only fall: count again until the best stays best
            gain[w] = sum(reached.get(d, 0) < COVER for d in left[w]) - cost[w]
            again = max(left, key=lambda x: (gain[x], x))
            if again == w:
                break
            w = again
        if gain[w] < 2:
            break
        own = left.pop(w)
        if any((w.startswith(x) or x.startswith(w)) and 10 * len(own & docs[x]) >= 9 * max(len(own), len(docs[x])) for x in out):
            continue  # the stem of a landmark, or the word of one, in the same documents
        out.append(w)
        for d in own:
            reached[d] = reached.get(d, 0) + 1
    return out


def _gram(kernel: Kernel) -> Iterator[np.ndarray]:
    own = kernel.values(kernel.landmarks)
    for w in kernel.landmarks:
        yield own.get(w, np.zeros(len(kernel.landmarks), np.float32))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, score; one per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(Kernel(model.landmarks))
        for part in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(pooler.pool(encoded(part.column(1)))), pa.float64())], names=["doc_id", "score"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` that score below ``threshold``, as they were. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(Kernel(model.landmarks))
        for part in steps(batches, text_col):
            scores = model.scores(pooler.pool(encoded(part.column(part.schema.get_field_index(text_col)))))
            yield part.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train_on_labels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on labelled documents that are not held out (crc32 of the id as text, modulo 3, is 1)."""
    small = labels.where("toxic is not null").where(~held_out()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    return train(documents.select("doc_id", "text").join(F.broadcast(small), "doc_id"), sample)  # at most ``sample`` rows

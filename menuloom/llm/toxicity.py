"""Toxicity scores from gradient-boosted trees over dense features of a text, made
probabilities by isotonic calibration.

Features: densities and sums of lexicon words, their densest stretch, nearness to words in
the second person, and rates of capitals, punctuation, digits and obfuscated words.
The lexicon is learnt: words and stems that toxic labelled documents have far more
often than others, with their log odds. Copies of one text count once in it. Spelling tricks (digits and signs for letters, repeated
letters) are undone before a word is looked up.

Everything that uses labels is learnt from about ``SAMPLE`` labelled rows that aren't held
out (those whose digest of the id is lowest). Their texts are read whole; the driver
gets word counts cut to the lexicon's size and one short feature row a document.
Lexicon and trees are cross-fitted: a half of the sample is scored with what the other
half taught, and the calibration is fitted on those scores.

Cases: null and empty texts get the score of a text without words; without a
labelled row, or with one class only, scores are the share of toxic rows (0 without
rows); several labels of an id count as toxic if one is; labels that are null or of
unknown ids are ignored; null ids are held out; repeated rows are scored each."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField

from menuloom.session import reliable_checkpoint

from .common import arrived, map_texts, rewrite_texts, travelling, utf8
from .language import held_out

#: Labelled rows that are learnt from, about.
SAMPLE = 20_000
#: Entries of the lexicon: words, and stems (first letters of longer words).
LEXICON = 1_000
STEMS = range(3, 8)
#: Words whose entry one task remembers.
REMEMBERED = 500_000
THRESHOLD = 0.3
#: Words in a stretch, and words between a lexicon word and a second person.
STRETCH, REACH = 40, 4
# Words in the second person (fixed values).
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr tú ti usted ustedes vosotros tus".split())
# Letters that digits and signs stand for (fixed values).
_SWAPS = bytes.maketrans(b"013457@$!", b"oieastasi")
_SPLIT = bytes(c if chr(c).isalnum() or c in b"@$!'*" or c >= 0x80 else 32 for c in range(128)) + bytes(range(128, 256))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TRICK = re.compile(rb"[a-z][0-9@$!*]+[a-z]")
_TWICE = re.compile(rb"(.)\1{2,}")
N_FEATURES = 14


def plain_words(text: str | None) -> list[bytes]:
    return [w.strip(b"'!*@$") for w in utf8(text.lower()).translate(_SPLIT).split()] if text else []


def undone(word: bytes) -> bytes:
    """A word without spelling tricks."""
    return _TWICE.sub(rb"\1", word.translate(_SWAPS).replace(b"*", b""))


def entries_of(word: str) -> list[str]:
    """The word, and its stems with a mark."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class Lexicon:
    """Log odds of a word: those of its strongest entry, 0 without one. Answers are
    remembered in a table of bounded size."""

    def __init__(self, entries: dict[str, float]) -> None:
        self.entries, self.known = entries, {}

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "known": {}}

    def look_up(self, word: bytes) -> float:
        found = max((self.entries.get(e, 0.0) for e in entries_of(word.decode("utf-8", "replace"))), default=0.0)
        if not found and not word.isalpha() and _TRICK.search(word):
            found = max(self.entries.get(e, 0.0) for e in entries_of(undone(word).decode("utf-8", "replace")))
        return found

    def values(self, words: list[bytes]) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = self.look_up(w)
        return [known[w] for w in words]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    raw = utf8(text) if text else b""
    words = plain_words(text)
    n = max(1, len(words))
    tricks = sum(1 for w in words if not w.isalpha() and _TRICK.search(w))
    each = np.array(lexicon.values(words))
    at = np.flatnonzero(each).tolist()
    value = each[at]
    total = float(value.sum())
    stretch, near = 0.0, 0
    if at:
        place = np.array(at)
        sums = np.append(0, np.cumsum(value))
        stretch = float((sums[np.searchsorted(place, place + STRETCH)] - sums[:-1]).max())
        near = sum(any(x in SECOND_PERSON for x in words[max(0, i - REACH) : i + REACH + 1]) for i in at)
    letters = max(1, len(raw))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    digits = len(raw) - len(raw.translate(None, _DIGIT))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    return [
        float(np.log1p(len(words))), total, total / n, len(at) / n, float(len({words[i] for i in at})), float((value > 3).sum()),
        float(value.max()) if at else 0.0, stretch, near / max(1, len(at)), capitals / letters, marks / letters, raw.count(b"!") / n,
        digits / letters, tricks / n,
    ]


class Trees:
    """Boosted regression trees on binned features, with the logistic loss."""

    def __init__(self, count: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0) -> None:
        self.count, self.depth, self.rate, self.bins, self.least = count, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        marks = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, marks, method="nearest")) for c in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-margin))
            tree: list = []
            margin += self._grow(tree, binned, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), 0, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> np.ndarray:
        """Appends the node of ``rows`` and what is below it to ``tree``."""
        at, whole_g, whole_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append(None)
        best = (1e-6, -1, -1)
        if depth < self.depth:
            for j in range(b.shape[1]):
                n = len(self.cuts[j]) + 1
                left_g = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                left_h = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                ok = (left_h >= self.least) & (whole_h - left_h >= self.least)
                if ok.any():
                    gain = left_g**2 / (left_h + 1) + (whole_g - left_g) ** 2 / (whole_h - left_h + 1) - whole_g**2 / (whole_h + 1)
                    k = int(np.argmax(np.where(ok, gain, -1)))
                    best = max(best, (float(gain[k]), -j, k)) if ok[k] and gain[k] > best[0] else best
        if best[2] < 0:
            value = self.rate * whole_g / (whole_h + 1)
            tree[at] = (-1, 0, 0, 0, value)
            out[rows] = value
            return out
        j, k = -best[1], best[2]
        low = b[rows, j] <= k
        left = len(tree)
        self._grow(tree, b, g, h, rows[low], depth + 1, out)
        right = len(tree)
        self._grow(tree, b, g, h, rows[~low], depth + 1, out)
        tree[at] = (j, k, left, right, 0.0)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bin(x), np.full(len(x), self.start)
        for tree in self.trees:
            self._walk(tree, 0, b, np.arange(len(x)), out)
        return out

    def _walk(self, tree: list, at: int, b: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not len(rows):
            return
        j, k, left, right, value = tree[at]
        if j < 0:
            out[rows] += value
        else:
            low = b[rows, j] <= k
            self._walk(tree, left, b, rows[low], out)
            self._walk(tree, right, b, rows[~low], out)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function nearest to y, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], s)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Lexicon, trees and calibration points; without trees a constant."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, points: tuple[np.ndarray, np.ndarray], constant: float = 0.0) -> None:
        self.lexicon, self.trees, self.points, self.constant = lexicon, trees, points, constant

    def scores(self, texts: list) -> list[float]:
        if self.trees is None:
            return [self.constant] * len(texts)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]).reshape(-1, N_FEATURES))
        return np.clip(np.interp(margin, *self.points), 0, 1).tolist()


def lexicon_of(toxic: np.ndarray, other: np.ndarray, names: list[str], n_toxic: int, n_other: int) -> Lexicon:
    """The entries whose log odds are surely highest, with these."""
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((other + 0.5) / (n_other - other + 0.5))
    sure = odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    best = [i for i in np.argsort(-sure, kind="stable")[:LEXICON] if sure[i] > 0.5 and toxic[i] >= 3]
    return Lexicon({names[i]: float(odds[i]) for i in best})


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled rows for which ``learn`` (an expression over
    the id) holds."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & learn).groupBy(doc_id).agg(F.max(F.col(toxic).cast("int")).alias("__toxic"))
    n = known.count()
    if not n:
        return Model(Lexicon({}), None, ([], []))
    part = int(min(1.0, sample / n) * (1 << 30))
    few = known.where(F.pmod(F.xxhash64(F.lit("tox"), doc_id), F.lit(1 << 30)) < part).limit(2 * sample)
    # About ``sample`` rows of an id and a number: bounded, so it may be sent to all tasks. Of
    # rows with one id the one whose text has the smallest hash stands for all.
    rows = docs.select(doc_id, text).join(F.broadcast(few), doc_id).groupBy(doc_id, "__toxic").agg(F.min_by(text, F.xxhash64(text)).alias(text)).withColumn("__half", F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int"))
    rows = reliable_checkpoint(rows)

    def word_sets() -> Callable[[list], list]:
        each = lambda t: sorted({e for w in set(plain_words(t)) for e in entries_of(w.decode("utf-8", "replace"))})
        return lambda texts: [[each(t) for t in texts]]

    once = rows.dropDuplicates(["__toxic", "__half", text])
    words = map_texts(once, ["__toxic", "__half"], [StructField("words", ArrayType(StringType()))], word_sets, text)
    sizes = {(r["__toxic"], r["__half"]): r["count"] for r in once.groupBy("__toxic", "__half").count().collect()}
    cell = [(t, h) for t in (1, 0) for h in (0, 1)]
    count = lambda t, h: F.sum(F.when((F.col("__toxic") == t) & (F.col("__half") == h), 1).otherwise(0))
    counted = words.select("__toxic", "__half", F.explode("words").alias("word")).groupBy("word").agg(*(count(t, h).alias(f"c{t}{h}") for t, h in cell))
    n1, n0 = (sum(v for (t, _), v in sizes.items() if (t == 1) == want) for want in (True, False))
    if not n1 or not n0:
        return Model(Lexicon({}), None, ([], []), 1.0 if n1 else 0.0)
    # The surest entries of the whole sample; a multiple is enough for the halves too.
    a, b = F.col("c10") + F.col("c11") + 0.5, F.col("c00") + F.col("c01") + 0.5
    sure = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b)) - 1.64 * F.sqrt(1 / a + 1 / b)
    top = counted.where("c10 + c11 >= 3").withColumn("sure", sure).where("sure > 0").orderBy(F.desc("sure"), "word").limit(5 * LEXICON).toPandas()
    names = list(top["word"])
    c = {(t, h): top[f"c{t}{h}"].to_numpy(float) for t, h in cell}
    size = lambda t, h: sizes.get((t, h), 0)
    half = [lexicon_of(c[1, h], c[0, h], names, size(1, h), size(0, h)) for h in (0, 1)]
    full = lexicon_of(c[1, 0] + c[1, 1], c[0, 0] + c[0, 1], names, n1, n0)

    def made() -> Callable[[list], list]:
        return lambda texts: [[features(t, half[0]) for t in texts], [features(t, half[1]) for t in texts]]

    fields = [StructField("by0", ArrayType(DoubleType())), StructField("by1", ArrayType(DoubleType()))]
    got = map_texts(rows, [doc_id, "__toxic", "__half"], fields, made, text).toPandas().sort_values(doc_id, kind="stable")
    y, side = got["__toxic"].to_numpy(float), got["__half"].to_numpy(int)
    # A row's features come from the lexicon of the other half.
    x = np.where((side == 0)[:, None], np.stack(got["by1"]), np.stack(got["by0"])).reshape(-1, N_FEATURES)
    trees = Trees().fit(x, y)
    margin = np.full(len(y), trees.start)
    for h in (0, 1):
        if (side == h).any() and 0 < y[side != h].sum() < (side != h).sum():
            margin[side == h] = Trees().fit(x[side != h], y[side != h]).margin(x[side == h])
        else:
            margin[side == h] = trees.margin(x[side == h])
    return Model(full, trees, isotonic(margin, y))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with score and predicted; no shuffle."""
    sent = travelling(docs.sparkSession, model)

    def make() -> Callable[[list], list]:
        own = arrived(sent)

        def work(texts: list) -> list:
            s = own.scores(texts)
            return [s, [int(v >= threshold) for v in s]]

        return work

    return map_texts(docs, keep, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], make, text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 4, part: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    out = held_out(doc_id, parts, part)
    model = train(docs, labels, ~out, doc_id, text)
    return score(docs, model, [doc_id], text).select(doc_id, out.alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int = 4, part: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, unchanged."""
    sent = travelling(docs.sparkSession, train(docs, labels, ~held_out(doc_id, parts, part), doc_id, text))

    def make() -> Callable[[list], tuple[list, list]]:
        own = arrived(sent)
        return lambda texts: ([s < threshold for s in own.scores(texts)], texts)

    return rewrite_texts(docs, make, text)

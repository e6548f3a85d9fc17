"""Language identification by error-correcting output codes: each language has a code
word, each bit of it is predicted by a binary classifier over character n-grams, and
the language whose code word loses least on all predictions is chosen. A few wrong
bits are outvoted; a small margin flags an ambiguous text.

Training takes rows with a language that aren't held out: a sample of about ``SAMPLE``
documents (those whose digest of the id is lowest), read whole. Their n-gram vectors are made
by the tasks; the driver fits one logistic model a bit on that bounded matrix. Everything
else covers all documents.

Cases: a text that is null or has no letter gets ``und`` with score 0; without any
labelled row all texts do; with one known language it is always predicted, with score 1;
null ids are held out; repeated rows are predicted each; whole texts are read."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField

from .common import arrived, map_texts, mix, odd_numbers, travelling

#: Documents of the training sample, about.
SAMPLE = 3_000
#: Slots of hashed n-grams.
SLOTS = 2048
SIZES = (2, 3)
#: A score below this flags an ambiguous text.
MARGIN = 0.6
UNDETERMINED = "und"

_ODD = odd_numbers(4, 7)


def _letters_below(limit: int) -> np.ndarray:
    """Lower-cased code point of each letter, a blank for everything else."""
    out = np.full(limit, 32, np.uint32)
    for c in range(limit):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD = _letters_below(0x10000)


def folded(text: str) -> np.ndarray:
    """Code points with letters lower-cased and everything else as single blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return c
    high = c >= 0x10000
    out = _FOLD[np.where(high, 0, c)]
    if high.any():
        kinds = {x: unicodedata.category(chr(x))[0] == "L" for x in set(c[high].tolist())}
        out[high] = [x if kinds[x] else 32 for x in c[high].tolist()]
    blank = out == 32
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    return out[keep]


def ngram_vector(text: str | None, slots: int = SLOTS) -> np.ndarray | None:
    """Root of the relative counts of hashed n-grams, of unit length; None without letters."""
    c = folded(text) if text else np.zeros(0, np.uint32)
    if not len(c) or not (c != 32).any():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    counts = np.zeros(slots)
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, np.uint64(n))
        for j in range(n):
            h = h * _ODD[0] + c[j : len(c) - n + 1 + j] * _ODD[1]
        counts += np.bincount((mix(h) >> np.uint64(40)).astype(np.int64) % slots, minlength=slots)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def code_words(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n classes. Up to six classes get all distinct
    splits; more get fixed pseudo-random columns, in which no two rows are near."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if i and s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], float)
    width = int(12 * np.ceil(np.log2(n))) + 3
    bits = mix(np.arange(n * width, dtype=np.uint64) + np.uint64(77)) >> np.uint64(63)
    code = np.where(bits.reshape(n, width) == 1, 1.0, -1.0)
    return code[:, np.abs(code.sum(axis=0)) < n]


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 200, rate: float = 8.0, shrink: float = 1e-5) -> np.ndarray:
    """Weights (slots + 1 by bits) of one logistic model a bit, by accelerated descent.
    Classes count alike, however many rows they have."""
    share = 1.0 / np.bincount(y, minlength=len(code))[y]
    share /= share.sum()
    target = code[y]
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    share, target = share.astype(np.float32), target.astype(np.float32)
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    ahead, old = w.copy(), w
    for i in range(rounds):
        loss = target / (1 + np.exp(np.clip(target * (x1 @ ahead), -50, 50)))
        new = ahead + rate * (x1.T @ (share[:, None] * loss)) - rate * shrink * ahead
        ahead, old = new + i / (i + 3) * (new - old), new
    return old.astype(np.float64)


class Decoder:
    """Code words, bit models and the weight of each bit's vote."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray) -> None:
        self.languages, self.code, self.weights = languages, code, weights

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the least loss, and its share of exp(-loss)."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        value = x @ self.weights[:-1] + self.weights[-1]
        # Logistic loss of every bit against every code word, weighed by the bit's surety.
        vote = np.abs(np.tanh(value / 2))
        loss = (vote[:, None, :] * np.logaddexp(0, -self.code[None, :, :] * value[:, None, :])).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """crc32 of the id's text modulo ``parts`` is ``part``; ids that are null are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(True))


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Decoder | None:
    """A decoder from about ``sample`` rows for which ``learn`` holds."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    few = rows.where(F.pmod(F.xxhash64(F.lit("lang"), doc_id), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)
    fields = [StructField("slot", ArrayType(IntegerType())), StructField("value", ArrayType(FloatType()))]

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            made = [ngram_vector(t) for t in texts]
            at = [None if v is None else np.flatnonzero(v) for v in made]
            return [at, [None if a is None else v[a] for v, a in zip(made, at)]]

        return work

    got: pd.DataFrame = map_texts(few, [doc_id, lang], fields, make, text).where("slot IS NOT NULL").toPandas().sort_values([doc_id], kind="stable")
    if not len(got):
        return None
    x = np.zeros((len(got), SLOTS), np.float32)
    for i, (at, value) in enumerate(zip(got["slot"], got["value"])):
        x[i, at] = value
    languages = sorted(got[lang].unique())
    y = np.searchsorted(languages, got[lang].to_numpy())
    code = code_words(len(languages))
    return Decoder(languages, code, fit_bits(x, y, code) if len(languages) > 1 else np.zeros((SLOTS + 1, 0)))


def predict(docs: DataFrame, decoder: Decoder | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and ambiguous; no shuffle."""
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    sent = travelling(docs.sparkSession, decoder)

    def make() -> Callable[[list], list]:
        model = arrived(sent)

        def work(texts: list) -> list:
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if model is not None:
                made = [ngram_vector(t) for t in texts]
                fit = [i for i, v in enumerate(made) if v is not None]
                if fit:
                    best, score = model.decide(np.stack([made[i] for i in fit]))
                    for i, b, s in zip(fit, best.tolist(), score.tolist()):
                        names[i], scores[i] = model.languages[b], min(1.0, s)
            return [names, scores, [s < MARGIN for s in scores]]

        return work

    return map_texts(docs, keep, fields, make, text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 3, part: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, ambiguous)."""
    out = held_out(doc_id, parts, part)
    decoder = train(docs, ~out, doc_id, text, lang)
    return predict(docs, decoder, [doc_id], text).select(doc_id, out.alias("held_out"), "lang_pred", "score", "ambiguous")

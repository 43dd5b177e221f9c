"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of the codewords is a two-class problem that one linear classifier on hashed
character n-grams learns. A text's margins on all bits are compared with each codeword by the logistic loss, and the
language of the least total loss wins (loss-weighted decoding; each bit's loss is weighted by that bit's accuracy on
rows that it was not fitted on). Where the two nearest codewords are close, the text is flagged as ambiguous.

n-grams are of the letters of the whole, lower-cased text; runs of anything else count as one space. Up to six languages
get the exhaustive code, more get random words with a large least distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.llm.common import arrow_map, fetched, fold, stored, texts_of

#: Buckets of the n-gram hash, and the orders of the n-grams.
BUCKETS, ORDERS = 1 << 13, (1, 2, 3)
#: Characters of a part of a text that is counted at once; the counts of all parts add up.
PART = 1 << 18


def _letter_table() -> np.ndarray:
    """A code for each code point of the basic plane: 0 if it is no letter, else that of its lower case."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0]) if len(low) == 1 else c
    return out


_letters: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The codes of the text's letters, with one 0 for each run of other characters."""
    if not _letters:
        _letters.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    beyond = points > 0xFFFF
    codes = _letters[0][np.minimum(points, 0xFFFF)]
    if beyond.any():
        codes = codes.copy()
        codes[beyond] = [c if chr(c).isalpha() else 0 for c in points[beyond].tolist()]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def features(text: str) -> np.ndarray | None:
    """Normalised square roots of the n-gram counts; None for a text without a letter."""
    counts = np.zeros(BUCKETS)
    found = False
    for k in range(0, len(text), PART):
        codes = letters(text[max(0, k - max(ORDERS) + 1) : k + PART]) if k else letters(text[:PART])
        if not codes.any():
            continue
        found = True
        padded = np.concatenate([[0], codes, [0]]).astype(np.uint64)
        rolled = np.zeros(len(padded), np.uint64)
        for n in ORDERS:
            rolled = (rolled[: len(padded) - n + 1] * np.uint64(1_000_003) + padded[n - 1 :]) if n > 1 else padded
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(64 - 13)).astype(np.int64), minlength=BUCKETS)
    if not found:
        return None
    root = np.sqrt(counts)
    return (root / np.sqrt(counts.sum())).astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """classes x bits of -1 and 1; each bit has both values."""
    if classes <= 6:
        rows = [[(n >> (classes - 1 - c)) & 1 for n in range(1, 1 << (classes - 1))] for c in range(classes)]
        return np.array(rows, float) * 2 - 1
    random, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        code = random.integers(0, 2, (classes, bits)) * 2.0 - 1
        if (abs(code.sum(0)) == classes).any():
            continue
        least = int(min((code[a] != code[b]).sum() for a in range(classes) for b in range(a)))
        if least > far:
            best, far = code, least
    return best


class LanguageModel:
    """Codewords, one linear classifier for each bit, and the weights of the bits."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.trust = languages, code, weights.astype(np.float32), trust

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights[:-1] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword's number, its share among exp(-loss) of all codewords, and whether it is ambiguous."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        weight = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / weight.sum(1)
        return best, score, score < 0.5 + 0.25 * (len(self.languages) > 1)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; "und" with score 0 for one without a letter, or without a model."""
        rows = [features(t) for t in texts]
        there = [k for k, r in enumerate(rows) if r is not None]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if there and self.languages:
            best, score, unsure = self.decode(self.margins(np.stack([rows[k] for k in there])))
            for k, b, s, u in zip(there, best.tolist(), score.tolist(), unsure.tolist(), strict=True):
                out[k] = (self.languages[b], s, u)
        return out


def _fit_bits(rows: np.ndarray, signs: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression of all bits at once, by accelerated gradient steps."""
    design = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    w = np.zeros((design.shape[1], signs.shape[1]), np.float32)
    ahead, rate = w.copy(), np.float32(2.0)  # rows have length 1, so the loss is smooth enough for this rate
    for k in range(rounds):
        slope = -signs / (1 + np.exp(np.clip(signs * (design @ ahead), -30, 30)))
        new = ahead - rate * (design.T @ slope.astype(np.float32) / len(rows) + np.float32(ridge) * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    """Fit on all rows; the trust in each bit comes from a fit on three quarters of them, judged on the rest."""
    pairs = [(f, lang) for f, lang in ((features(t), lang) for t, lang in zip(texts, labels, strict=True)) if f is not None]
    languages = sorted({lang for _, lang in pairs})
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((len(languages), 1)), np.zeros((BUCKETS + 1, 1)), np.ones(1))
    rows, code = np.stack([f for f, _ in pairs]), codewords(len(languages))
    signs = code[[languages.index(lang) for _, lang in pairs]].astype(np.float32)
    apart = np.arange(len(rows)) % 4 == 3
    trial = _fit_bits(rows[~apart], signs[~apart], 100) if apart.any() else None
    trust = np.ones(code.shape[1])
    if trial is not None:
        right = ((rows[apart] @ trial[:-1] + trial[-1]) * signs[apart] > 0).mean(0)
        trust = np.maximum(2 * right - 1, 0.05)
    return LanguageModel(languages, code, _fit_bits(rows, signs), trust / trust.mean())


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 400, rows: int = 80_000) -> LanguageModel:
    """Train on at most per_language documents of each language, fewer if there are so many languages that they would be more than rows in all.

    Documents are taken in the order of a hash of the id, and SAMPLE_BYTES of text at most. The ids are found on narrow
    rows, of which each language first keeps those with a small hash; only the chosen texts come to the driver. A
    document is an id with a language: of rows that repeat it the first text by order counts.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (usable if usable is not None else F.lit(True)))
    narrow = named.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = stored(narrow.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return train([], [])
    most = max(1, min(per_language, rows // languages))
    # about twice as many as wanted, and a few more, pass by their hash; rows repeat an id at will and are made distinct
    small = F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < (2.0 * most + 50) / F.col("n")
    some = narrow.join(F.broadcast(counts) if languages <= rows else counts, "lang").where(small).select("doc_id", "lang", "h").distinct()
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= most).select("doc_id", "lang")
    texts = named.select("doc_id", "text", "lang").join(F.broadcast(some), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = fetched(texts.select("doc_id", "text", F.col("lang").alias("label")))
    return train([r["text"] or "" for r in found], [r["label"] for r in found])


def predict_table(docs: DataFrame, model: LanguageModel, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): every row in one pass. A null id is not held out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = texts_of(batch), []
        for k in range(0, len(texts), 128):  # bounds the matrix of features
            found += model.predict(texts[k : k + 128])
        names, scores, unsure = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"))
    return arrow_map(marked, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")

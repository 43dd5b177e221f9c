"""Toxicity: a sparse linear classifier with counterfactual regularisation.

A text is the set of its lower-cased words and of their beginnings, hashed. Logistic regression with an L1 penalty is fitted on labelled
documents. For each sentence of these that names a group, every identity term is swapped for others of its set; a sentence
that names none gets a term put into it. The loss has a penalty on the squared change of the score between the sentence
and its changed form. Words that only mark a group thus lose their weight, as do beginnings that they share with
other words, and a neutral mention doesn't raise the score, whatever the toxic examples are about.

The fit takes a bounded sample of labelled rows; each text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm.common import arrow_map, fetched, fold, labelled_sample, texts_of

#: Sets of terms that a sentence may swap within.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("immigrant", "native", "refugee", "foreigner", "citizen"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
BUCKETS = 1 << 20
#: Words that a worker keeps at most.
KNOWN_WORDS = 200_000
_word = re.compile(r"\w+")
_sentence = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its beginnings of 3 to 7 letters, which find inflected and compound forms."""
    raw = [word] + ["^" + word[:n] for n in range(3, min(7, len(word)) + 1)]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw)


def word_ids(text: str) -> np.ndarray:
    """The sorted, distinct buckets of a text's words and their beginnings."""
    return np.array(sorted({i for w in set(_word.findall(text.lower())) for i in features_of(w)}), np.int64)


def swaps(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[list[str], list[str]]]:
    """For each sentence the words that go and that come: with an identity term, for each of three shifts within the terms' sets; without, one of all terms comes, by a hash of the sentence."""
    place = {w: (own, k) for own in terms for k, w in enumerate(own)}
    every = [w for own in terms for w in own]
    out = []
    for sentence in _sentence.findall(text.lower()):
        words = _word.findall(sentence)
        named = sorted({w for w in words if w in place})
        if not named:
            if words and every:
                out.append(([], [every[zlib.crc32(sentence.encode("utf-8", "replace")) % len(every)]]))
            continue
        for shift in (1, 2, 3):
            come = [place[w][0][(place[w][1] + shift) % len(place[w][0])] for w in named]
            out.append((named, come))
    return out


class ToxicityModel:
    def __init__(self, weights: dict[int, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept  # of the buckets that have a weight
        self.known: dict[str, tuple[int, ...]] = {}  # words met before, with those of their buckets that have a weight

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def scores(self, texts: list[str]) -> np.ndarray:
        weights, known, z = self.weights, self.known, []
        for text in texts:
            used: set[int] = set()
            for word in set(_word.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    own = known[word] = tuple(i for i in features_of(word) if i in weights)
                if own:
                    used.update(own)
            z.append(self.intercept + sum(weights[i] for i in sorted(used)))
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def train(texts: list[str], labels: list[int], terms=IDENTITY_TERMS, counterfactual: float = 1.0, sparsity: float = 1e-3, least_docs: int = 3, rounds: int = 200) -> ToxicityModel:
    """Proximal gradient steps with momentum. With one label alone the score is that label's share, softened."""
    y = np.array(labels, float)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(labels)) < 2:
        return ToxicityModel({}, base)
    own = [word_ids(t) for t in texts]
    # the change of a linear score depends on the words that go and come alone, so equal swaps are one with a weight
    counted = Counter((tuple(gone), tuple(come)) for t in texts for gone, come in swaps(t, terms))
    pairs, often = list(counted), np.array(list(counted.values()), float)
    vocabulary, counts = np.unique(np.concatenate(own), return_counts=True)
    named = np.unique([i for s in terms for w in s for i in features_of(w)])
    vocabulary = np.union1d(vocabulary[counts >= least_docs], named)
    size = len(vocabulary)

    def rows_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.array([], np.int64)
        at = np.minimum(np.searchsorted(vocabulary, flat), size - 1)
        there = vocabulary[at] == flat
        return row[there], at[there]

    row, col = rows_of(own)
    crc = lambda words: np.array(sorted({i for w in words for i in features_of(w)}), np.int64)
    gone_row, gone_col = rows_of([crc(a) for a, _ in pairs])
    come_row, come_col = rows_of([crc(b) for _, b in pairs])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels count alike
    w, b = np.zeros(size), 0.0
    ahead_w, ahead_b, pull = w.copy(), b, counterfactual * often / max(1.0, often.sum())
    # a bound of the curvature: of the loss, and of the penalty, from the longest rows
    curvature = 0.25 * (np.bincount(col, weights=weight[row], minlength=size).max() * np.bincount(row, minlength=len(y)).max() ** 0.5 + 1) + 16 * np.bincount(np.concatenate([gone_col, come_col]), weights=np.concatenate([pull[gone_row], pull[come_row]]), minlength=1).max()
    rate = 1 / curvature
    for k in range(rounds):
        z = np.bincount(row, weights=ahead_w[col], minlength=len(y)) + ahead_b
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, weights=slope[row], minlength=size)
        if pairs:
            change = pull * (np.bincount(come_row, weights=ahead_w[come_col], minlength=len(pairs)) - np.bincount(gone_row, weights=ahead_w[gone_col], minlength=len(pairs)))
            grad += 2 * (np.bincount(come_col, weights=change[come_row], minlength=size) - np.bincount(gone_col, weights=change[gone_row], minlength=size))
        new_w = ahead_w - rate * grad
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * sparsity, 0)
        new_b = ahead_b - rate * slope.sum()
        momentum = k / (k + 3)
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    # the threshold 0.5 at the place that separates the labels best, as both count alike
    z = np.bincount(row, weights=w[col], minlength=len(y)) + b
    used = np.flatnonzero(w)
    return ToxicityModel(dict(zip(vocabulary[used].tolist(), w[used].tolist(), strict=True)), b + _shift(z, y))


def _shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add so that 0 lies midway in the gap that separates the labels best; a share of false alarms weighs as three of misses."""
    cuts = np.unique(z)
    if len(cuts) < 2:
        return 0.0
    middle = (cuts[1:] + cuts[:-1]) / 2
    order = np.sort(z[y == 1]), np.sort(z[y == 0])
    wrong = np.searchsorted(order[0], middle) / len(order[0]) + 3 * (1 - np.searchsorted(order[1], middle) / len(order[1]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gaps = (cuts[1:] - cuts[:-1])[best]
    return -float(middle[best[gaps.argmax()]])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, usable: Column | None = None, label: str = "toxic", **options) -> ToxicityModel:
    """Train on at most per_class labelled documents of each label (and SAMPLE_BYTES of text), of those labels that ``usable`` allows."""
    rows = fetched(labelled_sample(docs, labels, label, per_class, usable if usable is not None else F.lit(True)))
    return train([r["text"] or "" for r in rows], [r["label"] for r in rows], **options)


def score_table(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row in one pass. A null id is not held out; an empty text scores the intercept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"))
    return arrow_map(marked, run, f"doc_id {kind}, held_out boolean, score double, predicted int")

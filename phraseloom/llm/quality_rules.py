"""Quality rules with an isolation forest on rule statistics.

Fixed rules reject a document with under 50 words, or with more than half of its words inside repeated 3-word windows.
For the rest an isolation forest decides: trees split random statistics of labelled good documents at random places; a
document that ends on short paths is unlike them. The threshold comes from labelled rows that the forest was not fitted
on (half of the good ones, all bad ones): of all thresholds at which at most ``clean_loss`` of these good documents would go,
the one that separates good from bad best. Without labelled rows of both kinds the forest rejects nothing.

Statistics are of whole texts and of all labelled documents; each tree draws its rows from all of the good half.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.llm.common import BROADCAST_BYTES, FIXED_WIDTH, WORD, arrow_map, labelled_ids, stored, texts_of

_word = re.compile(WORD)
#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_digits = b"0123456789"
_marks = b"!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """How many words lie in 3-word windows that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # words from covered on are not counted yet
    for k, w in enumerate(windows):
        if counts[w] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base statistics, and the vector that the forest sees."""
    words = _word.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _word.search(x)]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    share = lambda chosen: (size - len(raw.translate(None, chosen))) / size
    short = sum(1 for w in words if len(w) <= 3)
    vector = [
        chars / max(1, n), symbols / max(1, chars), duplicates / max(1, len(lines)), repeated / max(1, n),
        share(_upper), share(_digits), share(_marks), short / max(1, n), len(set(words)) / max(1.0, n**0.9), n / max(1, len(lines)),
    ]
    return [n, chars, symbols, duplicates, repeated], vector


def base_failed(base: list[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED_PERCENT * base[0]


class IsolationForest:
    """Trees over vectors, held as arrays: each node has a statistic, a split and two children, or is a leaf with a path length."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, margin: float = 1.0, seed: int = 11) -> None:
        self.margin = margin
        random = np.random.default_rng(seed)
        self.statistic: list[int] = []
        self.split: list[float] = []
        self.below: list[int] = []
        self.above: list[int] = []
        self.length: list[float] = []
        sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        self.mean = self._mean(sample)
        self.roots = [self._grow(rows[random.choice(len(rows), sample, replace=False)], 0, random) for _ in range(trees)]
        self.arrays = tuple(map(np.array, (self.statistic, self.split, self.below, self.above, self.length)))

    @staticmethod
    def _mean(n: int) -> float:
        """The mean path length of a search that fails in a binary tree of n."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, depth: int, random: np.random.Generator) -> int:
        at = len(self.statistic)
        self.statistic.append(0)
        self.split.append(np.inf)
        self.below.append(at)
        self.above.append(at)
        self.length.append(depth + self._mean(len(rows)))
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (0, 0)
        if depth < self.depth and len(rows) > 1:
            # a split may also fall beyond what good rows take, so that what lies there is cut off with nothing beside it
            k = int(random.integers(rows.shape[1]))
            cut = float(random.uniform(low[k] - self.margin, high[k] + self.margin))
            inside = rows[:, k] <= cut
            self.statistic[at], self.split[at] = k, cut
            self.below[at] = self._grow(rows[inside], depth + 1, random)
            self.above[at] = self._grow(rows[~inside], depth + 1, random)
        return at

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more anomalous."""
        statistic, split, below, above, length = self.arrays
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                at = np.where(rows[every, statistic[at]] <= split[at], below[at], above[at])
            total += length[at]
        return 2.0 ** -(total / len(self.roots) / max(self.mean, 1e-9))


class Scaler:
    """Statistics in units of the good rows' range, up to a few ranges beyond it."""

    def __init__(self, rows: np.ndarray) -> None:
        self.low, self.high = np.quantile(rows, [0.01, 0.99], axis=0)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        width = np.maximum(self.high - self.low, 1e-3)
        return np.clip((rows - self.low) / width, -3, 4)


class QualityModel:
    """A scaler, a forest and a threshold; without a forest nothing is rejected."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, clean_loss: float = 0.01) -> None:
        good, bad = vectors[labels == 1], vectors[labels == 0]
        self.forest: IsolationForest | None = None
        if len(good) >= 8 and len(bad):
            self.scaler = Scaler(good[::2])
            self.forest = IsolationForest(self.scaler(good[::2]))
            self.threshold = self._calibrate(self.forest.scores(self.scaler(good[1::2])), self.forest.scores(self.scaler(bad)), clean_loss)

    @staticmethod
    def _calibrate(good: np.ndarray, bad: np.ndarray, clean_loss: float) -> float:
        cuts = np.unique(np.concatenate([good, bad]))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        beyond = lambda x: (len(x) - np.searchsorted(np.sort(x), cuts, "left")) / len(x)
        lost, caught = beyond(good), beyond(bad)
        worth = np.where(lost <= clean_loss, caught - lost, -1)
        return float(cuts[int(worth.argmax())]) if worth.max() > 0 else 2.0

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return self.forest.scores(self.scaler(vectors)) if self.forest is not None else np.zeros(len(vectors))

    def rejects(self, scores: np.ndarray) -> np.ndarray:
        return scores >= self.threshold if self.forest is not None else np.zeros(len(scores), bool)


def fit(docs: DataFrame, labels: DataFrame, clean_loss: float = 0.01) -> QualityModel:
    """Fit on the statistics of all labelled documents; only their numbers, some 90 bytes a document, come to the driver.

    Texts aren't shuffled: where the labels are too many to be broadcast, statistics of all documents meet them. Of rows that repeat an id one counts.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(t) for t in texts_of(batch)]
        usable = pa.array([not base_failed(b) for b, _ in both])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), usable, pa.array([v for _, v in both], pa.list_(pa.float64()))], names=["doc_id", "usable", "vector"])

    own = stored(labelled_ids(labels, "quality", F.lit(True)), "labelled")
    few = own.count() * FIXED_WIDTH * len(own.columns) <= BROADCAST_BYTES
    texts = docs.select("doc_id", "text")
    seen = texts.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi") if few else texts
    found = arrow_map(seen, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, usable boolean, vector array<double>").where("usable")
    rows = found.groupBy("doc_id").agg(F.min("vector").alias("vector")).join(own, "doc_id").select(F.col("label").cast("int").alias("label"), "vector").toArrow()
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(rows), -1 if len(rows) else 0)
    order = np.lexsort(vectors.T) if len(rows) else np.array([], int)  # the fit doesn't depend on the order of the rows
    return QualityModel(vectors[order], rows.column("label").to_numpy()[order], clean_loss)


def score_table(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (double) and kept: one row for each row, in one pass.

    Null and empty texts have no words and so fail the base rules.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(t) for t in texts_of(batch)]
        scores = model.scores(np.array([v for _, v in both]))
        failed = np.array([base_failed(b) for b, _ in both])
        kept = ~failed & ~model.rejects(scores)
        columns = [pa.array([b[k] for b, _ in both], pa.int64()) for k in range(len(BASE))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed), pa.array(scores), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(t) for t in texts_of(batch)]
        failed = np.array([base_failed(b) for b, _ in both])
        return batch.filter(pa.array(~failed & ~model.rejects(model.scores(np.array([v for _, v in both])))))

    return arrow_map(docs, run, docs.schema)

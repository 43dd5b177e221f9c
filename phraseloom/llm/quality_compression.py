"""Quality by compression: how much better a text compresses with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from labelled good and bad documents, cut into pieces. A text is compressed with
each; the difference of the two sizes, divided by the size of the text, is the raw measure. A text is measured whole, in pieces of
bounded size, so that memory stays bounded and a very long text is not judged by its own repetition alone. A
monotone calibration (logistic, fitted on labelled rows that were not used for the dictionaries) maps it to 0..1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm.common import arrow_map, fetched, fold, labelled_sample, texts_of

#: Bytes of a piece, of a dictionary at most, and of the text that a dictionary is built from at most.
PIECE, DICTIONARY, MATERIAL = 1 << 10, 1 << 16, 8 << 20


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts; of the plain text itself where there is too little for the trainer."""
    whole = sum(len(t.encode("utf-8", "replace")) for t in texts)
    share = min(1.0, MATERIAL / max(1, whole))
    own, seen = [], 0
    for text in texts:
        for p in pieces(text):
            # beyond MATERIAL, pieces at even distances over all texts
            if int((seen + len(p)) * share / PIECE) > int(seen * share / PIECE) or share == 1:
                own.append(p)
            seen += len(p)
    size = sum(map(len, own))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1 << 10, size // 8)), own, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(own)[-DICTIONARY:]


class CompressionModel:
    """Two dictionaries and the calibration score = 1 / (1 + exp(-(slope * measure + intercept)))."""

    LEVEL = 3

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, intercept: float = 0.0) -> None:
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_own"}

    def _compressors(self):
        if not hasattr(self, "_own"):
            self._own = [
                zstandard.ZstdCompressor(level=self.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                if d else zstandard.ZstdCompressor(level=self.LEVEL)
                for d in (self.good, self.bad)
            ]
        return self._own

    def measure(self, text: str) -> float:
        """-1 to 1; 0 for the empty text; higher where the good dictionary fits better."""
        good, bad = self._compressors()
        a = b = size = 0
        for p in pieces(text):
            size += len(p)
            a += len(good.compress(p))
            b += len(bad.compress(p))
        return (b - a) / size if size else 0.0

    def measures(self, texts: list[str]) -> np.ndarray:
        return np.array([self.measure(t) for t in texts], float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.measures(texts) + self.intercept, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps, towards slightly softened labels, so that a clean split stays finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, width = x.mean(), max(x.std(), 1e-9)
    design = np.column_stack([(x - centre) / width, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def train(texts: list[str], labels: list[int]) -> CompressionModel:
    """Even rows make the dictionaries, odd rows the calibration. Without both labels the score is 0.5 throughout."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return CompressionModel(b"", b"")
    made = {k: [t for t, label, n in zip(texts, labels, _ranks(labels), strict=True) if label == k and n % 2 == 0] for k in (0, 1)}
    model = CompressionModel(dictionary(made[1]), dictionary(made[0]))
    odd = np.array([n % 2 == 1 for n in _ranks(labels)])
    if len(set(y[odd].tolist())) < 2:
        odd[:] = True
    model.slope, model.intercept = logistic(model.measures([t for t, o in zip(texts, odd, strict=True) if o]), y[odd].astype(float))
    return model


def _ranks(labels: list[int]) -> list[int]:
    """The number of each row among those of its label."""
    seen = {0: 0, 1: 0}
    out = []
    for label in labels:
        out.append(seen[label])
        seen[label] += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, usable: Column | None = None, label: str = "quality") -> CompressionModel:
    """Train on at most per_class labelled documents of each label (and SAMPLE_BYTES of text), of those labels that ``usable`` allows."""
    rows = fetched(labelled_sample(docs, labels, label, per_class, usable if usable is not None else F.lit(True)))
    return train([r["text"] or "" for r in rows], [r["label"] for r in rows])


def score_table(docs: DataFrame, model: CompressionModel, threshold: float, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row, one pass. A null id is not held out; empty texts get the score of measure 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"))
    return arrow_map(marked, run, f"doc_id {kind}, held_out boolean, score double, predicted int")

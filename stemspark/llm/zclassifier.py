"""Quality classifier by compression: one zstandard dictionary from good and one from bad labelled text; how much smaller
the good dictionary makes a text, per byte, becomes a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows per class that a fit takes at most (those with the smallest hash of doc_id): the bound of the sample.
SAMPLE_PER_CLASS = 2000
#: Bytes of the sample's texts at most: rows are taken, whole, in the order of that hash until the next one doesn't fit.
SAMPLE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
#: Texts are compressed in pieces of this size, so that the dictionary counts all through a long text.
PIECE_BYTES = 1024


def held_out(doc_id):
    """Rows whose labels a fit never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]  # from label 0, from label 1
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def __post_init__(self) -> None:
        self._packers = None

    def __getstate__(self):
        return self.dictionaries, self.weights, self.prior

    def __setstate__(self, state):
        self.dictionaries, self.weights, self.prior = state
        self._packers = None

    def difference(self, text: str | None) -> float | None:
        """(size with the bad dictionary - size with the good one) / bytes; null for no text."""
        if self._packers is None:
            args = {"level": 1, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **args) for d in self.dictionaries]
        data = (text or "").encode()
        if not data:
            return None
        bad, good = (sum(len(p.compress(x)) for x in pieces(data)) for p in self._packers)
        return (bad - good) / len(data)

    def scores(self, differences: list[float | None]) -> np.ndarray:
        """Probability of label 1; a text without bytes gets the prior."""
        x = np.array([np.nan if d is None else d for d in differences], float)
        known = 1 / (1 + np.exp(-np.clip(_basis(np.nan_to_num(x)) @ np.array(self.weights), -50, 50)))
        return np.where(np.isnan(x), self.prior, known)


def _basis(x: np.ndarray) -> np.ndarray:
    """1, the difference, and its part below zero: two slopes of one monotone curve."""
    return np.stack([np.ones_like(x), 10 * x, 10 * np.minimum(x, 0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    a, w = _basis(x), np.zeros(3)
    keep = ridge * np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(a.T @ (a * v[:, None]) + keep + 1e-9 * np.eye(3), a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1], w[1] + w[2]
    return tuple(w) if min(slopes) >= 0 else (w[0], max(w[1], 0.0), max(slopes[1], 0.0) - max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most per_class rows of each label (and SAMPLE_BYTES), whole texts, never on held-out rows.

    The class sizes that calibrate the prior are counted over all labelled rows that may be learnt from. Rows without a
    label, a doc_id or a text aren't learnt from; a doc_id labelled twice counts with its smallest label. A third of the
    sample builds the dictionaries, the rest calibrates. With a class empty the model gives every text the prior.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    marks = marks.where(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    order = F.xxhash64("doc_id")
    chosen = [marks.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    found = common.stored(texts.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "classifier-sample")
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy(order, "doc_id"))
    fitting = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= SAMPLE_BYTES // 2).select("doc_id")  # 2 * per_class sizes at most
    rows = found.join(F.broadcast(fitting), "doc_id").orderBy(order, "doc_id").collect()
    by = [[r["text"] for r in rows if r["y"] == y] for y in (0, 1)]
    if not by[0] or not by[1]:
        return Model((b"", b""), (float(np.log(prior / (1 - prior))), 0.0, 0.0), prior)
    cut = [max(1, len(b) // 3) for b in by]
    model = Model((_dictionary(by[0][: cut[0]]), _dictionary(by[1][: cut[1]])), (), prior)
    rest = [b[c:] or b for b, c in zip(by, cut, strict=True)]
    x = [model.difference(t) for b in rest for t in b]
    y = np.repeat([0.0, 1.0], [len(b) for b in rest])
    w = list(_logistic(np.array(x), y))
    w[0] += float(np.log(prior / (1 - prior)) - np.log(len(rest[1]) / len(rest[0])))  # the sample's class sizes aren't the labels'
    model.weights = tuple(float(v) for v in w)
    return model


def _dictionary(texts: list[str]) -> bytes:
    parts = [p for t in texts for p in pieces(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end is the dictionary
        return b"".join(parts)[-DICTIONARY_BYTES:]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), difference, for every document's whole text.

    Null and empty texts get the share of label 1 among the rows to learn from; null and repeated doc_ids are passed
    through; other columns are ignored. The model (two dictionaries, bounded) goes with the task.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [model.difference(t) for t in batch.column("text").to_pylist()]
            s = model.scores(d)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32)), "difference": pa.array(d, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, difference double")

"""Operator 7: quality by the votes of the nearest labelled documents.

Terms are words and the shapes of words (case, length class, what stands around them, whether they
repeat the word before), hashed to a fixed number of columns. Weighted counts of the labelled
sample are reduced to latent-semantic vectors by a truncated singular value decomposition. The
sample's vectors, whose size is bounded, go to every task; each document is projected, compared
with all of them by blocked products, and takes the labels of its nearest ones, weighted by cosine.

The fit sees at most ``SAMPLE`` labelled documents, never held-out ones. Every document is scored
over its whole text, within the scan. Documents without terms, and all documents if there are no
labels of both kinds, get the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import BYTE_VALUES, Rolling, blocks, id_and_text, utf8, word_bounds
from retailloom.llm.labelled import held_out, training_texts
from retailloom.session import materialise

SAMPLE = 4000
WORDS, SHAPES = 1024, 1024  # columns for words and for shapes
SHAPE_WEIGHT = 4.0
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3

_class = np.full(256, 5, np.uint8)  # marks
_class[48:58] = 1
_class[65:91] = 2
_class[97:123] = 3
_class[128:] = 4


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Term counts, one row per document."""
    docs, width = len(bounds) - 1, WORDS + SHAPES
    out = np.zeros((docs, width), np.float32)
    starts, ends, limits = word_bounds(data, bounds)
    if not len(starts):
        return out
    doc = np.repeat(np.arange(docs), np.diff(limits))
    words = Rolling(BYTE_VALUES[data]).of(starts, ends)
    kinds = _class[data]
    opens, closes = kinds[starts], kinds[ends - 1]
    # Up to three marks at the end count by what they are.
    tail = np.zeros(len(starts), np.uint64)
    open_ = np.ones(len(starts), bool)
    for back in (1, 2, 3):
        place = np.maximum(ends - back, starts)
        open_ &= (kinds[place] == 5) & (ends - back >= starts)
        tail = np.where(open_, tail * np.uint64(256) + data[place], tail)
    upper = np.r_[0, np.cumsum(kinds == 2)]
    capitals = upper[ends] - upper[starts]
    length = np.minimum(ends - starts, 24) // 4
    case = np.minimum(capitals, 2)
    again = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
    shape = (((tail * 8 + opens) * 8 + closes) * 4 + case) * 2 + again
    with np.errstate(over="ignore"):
        shape = (shape.astype(np.uint64) * 8 + length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        plain = (tail * np.uint64(16) + (case * 2 + again + 8).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    for column in (
        words % np.uint64(WORDS),
        WORDS + (shape >> np.uint64(40)) % np.uint64(SHAPES),
        WORDS + (plain >> np.uint64(40)) % np.uint64(SHAPES),
    ):
        flat = np.bincount(doc * width + column.astype(np.int64), minlength=docs * width)
        out += flat.reshape(docs, width)
    return out


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequency by column
    basis: np.ndarray  # columns by rank
    vectors: np.ndarray  # labelled sample, rows of length 1
    y: np.ndarray
    share: float

    def project(self, matrix: np.ndarray) -> np.ndarray:
        rows = _weighted(matrix, self.weight) @ self.basis
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        out = np.full(len(matrix), self.share)
        if not len(self.y):
            return out
        for low in range(0, len(matrix), 256):
            part = matrix[low : low + 256]
            near = self.project(part) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.y))
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0.0) ** 8 + 1e-9
            vote = (weight * self.y[best]).sum(1) / weight.sum(1)
            out[low : low + 256] = np.where(part.any(1), vote, self.share)
        return out


def _weighted(matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
    total = np.maximum(matrix[:, :WORDS].sum(1, keepdims=True), 1)
    # Shares rather than counts: a long document is not further away than a short one.
    return np.log1p(matrix * (100 / total)) * weight


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = counts(*utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r.tobytes() for r in found], pa.binary())],
                    names=["doc_id", "y", "terms"],
                )

    rows = materialise(
        training_texts(docs, labels, label, sample)
        .select("doc_id", "text", "y")
        .mapInArrow(extract, "doc_id long, y int, terms binary"),
        "labelled",
    )
    got = rows.orderBy("doc_id").collect()  # at most ``sample`` rows of 8 KB
    y = np.array([r["y"] for r in got], float)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if not 0 < y.sum() < len(y):
        return Model(np.ones(1), np.ones((1, 1)), np.ones((0, 1)), np.zeros(0), share)
    matrix = np.stack([np.frombuffer(r["terms"], np.float32) for r in got])
    weight = np.log((1 + len(y)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 0.1
    weight[WORDS:] *= SHAPE_WEIGHT
    rows_ = _weighted(matrix, weight)
    # The leading right singular vectors, from the matrix of columns by columns.
    _, vectors = np.linalg.eigh(rows_.T @ rows_)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
    model = Model(weight, basis, np.zeros((0, RANK)), np.zeros(0), share)
    return Model(weight, basis, model.project(matrix), y, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, bounds in blocks(batches, 1 << 20):
            for low in range(0, len(ids), 1024):
                part = bounds[low : low + 1025]
                found = counts(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[low : low + 1024], pa.int64()),
                        pa.array(np.clip(model.scores(found), 0.0, 1.0)),
                    ],
                    names=["doc_id", "score"],
                )

    rated = id_and_text(docs).mapInArrow(rate, "doc_id long, score double")
    return rated.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

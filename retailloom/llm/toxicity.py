"""Operator 10: a toxicity classifier that is indifferent to which group a sentence mentions.

Logistic regression on the presence of words and of word beginnings (bytes, so that stems count in
any language). In the labelled sentences identity terms are swapped for others of their kind, and
the squared change of the score's logit is a penalty. A term therefore cannot carry weight that
the other terms of its kind do not carry, whatever sentences it happened to occur in.

The fit sees at most ``SAMPLE`` labelled documents, never held-out ones, and at most ``FEATURES``
features, chosen by likelihood ratio over that sample. Every document is scored over its whole
text, within the scan. Null and empty texts get the score of a text without features. Without
labels of both kinds the score is their smoothed share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import BYTE_VALUES, LETTERS, Rolling, id_and_text, utf8, word_bounds
from retailloom.llm.labelled import held_out, training_texts
from retailloom.session import materialise

SAMPLE = 8000
FEATURES = 20000
EVIDENCE = 15.0  # least likelihood ratio of a feature
STEMS = (4, 6)
SWAP_PENALTY = 2.0
THRESHOLD = 0.5
STEP = 256  # documents held as numpy arrays at a time

#: Terms that name groups, by kind; a term is swapped for the others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_kinds = {term: kind for kind in IDENTITY for term in kind}
_term = re.compile(r"(?i)\b(" + "|".join(sorted(_kinds, key=len, reverse=True)) + r")\b")
_sentence = re.compile(r"[^.!?\n]+")


def features(data: np.ndarray, bounds: np.ndarray, stems=STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every word and word beginning, as they occur, of lower-cased bytes."""
    starts, ends, _ = word_bounds(data, bounds, LETTERS)
    doc = np.searchsorted(bounds, starts, "right") - 1
    rolling = Rolling(BYTE_VALUES[data])
    docs, found = [doc], [rolling.of(starts, ends)]
    for length in stems:
        has = ends - starts > length
        docs.append(doc[has])
        stem = rolling.of(starts[has], starts[has] + length)
        found.append(stem ^ np.uint64(0x5851F42D4C957F2D + length))
    return np.concatenate(docs), np.concatenate(found).view(np.int64)


def _present(texts: list[str]) -> list[np.ndarray]:
    data, bounds = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
    doc, found = features(data, bounds)
    return [np.unique(found[doc == i]) for i in range(len(texts))]


def swaps(text: str) -> list[tuple[str, str]]:
    """Each sentence that names a group, with each group term replaced in turn by each other."""
    out = []
    for sentence in _sentence.findall(text):
        for match in _term.finditer(sentence):
            for other in _kinds[match[0].lower()]:
                if other != match[0].lower():
                    out.append((sentence, sentence[: match.start()] + other + sentence[match.end() :]))
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        logit = np.full(len(bounds) - 1, self.bias)
        if not len(self.keys) or not len(data):
            return logit
        doc, found = features(data, bounds)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        known = self.keys[at] == found
        pairs = np.unique(doc[known] * len(self.keys) + at[known])
        np.add.at(logit, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return logit


def fit_logistic(
    rows: list[np.ndarray], y: np.ndarray, size: int, pairs=(), ridge=0.02, rounds=400, rate=0.2
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. ``pairs``: features that a swap adds or takes
    away, whose summed weights are penalised by their square."""
    lengths = [len(r) for r in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    swap = np.repeat(np.arange(len(pairs)), [len(c) for c, _ in pairs])
    swap_col = np.concatenate([c for c, _ in pairs]) if len(pairs) else np.zeros(0, np.int64)
    sign = np.concatenate([s for _, s in pairs]) if len(pairs) else np.zeros(0)
    w, bias = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m = v = np.zeros(size + 1)
    for step in range(1, rounds + 1):
        logit = bias + np.bincount(row, w[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y
        grad = np.bincount(col, error[row], size) / len(y) + ridge * w / len(y) * 10
        if len(pairs):
            change = np.bincount(swap, sign * w[swap_col], len(pairs))
            grad += 2 * SWAP_PENALTY * np.bincount(swap_col, sign * change[swap], size) / len(pairs)
        both = np.r_[grad, error.mean()]
        m = 0.9 * m + 0.1 * both
        v = 0.999 * v + 0.001 * both**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents."""
    texts = training_texts(docs, labels, label, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                data, bounds = utf8(pc.utf8_lower(part.column(1)))
                doc, found = features(data, bounds)
                pairs = []
                for text in part.column(1).to_pylist():
                    own = swaps(text or "")
                    flat = _present([x for pair in own for x in pair])
                    pairs.append(
                        [
                            {"lost": np.setdiff1d(a, b).tolist(), "gained": np.setdiff1d(b, a).tolist()}
                            for a, b in zip(flat[::2], flat[1::2], strict=True)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(2).to_pylist(), pa.int32()),
                        pa.array([np.unique(found[doc == j]) for j in range(part.num_rows)], pa.list_(pa.int64())),
                        pa.array(pairs, SWAPS),
                    ],
                    names=["y", "features", "swaps"],
                )

    rows = materialise(
        texts.select("doc_id", "text", "y").mapInArrow(
            extract,
            "y int, features array<long>, swaps array<struct<lost: array<long>, gained: array<long>>>",
        ),
        "labelled",
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, positive = total["n"], total["p"] or 0
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    base = positive / n

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    evidence = 2 * (
        part(a, (a + b) * base)
        + part(b, (a + b) * (1 - base))
        + part(positive - a, (n - a - b) * base)
        + part(n - positive - b, (n - a - b) * (1 - base))
    )
    chosen = (
        rows.select("y", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .withColumn("evidence", evidence)
        .where(F.col("evidence") >= EVIDENCE)
        .orderBy(F.desc("evidence"), "feature")
        .limit(FEATURES)
    )
    keys = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, found, pairs = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(y, pa.int32()),
                    pa.array([np.flatnonzero(np.isin(keys, f)).tolist() for f in found], pa.list_(pa.int64())),
                    pa.array(
                        [
                            [
                                {k: np.flatnonzero(np.isin(keys, p[k])).tolist() for k in ("lost", "gained")}
                                for p in own
                            ]
                            for own in pairs
                        ],
                        SWAPS,
                    ),
                ],
                names=["y", "features", "swaps"],
            )

    data = rows.mapInArrow(known, rows.schema).collect()  # at most ``sample`` short rows
    pairs = [
        (np.array(p["lost"] + p["gained"], np.int64), np.r_[np.ones(len(p["lost"])), -np.ones(len(p["gained"]))])
        for r in data
        for p in r["swaps"]
        if p["lost"] or p["gained"]
    ]
    w, bias = fit_logistic(
        [np.array(r["features"], np.int64) for r in data],
        np.array([r["y"] for r in data], float),
        len(keys),
        pairs,
    )
    return Model(keys, w, bias)


SWAPS = pa.list_(
    pa.struct([("lost", pa.list_(pa.int64())), ("gained", pa.list_(pa.int64()))])
)


def scorer(model: Model):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(texts), STEP):
            part = pa.array(texts.iloc[low : low + STEP].tolist(), pa.large_string(), from_pandas=True)
            logit = np.clip(model.logits(*utf8(pc.utf8_lower(part))), -40, 40)
            out.append(1 / (1 + np.exp(-logit)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return rate


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD) of every document."""
    rated = id_and_text(docs).select("doc_id", scorer(model)("text").alias("score"))
    return rated.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

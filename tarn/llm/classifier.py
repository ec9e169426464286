"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text becomes a sparse vector of hashed n-grams: words and pairs of words, and one to three successive word shapes
(case, digits, symbols, endings, repetition of the word before), which stand for words never seen; Training.shapes leaves
these out. Counts are dampened
and the vector scaled to length 1. Weights come from FTRL-proximal updates, whose L1 part leaves most of them at zero;
scores are sparse dot products. Only the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams, and so weights: the model is of this size whatever the corpus.
FEATURES = 1 << 18
REMEMBERED = 300_000


@dataclass(frozen=True)
class Training:
    """most_rows bounds the labelled documents that are learned from: those with the least hash of doc_id.

    shapes: n-grams of word shapes count beside those of words.
    """

    most_rows: int = 6000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    shapes: bool = True


def _shape(word: str) -> int:
    core = word.rstrip(".,;:!?\"')")
    tail = word[len(core) :]
    if not core:
        kind = 0
    elif any(c in "#*$%&|<>" for c in core):
        kind = 1 if any(c.isalnum() for c in core) else 2
    elif any(c.isdigit() for c in core):
        kind = 3
    elif core.isupper() and len(core) > 1:
        kind = 4
    elif core[0].isupper():
        kind = 5
    else:
        kind = 6
    end = 0 if not tail else 1 if "!" in tail else 2 if tail[0] in ".?" else 3
    return 1 + kind * 4 + end


class _Words(dict):
    """(hash, shape) of words in one number: the shape in the low 6 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 6 << 6) | _shape(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def vector(text: str | None, words: _Words, shapes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Features (ascending) and values; feature 0 is the intercept and always 1."""
    found = (text or "").split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    shape = h & np.uint64(63)
    shape[1:] += np.where(h[1:] == h[:-1], np.uint64(64), np.uint64(0))
    kinds = [h, _mix(h[:-1]) + h[1:], shape + np.uint64(1 << 20), (shape[:-1] << np.uint64(8)) + shape[1:] + np.uint64(1 << 30), (shape[:-2] << np.uint64(16)) + (shape[1:-1] << np.uint64(8)) + shape[2:] + np.uint64(1 << 40)]
    features, values = [np.zeros(1, np.int64)], [np.ones(1, np.float32)]
    # Words and shapes are scaled apart, so that neither drowns the other.
    for part in (kinds[:2], kinds[2:])[: 1 + shapes]:
        own, n = np.unique((_mix(np.concatenate(part)) % np.uint64(FEATURES - 1)).astype(np.int64) + 1, return_counts=True)
        weight = np.log1p(n).astype(np.float32)
        features.append(own)
        values.append(weight / np.sqrt((weight**2).sum()))
    at, value = np.concatenate(features), np.concatenate(values)
    order = np.argsort(at, kind="stable")
    return at[order], value[order]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(shapes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            made = [vector(text.as_py(), words, shapes) for text in batch.column(2)]
            own = [pa.array([f.astype("<i4").tobytes() for f, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["place", "quality", "features", "vals"])

    return run


def _trainer(how: Training):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "features", "vals", "quality"], kind="stable")
        data = [(np.frombuffer(f, "<i4"), np.frombuffer(v, "<f4").astype(np.float64), float(y)) for f, v, y in zip(rows["features"], rows["vals"], rows["quality"], strict=True)]
        z, n = np.zeros(FEATURES), np.zeros(FEATURES)
        share = max(1e-6, min(1 - 1e-6, sum(y for _, _, y in data) / max(1, len(data))))
        rare = {1.0: 0.5 / share, 0.0: 0.5 / (1 - share)}  # both labels weigh the same in all

        def weights(at: np.ndarray | slice) -> np.ndarray:
            return np.where(np.abs(z[at]) <= how.l1, 0.0, -(z[at] - np.sign(z[at]) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

        for _ in range(how.epochs):
            for at, x, y in data:
                w = weights(at)
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
                g = (p - y) * x * rare[y]
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha * w
                n[at] += g * g
        return pd.DataFrame({"weights": [weights(slice(None)).astype("<f4").tobytes()]})

    return fit


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> np.ndarray:
    """Weights, learned from at most how.most_rows labels of documents that are not held out. Without any: all zero.

    Labels other than 0 and 1, and labels without a doc_id, are left out. The chosen labels are bounded by most_rows
    and so may be broadcast; vectors are made where the documents lie, and one task makes the updates in a fixed order.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.withColumn("place", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("place", "doc_id", "quality").limit(how.most_rows)
    met = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = met.select("place", "quality", "text").mapInArrow(_vectors(how.shapes), "place long, quality int, features binary, vals binary")
    # A doc_id that many rows share must not go beyond the bound either.
    rows = rows.orderBy("place", "quality", "features", "vals").limit(how.most_rows)
    made = rows.groupBy(F.lit(1).alias("one")).applyInPandas(_trainer(how), "weights binary").collect()
    return np.frombuffer(made[0]["weights"], "<f4") if made else np.zeros(FEATURES, np.float32)


def _scorer(weights: np.ndarray, shapes: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = []
            for text in batch.column(1):
                at, x = vector(text.as_py(), words, shapes)
                found.append(1.0 / (1.0 + np.exp(-float(np.clip(weights[at] @ x, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; null and empty texts get the score of the intercept.

    Equal texts get equal scores, so ties are only of texts that the model can't tell apart. Repeated rows each get their
    own; a doc_id with several texts or labels is learned from once for each pair of them, within the bound. A null
    doc_id is scored and never learned from. Other columns, in docs and in labels, are not looked at.
    """
    weights = train(docs, labels, how)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(weights, how.shapes), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))

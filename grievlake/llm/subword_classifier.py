"""Quality classifier on averaged subword vectors, with a softmax over the two classes.

Every word, every character 3- to 5-gram (bytes, one white space at either end counts as the border of a
word) and every form of a 3-word window (met before in the text or new) is hashed to a row of one table.
A text is the sum of its three averages. Vectors and output weights are learned together by NumPy stochastic
gradient descent on at most ``max_docs`` labelled documents chosen by a hash of the id. For scoring, vectors
are multiplied with the output weights once, so a text needs one number per hashed item.

A null or empty text has no items and gets the score of the bias alone. Without labels of both classes
every score is the share of label 1, 0.5 without any. Repeated rows are scored each; labels given twice
count once, by their smallest value; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import NONSPACE, letter_values, mix, run_hashes, runs, same_in_owner, slices, text_bytes, window_hashes

WORD_ROWS, GRAM_ROWS, FORM_ROWS = 1 << 16, 1 << 16, 2
ROWS = WORD_ROWS + GRAM_ROWS + FORM_ROWS
GRAMS = (3, 4, 5)
DIMENSIONS, MAX_DOCS, EPOCHS, RATE = 8, 2500, 8, 0.1


def _slice_items(part: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, character grams and forms: row of the table and text of every item."""
    values = letter_values(False)
    starts, ends, text = runs(part, at, NONSPACE)
    words = run_hashes(part, starts, ends, values)
    yield (words % np.uint64(WORD_ROWS)).astype(np.int32), text
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    letter, inside = values[part], NONSPACE[part]
    ids, owners = [], []
    for n in GRAMS:
        size = len(part) - n + 1
        if size <= 0:
            continue
        good = (owner[:size] == owner[n - 1:]) & inside[1: 1 + size]
        for k in range(2, n - 1):
            good &= inside[k: k + size]
        place = np.flatnonzero(good)
        total = np.full(len(place), n, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + letter[place + k]
        ids.append((mix(total) % np.uint64(GRAM_ROWS)).astype(np.int32) + WORD_ROWS)
        owners.append(owner[place])
    yield (np.concatenate(ids), np.concatenate(owners)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    windows, begin = window_hashes(words, text, 3)
    again = same_in_owner(windows, text[begin])[0]
    yield again.astype(np.int32) + WORD_ROWS + GRAM_ROWS, text[begin]


@dataclass(frozen=True)
class Classifier:
    table: np.ndarray  # what each row adds to the difference of the two outputs
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        total = np.full(len(texts), self.bias)
        for first, last in slices(offsets):
            at = offsets[first: last + 1] - offsets[first]
            for ids, owner in _slice_items(data[offsets[first]: offsets[last]], at):
                n = np.bincount(owner, minlength=last - first)
                total[first:last] += np.bincount(owner, self.table[ids], last - first) / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50, 50)))


def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order, label, and the distinct rows of each text with their weights in its vector."""
    for batch in batches:
        rows, weights = [], []
        data, offsets = text_bytes(batch.column(2))
        for k in range(batch.num_rows):
            own, at = data[offsets[k]: offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])
            found, parts = [], []
            for ids, _ in _slice_items(own, at):
                distinct, n = np.unique(ids, return_counts=True)
                found.append(distinct.astype(np.int32))
                parts.append((n / max(len(ids), 1)).astype(np.float32))
            rows.append(np.concatenate(found).tobytes())
            weights.append(np.concatenate(parts).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.binary()), pa.array(weights, pa.binary())],
            names=["_order", "_label", "rows", "weights"],
        )


def train(
    rows: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS, rate: float = RATE, seed: int = 7,
) -> Classifier:
    """Stochastic gradient descent, one document at a time, with a linearly falling rate.

    Each row's step shrinks with the gradients it has seen, so that rare rows still learn.
    """
    labels = np.asarray(labels, int)
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        return Classifier(np.zeros(ROWS), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dimensions, 1 / dimensions, (ROWS, dimensions)).astype(np.float32)
    output, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    seen = np.full(ROWS, 1e-8, np.float32)
    turns, turn = epochs * len(labels), 0
    for _ in range(epochs):
        for k in draw.permutation(len(labels)):
            step = rate * (1 - turn / turns)
            turn += 1
            mine, part = rows[k], weights[k]
            hidden = part @ vectors[mine]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            error = -p / p.sum()
            error[labels[k]] += 1
            back = error @ output
            output += step * np.outer(error, hidden) / max(1.0, float(np.linalg.norm(hidden)))
            bias += step * 0.1 * error
            seen[mine] += (part * np.linalg.norm(back)) ** 2
            vectors[mine] += step * (part / np.sqrt(seen[mine]))[:, None] * back
    difference = output[1] - output[0]
    return Classifier((vectors @ difference).astype(np.float64), float(bias[1] - bias[0]))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_docs: int = MAX_DOCS,
) -> Classifier:
    """Train on at most ``max_docs`` of the given labels (hold rows out before)."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_docs)
    )
    # at most max_docs narrow rows: safe to broadcast, so that the texts are not shuffled
    got = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
        .select("_order", "_label", "_text").mapInArrow(items, "_order bigint, _label int, rows binary, weights binary")
        .orderBy("_order", "rows").limit(max_docs).collect()
    )
    return train(
        [np.frombuffer(r["rows"], np.int32) for r in got], [np.frombuffer(r["weights"], np.float32) for r in got],
        np.array([r["_label"] for r in got]),
    )


def score(text: Column, model: Classifier) -> Column:
    """Probability of label 1."""
    return F.arrow_udf(lambda texts: pa.array(model.scores(texts)), T.DoubleType())(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))

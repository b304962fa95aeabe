"""Text quality by a factorisation machine over hashed words, structure statistics and the stated length.

The score is a bias, a weight for each feature and, for each pair of features, the product of two short vectors. All pairs
together cost one pass over a text's features: half of (sum of vectors) squared minus the sum of squared vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

WORDS = 1 << 15
BINS = 16
STATISTICS = ("words", "distinct", "repeats", "capitals", "signs", "digits", "bars", "word length", "line length", "marks", "stated length")
SIZE = WORDS + BINS * len(STATISTICS)
KIND = np.zeros(256, np.int8)  # of a byte: 1 a sign, 2 a digit, 3 a bar, 4 a sentence mark
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()"]] = 1
KIND[list(b"0123456789")] = 2
KIND[ord("|")] = 3
KIND[list(b".!?")] = 4


class Machine(NamedTuple):
    bias: float
    weights: np.ndarray  # a number for each feature
    vectors: np.ndarray  # a row for each feature


def statistics(text: str, words: list[str], distinct: int, stated: int | None) -> list[float]:
    """One number from 0 to 1 for each of STATISTICS, -1 where it has no value."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(KIND[raw], minlength=5) / size
    scale = lambda x: np.log2(1 + x) / 24
    if not n:
        return [0.0, -1, -1, -1, counts[1], counts[2], counts[3], -1, -1, counts[4], -1 if stated is None else scale(max(0, stated))]
    return [
        scale(n), distinct / n, sum(map(eq, words, words[1:])) / n, sum(map(str.isupper, words)) / n, 4 * counts[1], counts[2], 8 * counts[3],
        len(raw) / n / 24, scale(len(raw) / (1 + text.count("\n"))), 4 * counts[4], -1 if stated is None else scale(max(0, stated)),
    ]


def features(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: the distinct words by hash, with one unit of length together, and a bin of each statistic."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    hashed = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct)) % np.uint64(WORDS)).astype(np.int64)
    bins = [WORDS + k * BINS + (0 if x < 0 else 1 + min(BINS - 2, int(x * (BINS - 1)))) for k, x in enumerate(statistics(text, words, len(distinct), stated))]
    values = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.ones(len(bins))])
    return np.concatenate([hashed, np.array(bins)]), values


def margins(machine: Machine, numbers: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of texts whose features begin at starts, and their sums of vectors."""
    scaled = machine.vectors[numbers] * values[:, None]
    sums = np.add.reduceat(scaled, starts)
    squares = np.add.reduceat(scaled * scaled, starts)
    linear = np.add.reduceat(machine.weights[numbers] * values, starts)
    return machine.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, mini-batches with AdaGrad steps. rows: feature numbers, values, label."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if not rows:
        return machine._replace(vectors=np.zeros((SIZE, rank)))
    share = np.clip(np.mean([label for *_, label in rows]), 0.01, 0.99)
    bias, weights, vectors = float(np.log(share / (1 - share))), machine.weights, machine.vectors
    seen_weights, seen_vectors, seen_bias = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = [rows[k] for k in order[start : start + batch]]
            sizes = np.array([len(x) for x, *_ in part])
            numbers, values = np.concatenate([x for x, *_ in part]), np.concatenate([v for _, v, _ in part])
            margin, sums = margins(Machine(bias, weights, vectors), numbers, values, np.cumsum(sizes) - sizes)
            slope = np.repeat((probability(margin) - np.array([y for *_, y in part])) / len(part), sizes) * values
            used, at = np.unique(numbers, return_inverse=True)
            step = np.bincount(at, slope, len(used)) + decay * weights[used]
            seen_weights[used] += step * step
            grad = slope[:, None] * (np.repeat(sums, sizes, axis=0) - vectors[numbers] * values[:, None])
            steps = np.stack([np.bincount(at, g, len(used)) for g in grad.T], 1) + decay * vectors[used]
            seen_vectors[used] += steps * steps
            weights[used] -= rate * step / np.sqrt(seen_weights[used])
            vectors[used] -= rate * steps / np.sqrt(seen_vectors[used])
            down = float((probability(margin) - np.array([y for *_, y in part])).mean())
            seen_bias += down * down
            bias -= rate * down / seen_bias**0.5
    return Machine(bias, weights, vectors)


def sample_features(docs: DataFrame, labels: DataFrame, condition: Column, most: int = 6000, id: str = "doc_id", text: str = "text", length: str = "n_chars", label: str = "quality") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most `most` labelled rows under the condition, drawn by a hash of the id: the fit's bounded input."""
    drawn = labels.where(condition & F.col(label).isNotNull()).select(F.col(id).alias("key"), (F.col(label) == 1).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("key"), "key", "label").limit(most)
    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("text"), F.col(length).cast("long").alias("stated")).join(F.broadcast(drawn), "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t, n)[0].astype(np.int32) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(3)], names=["key", "numbers", "label"])

    kind = rows.schema["key"].dataType.simpleString()
    # An id may have several documents, so the limit is set once more.
    got = rows.mapInArrow(read, f"key {kind}, numbers array<int>, label int").orderBy(F.xxhash64("key"), "key", "numbers").limit(most)
    out = []
    for _, numbers, y in got.collect():
        numbers = np.array(numbers)
        words = np.count_nonzero(numbers < WORDS)
        out.append((numbers, np.where(numbers < WORDS, 1 / np.sqrt(max(1, words)), 1.0), y))
    return out


def score_quality(docs: DataFrame, machine: Machine, text: str = "text", length: str = "n_chars", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for better texts; a column of that name is replaced.

    Null and empty texts are scored by their statistics alone. Whole texts count; repeated rows are scored one by one.
    """
    base = docs.drop(score)
    fields = [*base.schema.fields, T.StructField(score, T.DoubleType())]
    at, stated = base.columns.index(text), base.columns.index(length)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t, None if n is None else int(n)) for t, n in zip(batch.column(at).to_pylist(), batch.column(stated).to_pylist(), strict=True)]
            scores = np.zeros(0)
            if found:
                sizes = np.array([len(x) for x, _ in found])
                scores = probability(margins(machine, np.concatenate([x for x, _ in found]), np.concatenate([v for _, v in found]), np.cumsum(sizes) - sizes)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[f.name for f in fields])

    return base.mapInArrow(rate, T.StructType(fields))

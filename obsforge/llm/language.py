"""Language identification with a string kernel.

A text is the set of its character n-grams of length 1 to 3 (a blended spectrum, presence only) and two texts compare
by the cosine of their sets. Landmark texts give Nystroem features, on which one-versus-rest kernel ridge regression is
solved. Scoring is two matrix products per batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, slices, texts

UNDETERMINED = "und"
CLASSES, OWN = 128, 96  # symbols of the normalised alphabet; those below OWN belong to one character each
SPACE = CLASSES + CLASSES**2 + CLASSES**3
BATCH = 256


class KernelModel(NamedTuple):
    alphabet: str
    languages: list[str]
    grams: np.ndarray  # n-gram codes that occur in a landmark
    landmarks: np.ndarray  # grams x landmarks, 1 where the landmark has the n-gram, divided by the landmark's norm
    weights: np.ndarray  # landmarks x languages


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def symbol_table(alphabet: str) -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, its own for letters of the alphabet, a shared one for others."""
    table = np.zeros(0x110000, np.int32)
    other = np.flatnonzero(letters())
    table[other] = OWN + other % (CLASSES - OWN)
    for k, letter in enumerate(alphabet):
        table[ord(letter)] = k + 1
    return table


def gram_codes(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a lower-cased text, runs of other characters being one blank. Repeats stay."""
    symbols = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)]
    keep = symbols != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    one = symbols[keep]
    two = one[:-1] * CLASSES + one[1:]
    three = two[:-1] * CLASSES + one[2:]
    return np.concatenate([one, two + CLASSES, three + (CLASSES + CLASSES**2)])


class Presence:
    """Which n-grams a text has. A stamp per code saves clearing the table between texts."""

    def __init__(self, alphabet: str) -> None:
        self.table = symbol_table(alphabet)
        self.stamps = np.zeros(SPACE, np.int64)
        self.next = 1

    def __call__(self, text: str, grams: np.ndarray) -> tuple[np.ndarray, int]:
        codes = gram_codes(text, self.table)
        stamps = np.arange(self.next, self.next + len(codes))
        self.stamps[codes] = stamps
        first, self.next = self.next, self.next + len(codes)
        return self.stamps[grams] >= first, int(np.count_nonzero(self.stamps[codes] == stamps))


def fit_kernel_model(rows: list[tuple[str, str]], landmarks: int = 128, ridge: float = 1e-2) -> KernelModel:
    """rows: (text, language), in an order that decides which texts become landmarks. landmarks: how many in all."""
    languages = sorted({lang for _, lang in rows})
    counts = Counter(c for text, _ in rows for c in text.lower() if c.isalpha())
    alphabet = "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[: OWN - 1]))
    if not rows:
        return KernelModel("", [], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    table = symbol_table(alphabet)
    sets = [np.unique(gram_codes(text, table)) for text, _ in rows]
    each = max(1, landmarks // len(languages))
    chosen = [i for lang in languages for i in [i for i, (_, x) in enumerate(rows) if x == lang][:each]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[np.searchsorted(grams, sets[i]), k] = 1 / np.sqrt(len(sets[i]))
    kernel = np.zeros((len(rows), len(chosen)))
    for i, codes in enumerate(sets):
        at = np.searchsorted(grams, codes)
        at = at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == codes)]
        kernel[i] = marks[at].sum(0) / np.sqrt(len(codes))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])  # Nystroem map: kernel rows to features
    features = kernel @ whiten
    names = np.array([lang for _, lang in rows])
    target = (names[:, None] == np.array(languages)).astype(float)
    weight = np.array([1 / np.count_nonzero(names == lang) for lang in names])
    weight *= len(rows) / weight.sum()  # each language counts alike
    # No offset: a text that shares no n-gram with any landmark scores 0 for every language.
    solved = np.linalg.solve((features * weight[:, None]).T @ features + ridge * np.eye(features.shape[1]), (features * weight[:, None]).T @ target)
    return KernelModel(alphabet, languages, grams, marks, whiten @ solved)


def sample_languages(docs: DataFrame, condition, per_language: int = 300, max_languages: int = 128, text: str = "text", lang: str = "lang", order: str = "doc_id") -> list[tuple[str, str]]:
    """About per_language texts of each language under the condition, drawn by a hash of the id: the fit's bounded input.

    Only the max_languages most frequent languages are learned.
    """
    known = docs.where(condition & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max_languages).collect()
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang_, n in counts for x in (lang_, min(1.0, per_language / n))])[F.col(lang)]
    drawn = known.where(hash_share(order) < rate).orderBy(F.xxhash64(order), order, text).limit(2 * per_language * len(counts))
    return [(r[0], r[1]) for r in drawn.select(text, lang).collect()]


def predict_language(docs: DataFrame, model: KernelModel, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a predicted language and a score from 0 to 1; columns of these names are replaced.

    Null texts and texts without a letter give "und" and 0, and so does every text if the model learned no language.
    Repeated rows are scored one by one; the whole text counts, however long.
    """
    base = docs.drop(prediction, score)
    fields = [*base.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())]
    at = base.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(model.alphabet)
        for batch in slices(batches):
            found: list[str] = [UNDETERMINED] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            values = texts(batch.column(at))
            todo = [i for i, x in enumerate(values) if model.languages and any(map(str.isalpha, x))]
            for start in range(0, len(todo), BATCH):
                part = todo[start : start + BATCH]
                rows = np.zeros((len(part), len(model.grams)), np.float32)
                norms = np.ones(len(part))
                for k, i in enumerate(part):
                    rows[k], norms[k] = presence(values[i], model.grams)
                kernel = (rows @ model.landmarks) / np.sqrt(norms)[:, None]
                margins = kernel @ model.weights
                best = margins.argmax(1)
                scores[part] = np.clip(margins[np.arange(len(part)), best], 0, 1)
                for i, k in zip(part, best, strict=True):
                    found[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(scores)], names=[f.name for f in fields])

    return base.mapInArrow(predict, T.StructType(fields))

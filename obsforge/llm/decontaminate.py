"""Benchmark decontamination: token windows of test items are looked up in every training document."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, numbered, slices, texts

WINDOW = 13
#: Bytes of test text up to which the windows are sent to every task.
BROADCAST_BYTES = 32 << 20
#: A-Z lower-cased; every ASCII character but digits and letters becomes a blank; the rest is part of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Windows(NamedTuple):
    """ids: number of each word of the test set, from 1. keys: sorted window hashes, by window length. items: who has a window."""

    ids: dict[bytes, int]
    keys: dict[int, np.ndarray]
    items: dict[tuple[int, ...], tuple[str, ...]]


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        total = total * np.uint64(0x100000001B3) + ids[k : k + len(total)]
    return mix(total)


def index_windows(items: Iterable[tuple[str, str]], window: int = WINDOW) -> Windows:
    """items: (item id, text). Items shorter than the window are one window; items without a word have none."""
    ids: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        row = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        length = min(window, len(row))
        for k in range(len(row) - length + 1 if row else 0):
            owners[tuple(row[k : k + length])].add(item)
    keys = {n: np.unique(np.concatenate([window_hashes(np.array(x, np.uint64), n) for x in owners if len(x) == n])) for n in {len(x) for x in owners}}
    return Windows(ids, keys, {k: tuple(sorted(v)) for k, v in owners.items()})


def covered(n_words: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which words lie in one of the runs."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def hits(words: list[bytes], index: Windows) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, length) of each occurrence of a window, and the items concerned; a hash hit is verified word by word."""
    ids = np.array(list(map(index.ids.get, words, [0] * len(words))), np.uint64)
    gaps = np.concatenate([[0], np.cumsum(ids == 0)])
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    for length, keys in index.keys.items():
        if len(ids) < length:
            continue
        whole = np.flatnonzero(gaps[length:] == gaps[:-length])
        if not len(whole):
            continue
        total = np.zeros(len(whole), np.uint64)
        for k in range(length):
            total = total * np.uint64(0x100000001B3) + ids[whole + k]
        total = mix(total)
        at = np.searchsorted(keys, total)
        for p in whole[keys[np.minimum(at, len(keys) - 1)] == total].tolist():
            owners = index.items.get(tuple(ids[p : p + length].tolist()))
            if owners:
                runs.append((p, length))
                items.update(owners)
    return runs, items


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("clean_text", T.StringType()),
]
ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]


def report(text: str | None, words: list[bytes], runs: list[tuple[int, int]], items: Iterable[str], spans: bool) -> tuple:
    if not runs:
        return len(words), 0, [], text if spans else None
    starts, lengths = np.array(runs).T
    hit = covered(len(words), starts, lengths)
    kept = None
    if spans:
        # A run of hit words goes with what stands between them.
        raw, kept_bytes, done, before = (text or "").encode(), [], 0, False
        for at, word in zip(hit, WORD.finditer(raw.translate(FOLD)), strict=True):
            if at:
                if not before:
                    kept_bytes.append(raw[done : word.start()])
                done = word.end()
            before = at
        kept = b"".join([*kept_bytes, raw[done:]]).decode()
    return len(words), int(hit.sum()), sorted(items), kept


def find_contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, spans: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), items (sorted ids of items that occur) and, with
    spans, clean_text without the hit words. Columns of these names are replaced.

    The windows go to every task if the test texts have at most broadcast_bytes; beyond that they are joined by hash.
    Null and empty texts have no words. A null item id is written "null". Repeated rows are judged one by one, except
    that on the join path rows that agree in id and text share one lookup. An empty benchmark hits nothing.
    """
    base = docs.drop(*[f.name for f in FIELDS])
    schema = T.StructType([*base.schema.fields, *FIELDS])
    names = schema.names
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(base, tests, id, text, window, spans, schema)
    index = index_windows([(r[0], r[1]) for r in tests.collect()], window)
    at = base.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for value in batch.column(at).to_pylist():
                words = words_of(value)
                rows.append(report(value, words, *hits(words, index), spans))
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return base.mapInArrow(scan, schema)


def _joined(base: DataFrame, tests: DataFrame, id: str, text: str, window: int, spans: bool, schema: T.StructType) -> DataFrame:
    """The same over a benchmark of any size: windows of both sides meet by two 64-bit hashes in a shuffle join."""
    lanes = (np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15))

    def windows(lengths: list[int] | None = None):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for owner, value in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(value)], np.uint64)
                    for length in lengths or ([min(window, len(ids))] if len(ids) else []):
                        if len(ids) < length:
                            continue
                        pair = []
                        for lane in lanes:
                            total = np.zeros(len(ids) - length + 1, np.uint64)
                            for k in range(length):
                                total = total * lane + ids[k : k + len(total)]
                            pair.append(pa.array(mix(total).view(np.int64)))
                        n = len(pair[0])
                        yield pa.RecordBatch.from_arrays([pa.array([owner] * n, pa.string()), pa.array(np.full(n, length, np.int32)), pa.array(np.arange(n)), *pair], names=["owner", "length", "start", "h1", "h2"])

        return emit

    kind = "owner string, length int, start long, h1 long, h2 long"
    items = tests.select("item", "text").mapInArrow(windows(), kind).select("length", "h1", "h2", F.col("owner").alias("item")).distinct()
    lengths = [r[0] for r in items.select("length").distinct().collect()]
    at, n, plain = base.columns.index(text), len(base.columns), numbered(base)
    one, other = (F.col(plain.columns[base.columns.index(x)]) for x in (id, text))
    key = F.sha2(F.concat(F.coalesce(one.cast("string"), F.lit("\u0000")), F.lit("\n"), F.coalesce(other, F.lit(""))), 256)
    keyed = plain.withColumn("key", key)
    found = (
        keyed.select("key", other.alias("text")).dropDuplicates(["key"]).mapInArrow(windows(lengths or [1 << 40]), kind)
        .join(items, ["length", "h1", "h2"])
        .groupBy("owner").agg(F.collect_set(F.struct("start", "length")).alias("runs"), F.collect_set("item").alias("items"))
    )
    joined = keyed.join(found, F.col("key") == F.col("owner"), "left").drop("key", "owner")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for value, runs, owners in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                rows.append(report(value, words_of(value), [(r["start"], r["length"]) for r in runs or []], owners or [], spans))
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=schema.names)

    return joined.mapInArrow(finish, schema)


def digest(items: list[str] | None) -> str:
    """Lowercase hex SHA-256 of comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(items or [])).encode()).hexdigest()

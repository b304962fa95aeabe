"""Sequence packing: which remainders fill a window together is solved over the histogram of lengths.

Each document is cut into whole windows and a remainder. Combinations of two or three remainder lengths that fill a
window exactly are enumerated, their repeat counts are solved by non-negative least squares and rounded down, and what
is left over is packed greedily, a document being cut where a window ends.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

END = 1
CACHED_WORDS = 800_000  # of a worker process
OUT_TOKENS = 500_000  # of the pieces that are handed on at once
#: Characters that composing leaves alone and that Python and the tokenizer lower-case and split alike.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")


def plain_class(kind: str) -> str:
    """The plain characters of a Unicode category, as they stand inside brackets of a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x20C0) if unicodedata.category(chr(c))[0] == kind and PLAIN.fullmatch(chr(c)))


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, with the end id behind them.

    Where the tokenizer lower-cases, splits into words and marks a word's last token, words of plain texts are encoded once
    and remembered; other texts and other tokenizers are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        steps = [x["type"] for x in (layout["normalizer"] or {}).get("normalizers", [])]
        splits = (layout["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known: dict[str, bytes] = {}
        self.words = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and layout["model"].get("end_of_word_suffix"):
            pattern = splits[0]["pattern"]["Regex"].replace(r"\p{L}", plain_class("L")).replace(r"\p{N}", plain_class("N"))
            self.words = re.compile(pattern)  # the same on plain characters, and faster
            self.special = [x["content"] for x in layout["added_tokens"]]
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.whole.get_vocab_size(), bool)
            suffix = layout["model"]["end_of_word_suffix"]
            self.last[[k for token, k in layout["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        into = self.known if len(words) <= CACHED_WORDS else {}
        for start in range(0, len(words), 500):
            part = words[start : start + 500]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            raw = ids.tobytes()
            for word, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                into[word] = raw[4 * a : 4 * b]
        return into

    def __call__(self, text: str | None) -> bytes:
        end = END.to_bytes(4, "little")
        if not text:
            return end
        if self.words is None or not PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes() + end
        words = self.words.findall(text.lower())
        known, distinct = self.known, set(words)
        new = [w for w in distinct if w not in known]
        if new:
            if len(known) + len(new) > CACHED_WORDS:
                new = list(distinct)
            known = self._learn(new)
        return b"".join(map(known.__getitem__, words)) + end


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process: words that a task has encoded are known to the next."""
    return WordTokens(path)


def _narrow(raw: bytes) -> bytes:
    """Ids in two bytes each where all fit, and a byte that says so."""
    ids = np.frombuffer(raw, "<u4")
    return b"2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"4" + raw


def _wide(packed: bytes) -> bytes:
    return np.frombuffer(packed, "<u2", offset=1).astype("<u4").tobytes() if packed[:1] == b"2" else packed[1:]


class Slots(NamedTuple):
    """Where the k-th remainder of a length goes: rank lo and above of a length to sequence base + (k - lo) at an offset."""

    window: int
    first: np.ndarray  # of each length, its first row in the arrays below; one more at the end
    lo: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    left: np.ndarray  # of each length, the rank from which remainders are packed greedily
    place: np.ndarray  # of each length, the greedy packing's token position of that rank
    greedy: int  # sequences before the greedy ones
    whole: int  # sequences before those of whole windows

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of one remainder."""
        if rank < self.left[length]:
            k = self.first[length] + int(np.searchsorted(self.lo[self.first[length] : self.first[length + 1]], rank, "right")) - 1
            return [(0, length, int(self.base[k]) + rank - int(self.lo[k]), int(self.offset[k]))]
        at, start, parts = int(self.place[length]) + (rank - int(self.left[length])) * length, 0, []
        while start < length:
            n = min(length - start, self.window - at % self.window)
            parts.append((start, n, self.greedy + at // self.window, at % self.window))
            start, at = start + n, at + n
        return parts


def combinations(histogram: np.ndarray, window: int, columns: int) -> np.ndarray:
    """Rows of three lengths that add up to the window, 0 for none, those of the most frequent lengths first."""
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    here = histogram > 0
    a, b = np.meshgrid(present, present, indexing="ij")
    two = (a <= b) & (a + b == window)
    c = window - a - b
    three = (a <= b) & (b <= c) & here[np.maximum(c, 0)] & (c > 0)
    rows = np.concatenate([np.stack([a[two], b[two], 0 * a[two]], 1), np.stack([a[three], b[three], c[three]], 1)])
    mass = np.where(rows > 0, histogram[rows], np.iinfo(np.int64).max).min(1)
    return rows[np.lexsort((rows[:, 1], rows[:, 0], -mass, rows[:, 2] > 0))[:columns]]


def solve_counts(histogram: np.ndarray, rows: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of the combinations' counts against the histogram, by coordinate descent."""
    columns = [np.unique(r[r > 0], return_counts=True) for r in rows]
    residual = histogram.astype(float)
    counts = [0.0] * len(rows)
    sparse = [(list(zip(k.tolist(), n.tolist(), strict=True)), float((n * n).sum())) for k, n in columns]
    left = residual.tolist()
    for _ in range(sweeps):
        most = 0.0
        for i, (entries, norm) in enumerate(sparse):
            step = max(-counts[i], sum(n * left[k] for k, n in entries) / norm)
            if step:
                counts[i] += step
                for k, n in entries:
                    left[k] -= n * step
                most = max(most, abs(step))
        if most < 0.01:
            break
    return np.array(counts)


def plan_slots(histogram: np.ndarray, window: int, columns: int = 4000) -> Slots:
    """histogram: number of remainders by length, 0 to window - 1."""
    rows = combinations(histogram, window, columns)
    wanted = np.floor(solve_counts(histogram, rows) + 1e-6).astype(np.int64)
    used = np.zeros(window, np.int64)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
    sequence = 0
    for k in np.argsort(-wanted, kind="stable"):
        lengths, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(wanted[k], ((histogram - used)[lengths] // times).min()))
        if n <= 0:
            continue
        offset = 0
        for length in rows[k][rows[k] > 0].tolist():
            slots[length].append((int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    place, at = np.zeros(window, np.int64), 0
    for length in range(window - 1, 0, -1):
        place[length] = at
        at += int(histogram[length] - used[length]) * length
    flat = np.array([s for x in slots for s in x], np.int64).reshape(-1, 3)
    first = np.concatenate([[0], np.cumsum([len(x) for x in slots])])
    return Slots(window, first, flat[:, 0], flat[:, 1], flat[:, 2], used, place, sequence, sequence - (-at // window))


def pack_documents(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = 2048, columns: int = 4000,
    payload: tuple[str, str, Callable[[bytes], object]] = ("ids", "array<int>", lambda raw: np.frombuffer(raw, "<i4")),
) -> DataFrame:
    """One row per piece: id, start, length, payload, doc_tokens, sequence_id, offset.

    payload is (column, type, function of the piece's ids as little-endian 32-bit bytes); as given it is the ids themselves.
    Only the last greedy sequence is not full. Null and empty texts are the end id alone. Every row is packed by itself,
    also rows that repeat an id or a whole row; a null id stays null. An empty table gives no piece.
    """
    source = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, press = word_tokens(tokenizer), zstandard.ZstdCompressor()
        for batch in slices(batches):
            found = [tokens(x) for x in batch.column(1).to_pylist()]
            sizes = pa.array([len(x) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([press.compress(_narrow(x)) for x in found], pa.binary())], names=["doc", "tokens", "packed"])

    kind = T.StructType([source.schema["doc"]]).add("tokens", "long").add("packed", "binary")
    # Rows get a number of their own, which the table keeps, so that rows may repeat ids and texts.
    encoded = written(source.mapInArrow(encode, kind).withColumn("row", F.monotonically_increasing_id()))
    sizes = encoded.select("row", "tokens", (F.col("tokens") % window).alias("rest"))
    histogram = np.zeros(window, np.int64)
    for rest, n in sizes.groupBy("rest").count().collect():
        histogram[rest] = n
    slots = plan_slots(histogram, window, columns)

    # A row's rank among those of its length, and the whole windows before it: counts of hash buckets, then inside a bucket.
    buckets = max(1, int(histogram.sum()) // 5_000)
    placed = sizes.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    whole = F.expr(f"tokens div {window}")
    ranks = placed.groupBy("rest", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count"))
    wholes = placed.groupBy("bucket").agg(F.sum(whole).alias("n")).withColumn("whole_before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n"))
    inside = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.repartition("bucket")
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "rest").orderBy("row")) - 1)
        .withColumn("wholes", F.sum(whole).over(inside) - whole)
        .join(wholes.drop("n"), ["bucket"]).join(ranks.drop("count"), ["rest", "bucket"])
        .select("row", (F.col("rank") + F.col("before")).alias("rank"), (F.col("wholes") + F.col("whole_before")).alias("whole"))
    )
    joined = encoded.select("row", "doc", "packed").join(ranked, "row").select("doc", "packed", "rank", "whole")
    name, type_, made = payload
    out = T.StructType([source.schema["doc"]]).add("start", "long").add("length", "long").add(name, T._parse_datatype_string(type_)).add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, opened = to_arrow_schema(out), zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        held = 0

        def full() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc, packed, rank, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _wide(opened.decompress(packed))
                n = len(raw) // 4
                parts = [(k * window, window, slots.whole + before + k, 0) for k in range(n // window)]
                if n % window:
                    parts += [(n - n % window + a, b, c, d) for a, b, c, d in slots.pieces(n % window, rank)]
                rows += [(doc, a, b, made(raw[4 * a : 4 * (a + b)]), n, c, d) for a, b, c, d in parts]
                held += n
                if held > OUT_TOKENS:
                    yield full()
                    rows, held = [], 0
        yield full()

    return joined.mapInArrow(cut, out).withColumnRenamed("doc", id)

"""Counts of all n-grams of a corpus, brought back to the texts that hold them.

Texts are read into blocks: a vocabulary and the numbers of its words in sequence. Each block sends a hash and a count
of each distinct n-gram to the bucket of the hash; the bucket adds up what all blocks sent and answers each of them with
the totals in the order asked. An answer is a few bits a gram, since the block knows its own grams. No vocabulary and no
table of n-grams is ever whole in one place, and a frequent gram is one entry a block, so no bucket is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices, written

BLOCK_TOKENS = 1_500_000
BUCKET_GRAMS = 1_000_000
#: Stands between sequences; a byte that no UTF-8 text holds.
BREAK = b"\xff"
LEVEL_BITS = 3  # of a hash: how many words the gram has
SHORTER_BITS = 8  # left out of a hash of several words; of n grams one in 2 ** 56 / n shares its hash with another


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as compressed planes of bytes."""
    if not len(numbers):
        return b""
    numbers = np.ascontiguousarray(numbers, "<u8")
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


class Numbered(dict):
    """Number of each word of one space; `words` is the vocabulary that all spaces share."""

    def __init__(self, space: int, words: list[tuple[int, bytes]]) -> None:
        super().__init__({BREAK: 0})
        self.space, self.words = space, words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append((self.space, word))
        return n


class Block(NamedTuple):
    tokens: np.ndarray  # numbers of words in sequence, 0 between sequences
    sizes: np.ndarray  # tokens of each text, breaks included
    counted: np.ndarray  # of each text, whether it counts
    spaces: list[str]  # words of different spaces are different
    space: np.ndarray  # of each word; the first entry is the break
    words: list[bytes]

    def hashes(self) -> np.ndarray:
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.spaces]
        return np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) for k, w in zip(self.space.tolist(), self.words, strict=True)], np.uint64)


FIELDS = "block long, size long, tokens binary, sizes binary, counted binary, spaces array<string>, space binary, words binary"


def opened(row: dict) -> Block:
    words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
    return Block(unpack(row["tokens"]), unpack(row["sizes"]), unpack(row["counted"]).astype(bool), row["spaces"], unpack(row["space"]), words)


def make_blocks(docs: DataFrame, read: Callable[[bytes], list[bytes]]) -> DataFrame:
    """One row per block with FIELDS and `docs`, the ids of its texts, as a table in the shared folder.

    docs has the columns doc, space (string), counted (boolean) and text (binary). read gives the words of a text, none
    with a line break inside, and BREAK between sequences; a break follows each text.
    """
    kind = T.StructType.fromDDL(FIELDS).add("docs", T.ArrayType(docs.schema["doc"].dataType))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, made = to_arrow_schema(kind), TaskContext.get().partitionId(), 0

        def fresh() -> tuple:
            return {}, [(0, BREAK)], [], [], [], []

        def full() -> pa.RecordBatch:
            nonlocal made, spaces, words, tokens, sizes, counted, ids
            row = {
                "block": (part << 32) + made, "size": sum(sizes), "docs": ids, "tokens": pack(np.concatenate(tokens)), "sizes": pack(np.array(sizes)),
                "counted": pack(np.array(counted)), "spaces": list(spaces), "space": pack(np.array([k for k, _ in words])),
                "words": zstandard.ZstdCompressor().compress(b"\n".join(w for _, w in words)),
            }
            made += 1
            spaces, words, tokens, sizes, counted, ids = fresh()
            return pa.RecordBatch.from_pylist([row], arrow)

        spaces, words, tokens, sizes, counted, ids = fresh()
        held = 0
        for batch in slices(batches):
            for doc, space, counts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = spaces.get(space)
                if known is None:
                    known = spaces[space] = Numbered(len(spaces), words)
                found = list(map(known.__getitem__, read(text or b"")))
                found.append(0)
                tokens.append(np.array(found, np.int32))
                sizes.append(len(found))
                counted.append(counts)
                ids.append(doc)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield full()
                    held = 0
        if ids:
            yield full()

    return written(docs.select("doc", "space", "counted", "text").mapInArrow(build, kind))


class Level(NamedTuple):
    """The distinct grams of one length in a block."""

    at: np.ndarray  # of each token, the gram that starts there, -1 where a sequence ends before
    parent: np.ndarray  # of each gram, that of its words but the last
    last: np.ndarray  # its last word
    key: np.ndarray  # parent * words + last, ascending


def next_level(before: Level, tokens: np.ndarray, words: int, k: int, places: np.ndarray) -> Level:
    """Level of k words from the level before it, for the grams that start at the given places."""
    key, which = np.unique(before.at[places].astype(np.int64) * words + tokens[places + k - 1], return_inverse=True)
    at = np.full(len(tokens), -1, np.int32)
    at[places] = which
    return Level(at, (key // words).astype(np.int32), (key % words).astype(np.int32), key)


def gram_levels(tokens: np.ndarray, words: int, levels: int) -> list[Level]:
    """Levels of 1, 2, ... words. The grams of level 1 are the words themselves, the break among them with no place."""
    own = np.arange(words, dtype=np.int64)
    found = [Level(np.where(tokens > 0, tokens, -1).astype(np.int32), np.zeros(words, np.int32), own.astype(np.int32), own)]
    for k in range(2, levels + 1):
        starts = max(0, len(tokens) - k + 1)
        places = np.flatnonzero((found[-1].at[:starts] >= 0) & (tokens[len(tokens) - starts :] > 0))
        found.append(next_level(found[-1], tokens, words, k, places))
    return found


def gram_hashes(levels: list[Level], hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the grams of each level in turn."""
    plain = mix(hashes)
    for k, level in enumerate(levels, 1):
        if k > 1:
            plain = mix(plain[level.parent] * np.uint64(0x9E3779B97F4A7C15) + hashes[level.last])
        kept = LEVEL_BITS if k == 1 else SHORTER_BITS
        yield (plain >> np.uint64(kept) << np.uint64(kept)) | np.uint64(k)


def shard(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def count_grams(blocks: DataFrame, levels: int) -> DataFrame:
    """Answers of all buckets: block, bucket, totals (packed, in the order of the block's hashes), and of each bucket one row
    with block -1 and in `words`, `tokens` its distinct words that were counted at all and how often they were, together.

    A table in the shared folder.
    """
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size * levels / BUCKET_GRAMS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = opened(row)
                found = gram_levels(block.tokens, len(block.words), levels)
                counted = np.repeat(block.counted, block.sizes)
                for level, (grams, hashes) in enumerate(zip(found, gram_hashes(found, block.hashes()), strict=True), 1):
                    order = np.argsort(hashes)
                    hashes, counts = hashes[order], gram_totals(grams, counted)[order]
                    ends = np.searchsorted(shard(hashes, buckets), np.arange(buckets + 1))
                    asked = np.flatnonzero(np.diff(ends)).tolist()
                    cut = [slice(ends[b], ends[b + 1]) for b in asked]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["block"]] * len(asked), pa.int64()), pa.array([level] * len(asked), pa.int32()), pa.array(asked, pa.int64()),
                        pa.array([pack(np.diff(hashes[x], prepend=np.uint64(0))) for x in cut], pa.binary()), pa.array([pack(counts[x]) for x in cut], pa.binary()),
                    ], names=["block", "level", "bucket", "hashes", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        block = asked.column("block").to_pylist()
        hashes = [np.cumsum(unpack(x).view(np.uint64)) for x in asked.column("hashes").to_pylist()]
        counts = np.concatenate([unpack(x) for x in asked.column("counts").to_pylist()])
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, which, counts)
        ends = np.cumsum([0, *(len(h) for h in hashes)])
        single = (distinct & np.uint64((1 << LEVEL_BITS) - 1)) == 1
        sent = [pack(totals[which[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({
            "block": pa.array([*block, -1], pa.int64()), "level": pa.array([*asked.column("level").to_pylist(), 0], pa.int32()),
            "bucket": pa.array([*asked.column("bucket").to_pylist(), asked.column("bucket")[0].as_py()], pa.int64()),
            "totals": pa.array([*sent, None], pa.binary()), "words": pa.array([0] * len(block) + [int((totals[single] > 0).sum())], pa.int64()),
            "tokens": pa.array([0] * len(block) + [int(totals[single].sum())], pa.int64()),
        })

    asked = blocks.mapInArrow(ask, "block long, level int, bucket long, hashes binary, counts binary")
    return written(asked.groupBy("bucket").applyInArrow(answer, "block long, level int, bucket long, totals binary, words long, tokens long"))


def gram_totals(level: Level, counted: np.ndarray) -> np.ndarray:
    """How often each gram of a level starts at a counted token."""
    at = level.at[counted]
    return np.bincount(at[at >= 0], minlength=len(level.key))


def with_totals(blocks: DataFrame, answers: DataFrame, use: Callable[[dict, Block, list[Level], list[np.ndarray]], pa.Table], levels: int, schema: T.StructType | str) -> DataFrame:
    """use(row, block, its levels, the corpus totals of each level's grams) for every block."""
    both = blocks.unionByName(answers.where("block >= 0").select("block", "level", "bucket", "totals"), allowMissingColumns=True)

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = rows.filter(rows.column("tokens").is_valid()).drop_columns(["level", "bucket", "totals"]).to_pylist()[0]
        given = rows.filter(rows.column("tokens").is_null()).select(["level", "bucket", "totals"]).sort_by("bucket")
        block = opened(own)
        found = gram_levels(block.tokens, len(block.words), levels)
        totals = []
        for level, hashes in enumerate(gram_hashes(found, block.hashes()), 1):
            answered = given.filter(pc.equal(given.column("level"), level)).column("totals").to_pylist()
            total = np.zeros(len(hashes), np.int64)
            if answered:
                total[np.argsort(hashes)] = np.concatenate([unpack(x) for x in answered])
            totals.append(total)
        return use(own, block, found, totals)

    return both.groupBy("block").applyInArrow(meet, schema)

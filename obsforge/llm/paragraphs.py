"""Removal of repeated passages: overlapping paragraphs meet by MinHash bands, and are linked by exact Jaccard similarity.

A paragraph is a run of whole sentences of at least sixteen words, and one begins at every sentence. Where sentences end is
not the same in every text that a passage is copied into, and some texts have no marks. So there also are fixed runs of 26
words that begin where a hash is the least of 26 in sequence: any 51 words hold one that depends on nothing else. Fixed runs
meet if they are equal. Most paragraphs occur once: a first pass keeps the documents' paragraphs that share a MinHash value
(fixed runs: all words) with another one, and of them the sentences are banded, joined and verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_split, mix, slices, written
from .components import connected_components, forest
from .decontaminate import FOLD
from .jaccard import BLOCK, groups, in_block_pairs, shared_counts
from .repeats import BUFFER, buffers, cut_spans, keyed_texts, known_by_document, pack_hints, sliding

SHINGLE = 5
LEAST_WORDS = 16
SIEVE = 3  # values of which one must be shared; all differ at similarity 0.8 with probability 0.2**3
FOLDS = np.frombuffer(FOLD, np.uint8)
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
FEW = 8  # members up to which sets are met one by one
APART = 6  # words before a sentence's end without a mark, so that paragraphs in sequence differ enough
SOFT = 32  # a word in so many ends a sentence by its hash, for texts without marks
FIXED = 26  # words of a fixed run, and hashes of which the least begins one: those in sequence leave no gap


def tune_bands(threshold: float, miss: float, most: int = 64, rows: int = 2) -> int:
    """Bands of `rows` values for which a pair at the threshold shares none with at most the probability `miss`."""
    return next(b for b in range(1, most + 1) if (1 - threshold**rows) ** b <= miss or b == most)


@lru_cache(maxsize=2)
def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x100000001B3
    return tuple(np.cumprod(np.full(size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


class Paragraphs(NamedTuple):
    number: np.ndarray  # of the text, in its batch
    start: np.ndarray  # bytes of the text
    size: np.ndarray
    words: np.ndarray
    first: np.ndarray  # first and past-last shingle in the buffer
    last: np.ndarray
    fixed: np.ndarray  # a fixed run, not whole sentences; these come last


def fixed_heads(shingles: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """First words of fixed runs: the least shingles of any FIXED in sequence. whole: of each such window, if it counts."""
    if not len(whole):
        return np.zeros(0, np.int64)
    low = np.where(whole, sliding(np.minimum, shingles, FIXED), np.uint64(0))
    edge = np.zeros(FIXED - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, low, edge]), FIXED) == shingles)


def read_paragraphs(texts: list[bytes], least: int = LEAST_WORDS, bound: int = BUFFER, overlap: int = 1 << 14) -> Iterator[tuple[np.ndarray, Paragraphs]]:
    """Per buffer: hashes of runs of five words, and the paragraphs, fixed runs after those of sentences. A text beyond the bound is read in parts that overlap."""
    for data, number, place, ends in buffers(texts, 1, bound, overlap):
        begins = ends - np.diff(np.concatenate([[0], ends]))
        folded = FOLDS[data]
        inside = folded != 32
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Parts are put end to end without a blank: a word never crosses a part's end.
        inner = begins[1:][inside[begins[1:]] & inside[begins[1:] - 1]]
        at, to = np.sort(np.concatenate([at, inner])), np.sort(np.concatenate([to, inner]))
        if len(at) < SHINGLE:
            continue
        powers, inverse = (x[: len(data) + 1] for x in power_tables(1 << int(len(data) + 1).bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
        word = mix((total[to] - total[at]) * inverse[at] + (to - at).astype(np.uint64))
        part = np.searchsorted(ends, at, "right")
        marks = np.concatenate([[0], np.cumsum(ENDS[data])])
        following = np.concatenate([at[1:], [len(data)]])
        marked = marks[following] > marks[to]
        before = np.concatenate([np.zeros(APART, bool), marked])
        close = marked & ~np.any([before[k : k + len(marked)] for k in range(APART)], 0) | (word % np.uint64(SOFT) == 0)
        # What stands before a part is not known, so its first words end no sentence; the part before has them too.
        lead = np.arange(len(at)) - np.searchsorted(part, part, "left")
        close &= (place[part] == 0) | (lead >= APART)
        close[:-1] |= part[1:] != part[:-1]
        close[-1] = True
        past = np.flatnonzero(close) + 1  # past-last words of sentences
        head = np.concatenate([[0], past[:-1]])
        tail = np.searchsorted(past, head + least)
        good = tail < len(past)
        head, tail = head[good], past[tail[good]]
        runs = np.zeros(len(word) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(runs)]
        runs = mix(runs)
        # In a part, what its edges cut through is left to the parts beside it.
        opens = np.concatenate([[True], part[1:] != part[:-1]]) & (place[part] > 0)
        sizes = np.array([len(x) for x in texts])
        closes = np.concatenate([part[1:] != part[:-1], [True]]) & (place[part] + ends[part] - begins[part] < sizes[number[part]])
        reach = FIXED + SHINGLE - 1  # words of a window
        heads = fixed_heads(runs, (part[reach - 1 :] == part[: 1 - reach]) & ~closes[reach - 1 :] & ~opens[: 1 - reach])
        heads = heads[heads + max(FIXED, least) <= len(word)]
        fixed = np.repeat([False, True], [len(head), len(heads)])
        head, tail = np.concatenate([head, heads]), np.concatenate([tail, heads + max(FIXED, least)])
        good = (part[head] == part[tail - 1]) & ~opens[head] & ~closes[tail - 1]
        head, tail, fixed = head[good], tail[good], fixed[good]
        if not len(head):
            continue
        p = part[head]
        stop = np.minimum(np.where(tail < len(at), at[np.minimum(tail, len(at) - 1)], len(data)), ends[p])
        yield runs, Paragraphs(number[p], place[p] + at[head] - begins[p], stop - at[head], tail - head, head, tail - SHINGLE + 1, fixed)


def gather_runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = last - first
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow column of the bytes between the offsets."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def minima(shingles: np.ndarray, paragraphs: Paragraphs, lane: int) -> np.ndarray:
    """One MinHash value of each paragraph."""
    values = np.append(mix(shingles * np.uint64(2 * lane + 1) + np.uint64(lane)), np.uint64(0))
    bounds = np.stack([paragraphs.first, paragraphs.last], 1).ravel()
    return np.minimum.reduceat(values, bounds)[::2]


def fixed_values(shingles: np.ndarray, paragraphs: Paragraphs) -> np.ndarray:
    """One hash of all words of each fixed run."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(shingles)])
    own = paragraphs.fixed
    return mix(total[paragraphs.last[own]] - total[paragraphs.first[own]])


def split_fixed(paragraphs: Paragraphs) -> tuple[Paragraphs, Paragraphs]:
    """Paragraphs of sentences, and fixed runs."""
    n = len(paragraphs.fixed) - int(paragraphs.fixed.sum())
    return Paragraphs(*[x[:n] for x in paragraphs]), Paragraphs(*[x[n:] for x in paragraphs])


def counted(low: np.ndarray, paragraphs: Paragraphs) -> np.ndarray:
    """Whether a paragraph's value counts: it is not that of the one before, or some before it that share it end where this begins."""
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (paragraphs.number[1:] != paragraphs.number[:-1])])[: len(low)]
    run = np.cumsum(fresh) << 33  # each run's ends lie below those of the one before, so that the least starts anew
    least = np.minimum.accumulate(paragraphs.start + paragraphs.size - run)
    return fresh | np.concatenate([[False], paragraphs.start[1:] - run[1:] >= least[:-1]])[: len(low)]


def sieve_values(docs: DataFrame, least: int) -> DataFrame:
    """(m, hints): MinHash values of sentences and hashes of fixed runs, with the documents they come from.

    Paragraphs of sentences in sequence that share a value count once as long as they overlap.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            hint = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            for shingles, found in read_paragraphs([(x or "").encode() for x in batch.column(1).to_pylist()], least):
                found, runs = split_fixed(found)
                values, numbers = [fixed_values(shingles, runs)], [runs.number]
                for lane in range(SIEVE if len(found.number) else 0):
                    low = minima(shingles, found, lane)
                    fresh = counted(low, found)
                    values.append(low[fresh])
                    numbers.append(found.number[fresh])
                yield pack_hints(np.concatenate(values), hint[np.concatenate(numbers)])

    return docs.select("hint", "text").mapInArrow(emit, "m long, hints binary")


def sieved_paragraphs(packed: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(set, doc, part, start, size, shingles) of the paragraphs that share a value with another one; fixed runs without shingles."""
    joined = packed.join(known, "hint").select("doc", "part", "packed", "known")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            seen = [np.array(x, np.int64) for x in batch.column(3).to_pylist()]
            for shingles, found in read_paragraphs([opened.decompress(x) for x in batch.column(2).to_pylist()], least):
                sentences, own = split_fixed(found)
                lows = [minima(shingles, sentences, lane) if len(sentences.number) else np.zeros(0, np.uint64) for lane in range(SIEVE)]
                lows = np.concatenate([np.stack(lows), np.tile(fixed_values(shingles, own), (SIEVE, 1))], 1).view(np.int64)
                stay = np.zeros(len(found.number), bool)
                cuts = np.flatnonzero(np.diff(found.number)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(stay)], strict=True):
                    stay[a:b] = np.isin(lows[:, a:b], seen[found.number[a]]).any(0)
                at = np.flatnonzero(stay)
                first, last = found.first[at], found.last[at]
                runs = gather_runs(first, last)
                own, rows = shingles[runs], pa.array(found.number[at])
                offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
                # A set is named by two sums over its hashes; of each hash four bytes are kept, enough among a few dozen.
                ends, fixed = offsets[:-1], found.fixed[at]
                names = np.stack([np.add.reduceat(mix(own + np.uint64(k)), ends) if len(at) else own for k in (11, 12)], 1)
                names[:, 0] ^= fixed.astype(np.uint64)  # a fixed run is never of the class of whole sentences
                kept = gather_runs(first[~fixed], last[~fixed])
                offsets = np.concatenate([[0], np.cumsum(np.where(fixed, 0, last - first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [binary(names, np.arange(0, 16 * len(at) + 1, 16)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.start[at]), pa.array(found.size[at]), binary((shingles[kept] >> np.uint64(32)).astype(np.uint32), 4 * offsets)],
                    names=["set", "doc", "part", "start", "size", "shingles"],
                )

    kind = packed.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(emit, f"set binary, doc {kind}, part long, start long, size long, shingles binary")


def linked_classes(classes: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(node, root): classes of equal paragraphs, joined where they share a band and their exact similarity is high enough."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            raw = batch.column(1).to_pylist()
            starts = np.cumsum([0] + [len(x) // 4 for x in raw])[:-1]
            values = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
            keys = np.zeros((len(raw), bands), np.uint64)
            for b in range(bands):
                for lane in range(b * rows, b * rows + rows):
                    keys[:, b] = mix(keys[:, b] + np.minimum.reduceat(mix(values * np.uint64(2 * lane + 201) + np.uint64(lane)), starts) + np.uint64(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], names=["set", "bands"])

    banded = written(classes.select("set", "shingles").mapInArrow(band, "set binary, bands array<long>"))
    keys = banded.select("set", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set")).alias("x"), F.sum(F.hash("set").cast("long")).alias("y")).where("size > 1")
    distinct = shared.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = written(keys.join(distinct, "bucket")).join(classes.select("set", "shingles"), "set")
    pairs = in_block_pairs(members, "bucket", F.ceil(F.col("size") / BLOCK), "set", "shingles")
    limit = round(threshold * 1000)

    def links(found: list[tuple], i: int, j: int) -> Iterator[tuple[bytes, bytes]]:
        if len(found) <= FEW:
            own = [set(memoryview(r[2]).cast("I")) for r in found]
            for x, y in itertools.combinations(range(len(found)), 2):
                both = len(own[x] & own[y])
                if 1000 * both >= limit * (len(own[x]) + len(own[y]) - both):
                    yield found[x][1], found[y][1]
            return
        block, sets = np.array([r[0] for r in found]), [np.unique(np.frombuffer(r[2], np.uint32)) for r in found]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(left) and len(right):
            sizes = np.array([len(x) for x in sets])
            both = shared_counts([sets[k] for k in left], [sets[k] for k in right])
            a, b = np.nonzero(1000 * both >= limit * (sizes[left][:, None] + sizes[right][None, :] - both))
            label = forest(len(found), left[a], right[b])
            yield from ((found[k][1], found[label[k]][1]) for k in np.flatnonzero(label != np.arange(len(found))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (pair for (_, i, j), found in groups(slices(batches, 2000), 3) for pair in links(found, i, j))
        while some := list(itertools.islice(every, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.binary()), pa.array([b for _, b in some], pa.binary())], names=["a", "b"])

    return connected_components(pairs.mapInArrow(verify, "a binary, b binary"))


def drop_repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, least: int = LEAST_WORDS, miss: float = 0.003) -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (start and size of each maximal removed run, in bytes), kept (bytes left).

    Paragraphs of whole sentences are linked at the threshold, fixed runs if they are equal; of each component the first, by id and then place, stays with those of the same
    document that overlap it, and all others go with the blanks behind them. Words are folded as in decontamination. A null
    text is empty, a null id smallest; texts below `least` words have no paragraph. Rows that agree in id and text are one
    document; rows that agree in id only are ordered by a hash of the text.
    """
    base, packed = keyed_texts(docs, id, text)
    once = packed.dropDuplicates(["hint", "doc", "part"])
    found = written(sieved_paragraphs(once, known_by_document(sieve_values(base, least)), least))
    order = F.struct("doc", "part", "start", "size")
    classes = written(found.groupBy("set").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("shingles").alias("shingles")))
    roots = linked_classes(classes.where(F.length("shingles") > 0), threshold, tune_bands(threshold, miss), 2)
    labelled = classes.select("set", "first", "copies").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = labelled.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("copies")).where("copies > 1").select("root", "head")
    members = found.select("set", "doc", "part", "start", "size").join(join_split(labelled.select("set", "root"), heads, ["root"]).select("set", "head"), "set")
    itself = F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("part") == F.col("head.part"))
    over = (F.col("start") < F.col("head.start") + F.col("head.size")) & (F.col("head.start") < F.col("start") + F.col("size"))
    late = members.where(~(itself & over)).groupBy("doc", "part").agg(F.collect_set(F.struct("start", "size")).alias("late"))
    return cut_spans(packed, written(late), id)

"""Similarity join of texts by the Jaccard measure of their word 5-grams, with Bayesian pruning of candidates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, mix, slices, written
from .components import connected_components, forest
from .decontaminate import words_of

SHINGLE = 5
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6
HASHES = BANDS * ROWS
STEP = 16  # hashes compared between two looks at the posterior
BLOCK = 256  # members of a block; a group's blocks are compared two by two
BLOCK_SHINGLES = 2_000_000
MULTIPLIERS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
OFFSETS = (mix(np.arange(10_001, HASHES + 10_001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingles_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words; a text of one to four words is one run, one without words none."""
    words = words_of(text)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(ids))
    if not size:
        return ids
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x100000001B3) + ids[k : k + len(total)]
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 4096):
        low = np.minimum(low, (MULTIPLIERS[:, None] * short[None, start : start + 4096] + OFFSETS[:, None]).min(1))
    return low


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES) -> list[int]:
    """For n compared hashes, the fewest matches at which similarity >= threshold is still likelier than the tolerance.

    With a uniform prior the posterior after m matches of n is a beta distribution, and its tail above the threshold is
    the probability of at most m successes in n + 1 trials at the threshold.
    """
    table = []
    for n in range(hashes + 1):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append(m)
    return table


def prune(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows that no look at the posterior has dropped."""
    matches = (left[:, None, :STEP] == right[None, :, :STEP]).sum(2)
    a, b = np.nonzero(matches >= least[STEP])
    matches = matches[a, b]
    for start in range(STEP, left.shape[1], STEP):
        matches = matches + (left[a, start : start + STEP] == right[b, start : start + STEP]).sum(1)
        stay = matches >= least[min(start + STEP, left.shape[1])]
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of bounded incidence matrices."""
    known = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)))
    places = [[np.searchsorted(known, s[np.isin(s, known, assume_unique=True)]) for s in side] for side in (left, right)]
    for start in range(0, len(known), slab):
        width = min(slab, len(known) - start)
        sides = []
        for side in places:
            matrix = np.zeros((len(side), width), np.float32)
            for row, at in zip(matrix, side, strict=True):
                row[at[np.searchsorted(at, start) : np.searchsorted(at, start + width)] - start] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    return total


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition, put together by their first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, found in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in found]


def in_block_pairs(members: DataFrame, group: str, blocks, *columns: str) -> DataFrame:
    """Rows of each group, sent to every pair of the group's blocks that theirs is part of: (group, i, j, block, columns)."""
    block = F.pmod(F.xxhash64("set"), F.col("blocks"))
    spread = members.withColumn("blocks", blocks.cast("long")).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = [group, "i", "j"]
    paired = spread.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return paired.repartition(*keys).sortWithinPartitions(*keys)


def sketch_texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, part, set, n, signature): set is a 128-bit hash of the shingle set, n its size, part a hash of the text."""
    source = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = []
            for value in batch.column(2).to_pylist():
                found = shingles_of(value)
                sets.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), signature(found).tobytes()))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*sets, strict=True) if sets else [[]] * 3, (pa.binary(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "part", "set", "n", "signature"])

    return source.mapInArrow(sketch, f"doc {source.schema['doc'].dataType.simpleString()}, part long, set binary, n int, signature binary")


def candidate_groups(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root) over classes: pairs that share a band and that Bayesian pruning leaves lie in one group.

    Buckets with the same members in several bands are compared once. A large bucket is compared block by block, and a
    task gives a spanning forest of the pairs it leaves, never the pairs.
    """
    bands = classes.where("n > 0").select("set", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.select("set", F.expr(f"xxhash64(band, substring(signature, band * {4 * ROWS} + 1, {4 * ROWS}))").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set")).alias("x"), F.sum(F.hash("set").cast("long")).alias("y")).where("size > 1")
    distinct = shared.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = bands.join(distinct, "bucket").join(classes.select("set", "signature"), "set")
    pairs = in_block_pairs(members, "bucket", F.ceil(F.col("size") / BLOCK), "set", "signature")
    least = least_matches(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groups(batches, 3):
            sets = [r[1] for r in rows]
            marks = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), HASHES)
            block = np.array([r[0] for r in rows])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = prune(marks[left], marks[right], least)
            label = forest(len(rows), left[a], right[b])
            moved = np.flatnonzero(label != np.arange(len(rows)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array([sets[k] for k in moved], pa.binary()), pa.array([sets[k] for k in label[moved]], pa.binary())], names=["a", "b"])

    return connected_components(pairs.mapInArrow(compare, "a binary, b binary"))


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per row of docs: id, class_id, n_links (other documents at the threshold or above), component_id, and
    text_hash and kept: whether this is its component's first document (that of the smallest id).

    A class is the documents with one shingle set, named by its smallest id; a component is what links reach, named
    likewise (null ids count only where there is no other). Words are runs of ASCII letters and digits and of all other
    characters beyond ASCII, ASCII letters lower-cased. Links are verified exactly, over all pairs of a candidate group.
    Null texts and texts without words link with nothing, not with each other either. Repeated rows are copies of each
    other. An empty table gives no rows.
    """
    sketches = written(sketch_texts(docs, id, text))
    per_class = sketches.groupBy("set").agg(F.min(F.struct("doc", "part")).alias("first"), F.min("doc").alias("class_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(per_class)
    rooted = candidate_groups(classes, threshold, tolerance)
    grouped = written(rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct()))
    sizes = grouped.join(classes.select(F.col("set").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    wanted = join_split(grouped, sizes, ["root"]).join(classes.select(F.col("set").alias("node"), "first", "copies"), "node")
    wanted = wanted.select("root", F.col("node").alias("set"), "copies", blocks.alias("blocks"), "first.doc", "first.part")
    whole = docs.select(F.col(id).alias("d"), F.xxhash64(text).alias("p"), F.col(text).alias("text"))
    ready = whole.join(wanted, F.col("d").eqNullSafe(F.col("doc")) & (F.col("p") == F.col("part"))).dropDuplicates(["set"])
    ready = ready.select("root", "set", "copies", "blocks", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles_of(x).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["root", "set", "copies", "blocks", "shingles"])

    cuts = ready.mapInArrow(cut, "root binary, set binary, copies long, blocks long, shingles binary")
    limit = round(threshold * 1000)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groups(batches, 3):
            sets, copies = [r[1] for r in rows], np.array([r[2] for r in rows])
            found = [np.frombuffer(r[3], np.uint64) for r in rows]
            block, sizes = np.array([r[0] for r in rows]), np.array([len(x) for x in found])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            shared = shared_counts([found[k] for k in left], [found[k] for k in right])
            union = sizes[left][:, None] + sizes[right][None, :] - shared
            linked = 1000 * shared >= limit * union
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(rows), np.int64)
            links[left] += linked @ copies[right]
            if i != j:
                links[right] += linked.T @ copies[left]
            a, b = np.nonzero(linked)
            label = forest(len(rows), left[a], right[b])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([sets[k] for k in some], pa.binary()), pa.array([sets[k] for k in label[some]], pa.binary()), pa.array(links[some])], names=["a", "b", "links"])

    checked = written(in_block_pairs(cuts, "root", F.col("blocks"), "set", "copies", "shingles").mapInArrow(verify, "a binary, b binary, links long"))
    links = checked.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    roots = connected_components(checked).withColumnRenamed("node", "set")
    per_class = classes.select("set", "first", "class_id", "copies", "n").join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    components = per_class.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("first").alias("head"))
    named = join_split(per_class, components, ["root"]).select("set", "class_id", "component_id", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    worded = F.col("n") > 0
    return sketches.select("doc", "part", "set", "n").join(named, "set").select(
        F.col("doc").alias(id),
        F.when(worded, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
        F.when(worded, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(worded, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        F.col("part").alias("text_hash"),
        (~worded | F.struct("doc", "part").eqNullSafe(F.col("head"))).alias("kept"),
    )

"""Near-duplicate vectors by a flat pruned graph.

Vectors go to the clusters nearest to them, more than one each. Every block of a cluster builds a graph whose edges are
pruned so that no edge is much longer than a way round it; a vector's lists from all its clusters are put together. Each
vector is then searched in the blocks of its clusters: greedily from the block's medoid, and on through everything inside
the range. What is found is verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, join_split, slices, written
from .components import connected_components, forest
from .jaccard import groups

SAMPLE = 20_000  # vectors from which centres are fitted, at most
PER_CLUSTER = 1000  # vectors of a cluster, about
CENTRES = 2048  # at most; clusters beyond their size are cut into blocks
OVERLAP = 3  # clusters of a vector
BLOCK = 2000  # vectors of a block, at most about
DEGREE = 24  # edges of a vector in one block
SLACK = 1.2  # an edge goes if a kept neighbour is nearer to its end by this factor
BEAM = 48
AUDITS = (400, 1600, 6400)  # vectors compared with all others, until enough of them have a partner
PARTNERED = 60  # vectors with a partner that are enough to tell the recall
CAUTION = 4  # so many times the overlap where too few are seen to tell
STRAY = 0.15  # how far below the range a search still goes on


def usable(values: list | np.ndarray | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, zero or holds null or non-finite components."""
    if values is None or any(x is None for x in values):
        return None
    vector = np.asarray(values, np.float64)
    if not len(vector) or not np.isfinite(vector).all():
        return None
    top = np.abs(vector).max()
    if not top:
        return None
    vector = vector / top
    return vector / np.sqrt(vector @ vector)


def fit_centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first `count` vectors."""
    centres = vectors[:count].copy()
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def pruned_graph(vectors: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Neighbours of each vector: the nearest first, without those that a kept neighbour is nearer to by the slack."""
    n = len(vectors)
    edges: list[list[int]] = []
    most = min(n - 1, 3 * degree)
    for start in range(0, n, 512):
        near = vectors[start : start + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -2
        candidates = np.argpartition(-near, most - 1, 1)[:, :most] if most else np.zeros((len(near), 0), np.int64)
        for row, found in zip(near, candidates, strict=True):
            found = found[np.argsort(-row[found], kind="stable")]
            away = np.sqrt(np.maximum(0, 2 - 2 * row[found]))
            between = np.sqrt(np.maximum(0, 2 - 2 * vectors[found] @ vectors[found].T))
            open_, kept = np.ones(len(found), bool), []
            for k in range(len(found)):
                if open_[k]:
                    kept.append(int(found[k]))
                    open_ &= slack * between[k] > away
                    if len(kept) == degree:
                        break
            edges.append(kept)
    both: list[set[int]] = [set(x) for x in edges]
    for a, found in enumerate(edges):
        for b in found:
            both[b].add(a)
    return [np.array(sorted(x), np.int64) for x in both]


def padded(edges: list[np.ndarray]) -> np.ndarray:
    """Lists of edges as rows of one length; a vector fills its own row up with itself."""
    out = np.repeat(np.arange(len(edges))[:, None], max([1, *map(len, edges)]), 1)
    for row, found in zip(out, edges, strict=True):
        row[: len(found)] = found
    return out


def search_range(queries: np.ndarray, vectors: np.ndarray, edges: np.ndarray, entry: int, threshold: float, opened_least: int = BEAM) -> np.ndarray:
    """(query, vector) pairs at the threshold or above, all queries stepping together.

    A query opens the best vector it has seen and not opened yet, at least so many times, and then goes on through all that
    lies in the range or a little below it. Only vectors that an edge leads to are compared with the query.
    """
    every = np.arange(len(queries))
    scores = np.full((len(queries), len(vectors)), -2.0)
    opened = np.zeros(scores.shape, bool)
    scores[:, entry] = queries @ vectors[entry]
    for _ in range(min(opened_least, len(vectors))):
        best = np.where(opened, -3.0, scores).argmax(1)
        opened[every, best] = True
        ahead = edges[best]
        scores[every[:, None], ahead] = np.einsum("qd,qkd->qk", queries, vectors[ahead])
    while True:
        q, x = np.nonzero((scores >= threshold - STRAY) & ~opened)
        if not len(q):
            break
        opened[q, x] = True
        reach = np.zeros(scores.shape, bool)
        reach[q[:, None], edges[x]] = True
        q, x = np.nonzero(reach & (scores == -2.0))
        for k in range(0, len(q), 50_000):
            a, b = q[k : k + 50_000], x[k : k + 50_000]
            scores[a, b] = np.einsum("kd,kd->k", queries[a], vectors[b])
    return np.argwhere(scores >= threshold)


def unit_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec, set, unit, dim) of every row: its length-one vector as bytes and a hash of them, null if it is not usable."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            found = [usable(x) for x in batch.column(1).to_pylist()]
            raw = [None if x is None else x.tobytes() for x in found]
            sets = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            dims = [None if x is None else len(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=["vec", "set", "unit", "dim"])

    source = vectors.select(F.col(id).alias("vec"), F.col(vector).alias("vector"))
    kind = source.schema["vec"].dataType.simpleString()
    return source.mapInArrow(convert, f"vec {kind}, set binary, unit binary, dim int")


def stacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def in_clusters(classes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(cluster, set, unit, copies, homes): a row for each of the clusters nearest to a vector; homes are all of them."""
    overlap = min(overlap, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            near = stacked(batch.column(1).to_pylist()) @ centres.T
            homes = np.sort(np.argpartition(-near, overlap - 1, 1)[:, :overlap], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(homes), pa.list_(pa.int32()))], names=["set", "unit", "copies", "homes"])

    placed = classes.select("set", "unit", "copies").mapInArrow(assign, "set binary, unit binary, copies long, homes array<int>")
    return placed.select(F.explode("homes").alias("cluster"), "set", "unit", "copies", "homes")


def link_classes(classes: DataFrame, centres: np.ndarray, overlap: int, threshold: float) -> DataFrame:
    """(a, b, links, peers): a vector, one that it reaches by links, and how many vectors it is linked to, with copies and
    without, in parts to be added up."""
    members = written(in_clusters(classes, centres, overlap))
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = join_split(members, sizes, ["cluster"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    keys = ["cluster", "block"]
    dealt = members.select(*keys, "set", "unit").repartition(*keys).sortWithinPartitions(*keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(slices(batches, 2000), 2):
            sets = [r[0] for r in rows]
            lists = [[sets[k] for k in found] for found in pruned_graph(stacked([r[1] for r in rows]))]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["set", "edges"])

    graph = dealt.mapInArrow(build, "set binary, edges array<binary>")
    united = graph.groupBy("set").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    united = written(united)
    spread = members.join(united, "set").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["cluster", "i", "j"]
    pairs = spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "unit", "copies", "homes", "edges")
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, i, j), rows in groups(slices(batches, 1000), 3):
            found, links, peers = search_blocks(rows, cluster, i, j, threshold)
            sets = [r[1] for r in rows]
            label = forest(len(rows), found[:, 0], found[:, 1])
            some = np.flatnonzero(links | (label != np.arange(len(rows))))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([sets[k] for k in some], pa.binary()), pa.array([sets[k] for k in label[some]], pa.binary()), pa.array(links[some]), pa.array(peers[some])], names=["a", "b", "links", "peers"])

    return pairs.mapInArrow(search, "a binary, b binary, links long, peers long")


def search_blocks(rows: list[tuple], cluster: int, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs of a cluster's blocks i and j, and each row's links with copies and without. rows: (block, set, unit, copies, homes, edges).

    A pair that meets in several clusters counts in the first of them.
    """
    block, copies = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links, peers = np.zeros((2, len(rows)), np.int64)
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64), links, peers
    vectors = stacked([r[2] for r in rows])
    place = {rows[k][1]: n for n, k in enumerate(right)}
    edges = padded([np.array([place[x] for x in rows[k][5] if x in place], np.int64) for k in right])
    medoid = int((vectors[right] @ vectors[right].mean(0)).argmax())
    pairs = []
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        hit = search_range(vectors[part], vectors[right], edges, medoid, threshold)
        pairs.append(np.stack([part[hit[:, 0]], right[hit[:, 1]]], 1))
    found = np.concatenate(pairs)
    found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], 1), axis=0)
    homes = np.array([r[4] for r in rows])
    shared = (homes[found[:, 0]][:, :, None] == homes[found[:, 1]][:, None, :]).any(2)
    first = homes[found[:, 0]][np.arange(len(found)), shared.argmax(1)] if len(found) else np.zeros(0)
    once = found[first == cluster]
    np.add.at(links, once[:, 0], copies[once[:, 1]])
    np.add.at(links, once[:, 1], copies[once[:, 0]])
    peers += np.bincount(once.ravel(), minlength=len(rows))
    return found, links, peers


def true_partners(classes: DataFrame, threshold: float, n: int, draws: tuple[int, ...] = AUDITS, needed: int = PARTNERED) -> tuple[dict[bytes, int], bool]:
    """{vector: other distinct vectors in range} of vectors drawn by hash that have any, counted over all rows, and whether
    they are enough to tell: so many, or all there are."""
    for queries in draws:
        drawn = classes.orderBy(F.xxhash64("set"), "set").limit(queries).select("set", "unit").collect()
        if not drawn:
            return {}, True
        asked = stacked([r[1] for r in drawn])

        def count(batches: Iterator[pa.RecordBatch], asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1000):
                near = (stacked(batch.column(0).to_pylist()) @ asked.T >= threshold).sum(0)
                some = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near[some])], names=["query", "n"])

        counted = classes.select("unit").mapInArrow(count, "query long, n long").groupBy("query").sum("n").collect()
        partners = {bytes(drawn[q][0]): total - 1 for q, total in counted if total > 1}  # one is the vector itself
        if len(partners) >= needed or queries >= n:
            return partners, True
    return partners, False


def found_share(partners: dict[bytes, int], linked: DataFrame) -> float:
    """Mean share of these vectors' partners that were found, every vector alike, without copies."""
    if not partners:
        return 1.0
    asked = linked.sparkSession.createDataFrame([(x,) for x in partners], "a binary")
    found = linked.join(F.broadcast(asked), "a").groupBy("a").agg(F.sum("peers")).collect()
    return sum(n / partners[bytes(x)] for x, n in found) / len(partners)


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, overlap: int = OVERLAP, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: id, n_links (other vectors of at least that cosine), component_id (the smallest id that
    links reach, its own included) and kept, whether that is its own.

    Equal directions are one vector with copies. Centres are fitted on at most `sample` vectors, drawn by hash; every vector
    is indexed and searched. Some vectors, more until 60 of them have partners or 6,400 are drawn, are compared with all. If
    the search finds a smaller share of their partners than `recall` on average, it is done again with twice the overlap; if
    fewer had partners, it begins with four times the overlap. Null and zero vectors, vectors with null or non-finite components, and those
    of another length than most link with nothing. A null id is no name: its component's is the smallest other, if there is one.
    """
    units = written(unit_vectors(vectors, id, vector))
    common = units.where(F.col("dim").isNotNull()).groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = common[0] if common else 0
    classes = written(units.where(F.col("dim") == dim).groupBy("set").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec").alias("low")))
    n = classes.count()
    centres = np.zeros((1, dim))
    if n:
        drawn = classes.where(hash_share("set") < min(1.0, sample / n)).select("unit").orderBy(F.xxhash64("unit")).limit(sample).collect()
        drawn = drawn or classes.select("unit").limit(1).collect()
        found = stacked([r[0] for r in drawn])
        centres = fit_centres(found, max(1, min(CENTRES, math.ceil(n / PER_CLUSTER), len(found))))
    partners: dict[bytes, int] = {}
    if overlap < len(centres):
        partners, enough = true_partners(classes, threshold, n)
        overlap *= 1 if enough else CAUTION
    while True:
        linked = written(link_classes(classes, centres, overlap, threshold))
        if overlap >= len(centres) or found_share(partners, linked) >= recall:
            break
        overlap *= 2
    links = linked.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    roots = connected_components(linked).withColumnRenamed("node", "set")
    named = classes.select("set", "copies", "low").join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    lowest = named.groupBy("root").agg(F.min("low").alias("lowest"))
    named = join_split(named, lowest, ["root"]).select("set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "lowest")
    usable_ = units.where(F.col("dim") == dim).select("vec", "set").join(named, "set").select("vec", "links", "lowest")
    rest = units.where(F.coalesce(F.col("dim") != dim, F.lit(True))).select("vec", F.lit(0).cast("long").alias("links"), F.col("vec").alias("lowest"))
    return usable_.unionByName(rest).select(
        F.col("vec").alias(id), F.col("links").alias("n_links"), F.col("lowest").alias("component_id"), F.col("vec").eqNullSafe(F.col("lowest")).alias("kept")
    )

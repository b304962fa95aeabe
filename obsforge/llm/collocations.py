"""Collocations from a weighted de Bruijn graph of the corpus.

Nodes are runs of words, an edge of LONGEST words leads from the node of its first LONGEST - 1 to that of its last. Each place of a
text gives one edge, the longest run of words that starts there; near the end of a piece it is shorter and a correction
of the node it ends in. A node's count is what flows out of it: the counts of the edges that begin with it and the
corrections of its own. So counts of shorter phrases follow from longer ones, level by level, and no phrase is counted twice.

Edges that can't be part of a frequent phrase are cut before they are gathered: module grams adds up hashes of one to SIEVED words
over the corpus and answers each block, and a piece ends for the edges where such a run is rarer than the least count.
A hash count is never under the true one, so no frequent phrase is lost; all counts that are returned come from the edges,
which carry the words themselves.

Unary paths are compacted: a node whose whole flow goes on to one neighbour, or comes from one, is part of the longer phrase.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .grams import BREAK, Block, Level, count_grams, make_blocks, next_level, pack, unpack, with_totals

LONGEST = 5
SIEVED = 3
LEAST = 100
TOP = 2000
BUCKET_TOKENS = 4_000_000  # of the corpus, for each bucket of edges
#: Ends of pieces become line ends, the other white space a space.
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def read_pieces(text: bytes) -> list[bytes]:
    return text.lower().translate(MARKS).replace(b"\n", b" " + BREAK + b" ").split()


def frequent_edges(block: Block, levels: list[Level], totals: list[np.ndarray], least: int) -> list[tuple[Level, np.ndarray]]:
    """Of each size, the level and how often a longest edge of that size starts, of the block's own grams."""
    words, tokens = len(block.words), block.tokens
    frequent = [np.append(total, 0)[level.at] >= least for level, total in zip(levels, totals, strict=True)]  # place -1: none
    size = frequent[0].astype(np.int8)
    for k in range(2, SIEVED + 1):
        size[(size == k - 1) & frequent[k - 1]] = k
    found = list(levels)
    for k in range(SIEVED + 1, LONGEST + 1):
        # one word more, if the run of SIEVED words that ends there is frequent too
        ahead = np.zeros(len(tokens), bool)
        shift = k - SIEVED
        ahead[: max(0, len(tokens) - shift)] = frequent[-1][shift:]
        longer = (size == k - 1) & ahead
        size[longer] = k
        found.append(next_level(found[-1], tokens, words, k, np.flatnonzero(longer)))
    return [(level, np.bincount(level.at[size == k], minlength=len(level.key))) for k, level in enumerate(found, 1)]


def edge_texts(block: Block, counted: list[tuple[Level, np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """The edges as lines of space, size and phrase, and how often each starts; of size 0, all words of a space."""
    wanted, needed = [], np.zeros(0, np.int64)
    for level, n in reversed(counted):  # an edge's text is its parent's and a word
        wanted.append(np.union1d(np.flatnonzero(n), needed))
        needed = np.unique(level.parent[wanted[-1]])
    tokens = np.bincount(block.space[block.tokens[block.tokens > 0]], minlength=len(block.spaces))
    lines, times = [b"%d 0" % k for k in range(len(tokens))], tokens.tolist()
    texts: dict[int, bytes] = {}
    for k, ((level, n), own) in enumerate(zip(counted, reversed(wanted), strict=True), 1):
        last, own = level.last[own].tolist(), own.tolist()
        if k == 1:
            texts = {g: b" " + block.words[g] for g in own}
            space = block.space
        else:
            texts = {g: texts[p] + b" " + block.words[w] for g, p, w in zip(own, level.parent[own].tolist(), last, strict=True)}
            space = space[level.parent]
        here = np.flatnonzero(n)
        lines += [b"%d %d%s" % (s, k, texts[g]) for g, s in zip(here.tolist(), space[here].tolist(), strict=True)]
        times += n[here].tolist()
    return lines, times


def graph_edges(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """(lang, phrase, size, times): the longest edge at every place of a frequent word, added up; of size 0, all words of a lang.

    Blocks send their edges in one piece to each bucket of a hash, where equal ones are added up. A table in the shared folder.
    """
    source = docs.select(F.lit(None).cast("int").alias("doc"), F.coalesce(F.col(lang), F.lit("und")).alias("space"), F.lit(True).alias("counted"), F.col(text).cast("binary").alias("text"))
    blocks = make_blocks(source, read_pieces)
    buckets = max(1, math.ceil(blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] / BUCKET_TOKENS))

    def send(row: dict, block: Block, levels: list[Level], totals: list[np.ndarray]) -> pa.Table:
        lines, times = edge_texts(block, frequent_edges(block, levels, totals, least))
        press = zstandard.ZstdCompressor()
        parts: dict[int, list[int]] = {}
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in block.spaces]
        for k, line in enumerate(lines):
            space, rest = line.split(b" ", 1)
            parts.setdefault(xxhash.xxh3_64_intdigest(rest, seeds[int(space)]) % buckets, []).append(k)
        sent = [(b, block.spaces, press.compress(b"\n".join([lines[k] for k in own])), pack(np.array([times[k] for k in own]))) for b, own in parts.items()]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in sent], kind) for i, kind in enumerate(kinds)], names=["bucket", "spaces", "lines", "times"])

    def add(sent: pa.Table) -> pa.Table:
        totals: dict[tuple[str, bytes], int] = {}
        opened = zstandard.ZstdDecompressor()
        for spaces, lines, times in zip(*(sent.column(c).to_pylist() for c in ("spaces", "lines", "times")), strict=True):
            for line, n in zip(opened.decompress(lines).split(b"\n"), unpack(times).tolist(), strict=True):
                space, rest = line.split(b" ", 1)
                key = (spaces[int(space)], rest)
                totals[key] = totals.get(key, 0) + n
        cut = [rest.partition(b" ") for _, rest in totals]
        columns = [
            pa.array([k for k, _ in totals], pa.string()), pa.array([c for _, _, c in cut], pa.binary()).cast(pa.string()),
            pa.array([int(a) for a, _, _ in cut], pa.int32()), pa.array(list(totals.values()), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "size", "times"])

    sent = with_totals(blocks, count_grams(blocks, SIEVED), send, SIEVED, "bucket long, spaces array<string>, lines binary, times binary")
    return written(sent.groupBy("bucket").applyInArrow(add, "lang string, phrase string, size int, times long"))


def some_words(count: Column) -> Column:
    """The first words of a phrase, or the last if count is negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def node_counts(edges: DataFrame) -> list[DataFrame]:
    """Of each size from 1, (lang, phrase, f): the flow out of a node, from the longer edges and its own corrections."""
    flow, out = None, []
    for k in range(LONGEST, 0, -1):
        own = edges.where(F.col("size") == k).select("lang", "phrase", F.col("times").alias("f"))
        if flow is not None:
            own = own.unionByName(flow.select("lang", some_words(F.lit(k)).alias("phrase"), "f"))
        flow = own.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(flow)
    return out[::-1]


def find_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each lang the first `top` phrases of 2 to LONGEST words that occur `least` times or more.

    Texts end in pieces at .,;:!? and line ends, words stand between spaces and tabs, A-Z are lower-cased. l and r are the
    counts of a phrase's two parts at the cut where floor(1000 a n / (l r)) is least, the first such; n the words of the lang.
    A phrase that lies in a longer one as frequent as itself is left out. Ties go to the higher count, then to the phrase in
    byte order. A null lang is `und`; null and empty texts hold no word; repeated rows count each time; an empty table gives no row.
    """
    edges = graph_edges(docs, text, lang, least)
    levels = [x.where(F.col("f") >= least).withColumn("size", F.lit(k)) for k, x in enumerate(node_counts(edges), 1)]
    nodes = written(reduce(DataFrame.unionByName, levels))
    words = edges.where("size = 0").select("lang", F.col("times").alias("n"))
    # Compaction: the largest count of a phrase with one word more, before or behind it.
    size = F.col("size")
    ends = F.explode(F.array(some_words(size - 1), some_words(1 - size)))
    longer = nodes.where("size > 2").select("lang", ends.alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    phrases = nodes.where("size > 1").join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f").drop("longer")
    # Each phrase with the counts of its parts at every cut.
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"left": some_words(F.col("k")), "right": some_words(F.col("k") - size)})
    parts = nodes.select("lang", F.col("phrase").alias("part"), "f")
    cut = cut.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]).join(words, "lang")
    whole = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    product = (F.lit(1000).cast("decimal(38,0)") * whole["a"]) * whole["n"]
    score = F.call_function("div", product, whole["l"] * whole["r"]).alias("score")
    best = cut.select("lang", "phrase", "a", "n", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

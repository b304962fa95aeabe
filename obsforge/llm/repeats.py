"""Byte-exact removal of long repeats over a whole corpus, with suffix arrays of shards.

Every window of 100 bytes belongs to its minimizer, the run of 24 bytes inside it whose hash is least. Equal windows have
equal minimizers, so runs of windows with one minimizer ("segments") are all that must meet: segments with a minimizer
that occurs once are left out, equal segments become one, and the distinct ones are dealt to shards by minimizer. Each
shard's suffix array is induced, and its permuted common prefixes tell which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_split, mix, slices, written
from .jaccard import groups
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
GRAM = 24  # 16 + 8, so that hashes double
BUFFER = 2 << 20
SHARD_BYTES = 3 << 19
#: Distinct segments of one minimizer up to which they share a shard; those of more are cut up, and what still is too many compared by hash, over all tasks.
SHARED = 500


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 24 bytes from each place on."""
    h, width, power = data.astype(np.uint32) + np.uint32(1), 1, 0x9E3779B1
    eight = h
    while width < 16:
        h = h[:-width] * np.uint32(power) + h[width:]
        power = power * power % (1 << 32)
        width *= 2
        if width == 8:
            eight = h
    n = len(data) - GRAM + 1
    key = h[:n] * np.uint32(0x85EBCA77) + eight[16 : 16 + n]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return key ^ (key >> np.uint32(13))


def gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from the given places on."""
    total = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        total = total * np.uint64(0x100000001B3) + data[at + k]
    return mix(total)


def sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """best of each run of `width` values."""
    reach = 1
    while reach * 2 <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def minimizer_runs(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that are the first least key of some window of `width` keys, and the first window of each."""
    low = sliding(np.minimum, keys, width)
    edge = np.full(width - 1, 0, keys.dtype)
    high = sliding(np.maximum, np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero(high == keys)  # some window around it has no lesser key
    a, b = at[:-1], at[1:]
    begin = np.minimum(np.concatenate([[0], np.where(keys[b] < keys[a], b - width + 1, a + 1)]), len(low))
    begin = np.minimum.accumulate(begin[::-1])[::-1]  # of equals, some are the first in no window
    stay = np.diff(np.concatenate([begin, [len(low)]])) > 0
    return at[stay], begin[stay]


def buffers(texts: list[bytes], length: int, bound: int, overlap: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put end to end up to a bound: bytes, and of each part its text's number, its place there and its end here.

    A text beyond the bound comes in parts that overlap, so that each of its windows lies in exactly one, or by more.
    """
    overlap = length - 1 if overlap is None else overlap
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        ends = np.cumsum([len(p[2]) for p in parts])
        return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), ends

    for number, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, bound):
            parts.append((number, start, text[start : start + bound + overlap]))
            size += len(parts[-1][2])
            if size >= bound:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def segments(texts: list[bytes], length: int, bound: int = BUFFER) -> Iterator[tuple[np.ndarray, ...]]:
    """Per buffer: its bytes, and of each segment the minimizer's hash, the text's number, the first window's place in the
    text and in the buffer, the number of windows, and how far behind the first window the minimizer lies."""
    width = length - GRAM + 1
    for data, number, place, ends in buffers(texts, length, bound):
        places, opening = minimizer_runs(gram_keys(data), width)
        at = np.repeat(places, np.diff(np.concatenate([opening, [len(data) - length + 1]])))
        begins = ends - np.diff(np.concatenate([[0], ends]))
        part = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[: len(at)]
        valid = np.arange(len(at)) + length <= ends[part]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(valid & fresh)
        run = np.cumsum(valid & fresh)[valid] - 1
        windows = np.bincount(run, minlength=len(first))
        p = part[first]
        yield data, gram_hashes(data, at[first]), number[p], place[p] + first - begins[p], first, windows, at[first] - first


def minimizers(docs: DataFrame, length: int, bound: int) -> DataFrame:
    """(m, hints): per buffer and minimizer hash, 32-bit hashes of the documents that have it, and twice if one has it twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hint = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            for _, m, number, *_ in segments([(x or "").encode() for x in batch.column(1).to_pylist()], length, bound):
                yield pack_hints(m, hint[number])

    return docs.select("hint", "text").mapInArrow(emit, "m long, hints binary")


def pack_hints(m: np.ndarray, hints: np.ndarray) -> pa.RecordBatch:
    """(m, hints): each hash once, with all its document hashes as bytes."""
    order = np.argsort(m, kind="stable")
    m, hints = m[order], hints[order]
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
    offsets = np.concatenate([first, [len(m)]]).astype(np.int32) * 4
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(hints)])
    return pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), packed], names=["m", "hints"])


def known_by_document(found: DataFrame) -> DataFrame:
    """(hint, known): hashes that occur more than once, by document hash. Extra documents do no harm.

    found: (m, hints), where a hash has one row for each buffer of documents, however often it occurs in it.
    """
    found = found.repartition("m").sortWithinPartitions("m")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # the hash the batch before ended with, and its hint if it has occurred once so far
        for batch in batches:
            m = batch.column(0).to_numpy()
            if not len(m):
                continue
            hints = batch.column(1)
            offsets = np.frombuffer(hints.buffers()[1], np.int32)[hints.offset : hints.offset + len(hints) + 1] // 4
            sizes = np.diff(offsets)
            fresh = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            total = np.add.reduceat(sizes, fresh)
            before = held if m[0] == last else []
            total[0] += m[0] == last
            runs = np.diff(np.concatenate([fresh, [len(m)]]))
            stay = np.repeat(np.repeat(total > 1, runs), sizes)
            every = np.frombuffer(hints.buffers()[2], np.int32, offsets[-1])[offsets[0] :]
            last, held = m[-1], [] if total[-1] > 1 else [every[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(before, np.int32), every[stay]])), pa.array(np.concatenate([m[: len(before)], np.repeat(m, sizes)[stay]]))], names=["hint", "m"])

    return found.mapInArrow(keep, "hint int, m long").groupBy("hint").agg(F.collect_set("m").alias("known"))


def repeated_segments(packed: DataFrame, hints: DataFrame, length: int, bound: int) -> DataFrame:
    """(m, content, doc, part, start, windows, behind, raw): every segment whose minimizer is known to be repeated."""
    joined = packed.join(hints, "hint").select("doc", "part", "packed", "known")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            known = [np.sort(np.array(x, np.int64)) for x in batch.column(3).to_pylist()]
            texts = [opened.decompress(x) for x in batch.column(2).to_pylist()]
            for data, m, number, start, first, windows, behind in segments(texts, length, bound):
                m, stay = m.view(np.int64), np.zeros(len(m), bool)
                cuts = np.flatnonzero(np.diff(number)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(number)], strict=True):
                    if b > a:
                        seen = known[number[a]]
                        stay[a:b] = seen[np.minimum(np.searchsorted(seen, m[a:b]), len(seen) - 1)] == m[a:b]
                at = np.flatnonzero(stay)
                raw = [data[a:b].tobytes() for a, b in zip(first[at], first[at] + windows[at] + length - 1, strict=True)]
                content = [xxhash.xxh3_128_digest(x) for x in raw]
                rows = number[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[at]), pa.array(content, pa.binary()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(start[at]), pa.array(windows[at]), pa.array(behind[at]), pa.array(raw, pa.binary())],
                    names=["m", "content", "doc", "part", "start", "windows", "behind", "raw"],
                )

    kind = packed.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(emit, f"m long, content binary, doc {kind}, part long, start long, windows long, behind long, raw binary")


def shared_with_next(groups_: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Of each row, the most leading bytes that its context shares with that of another row of its group."""
    whole = np.concatenate([groups_.astype(">u8")[:, None].view(np.uint8).reshape(len(contexts), 8), contexts], 1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
    equal = (whole[order[1:]] == whole[order[:-1]]).cumprod(1, dtype=np.uint8).sum(1, dtype=np.int64) - 8
    best = np.zeros(len(contexts), np.int64)
    best[order[1:]] = np.maximum(equal, 0)
    best[order[:-1]] = np.maximum(best[order[:-1]], equal)
    return best


def trimmed(rows: list[tuple], length: int) -> list[tuple]:
    """Rows without the windows that no other segment can share: (doc, part, start, windows, raw).

    rows: (m, behind, doc, part, start, windows, raw). Segments of one minimizer are laid over each other at it; a window
    needs as many equal bytes before and behind it as it covers there.
    """
    reach = length - GRAM
    left, right = np.zeros((2, len(rows), reach + 1), np.uint8)
    for k, (_, behind, *_, raw) in enumerate(rows):
        before, after = raw[:behind][::-1], raw[behind + GRAM :]
        left[k, : len(before)], left[k, reach] = np.frombuffer(before, np.uint8), len(before)
        right[k, : len(after)], right[k, reach] = np.frombuffer(after, np.uint8), len(after)
    m = np.array([r[0] for r in rows])
    before = np.minimum(shared_with_next(m, left), reach)
    after = np.minimum(shared_with_next(m, right), reach)
    out = []
    for (_, behind, doc, part, start, windows, raw), b, a in zip(rows, before.tolist(), after.tolist(), strict=True):
        low, high = max(0, behind - b), min(windows - 1, behind - reach + a)
        if low <= high:
            out.append((doc, part, start + low, high - low + 1, raw[low : high + length]))
    return out


def repeats_in_shard(rows: list[tuple], length: int) -> Iterator[tuple]:
    """rows: (doc, part, start, windows, raw). Yields (doc, part, start, bytes) of windows that also start earlier."""
    if not rows:
        return
    data = np.frombuffer(b"".join(r[4] + b"\0" for r in rows), np.uint8).astype(np.int64) + 2
    sizes = np.array([len(r[4]) + 1 for r in rows])
    begin = np.cumsum(sizes) - sizes
    data[begin + sizes - 1] = 1  # between segments
    s = np.concatenate([data, [0]])
    sa = suffix_array(s, 258)
    common = permuted_common_prefixes(s, sa)[sa]
    windows = np.array([r[3] for r in rows])
    owner = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    # Rank windows by document and place.
    docs = sorted({(r[0] is not None, r[0] if r[0] is not None else 0, r[1]) for r in rows})
    number = {d: k for k, d in enumerate(docs)}
    rank = np.array([number[(r[0] is not None, r[0] if r[0] is not None else 0, r[1])] for r in rows])
    start = np.array([r[2] for r in rows])
    order = np.lexsort((start[owner] + offset, rank[owner]))
    turn = np.full(len(s), np.iinfo(np.int64).max)
    turn[(begin[owner] + offset)[order]] = np.arange(len(order))
    runs = np.flatnonzero(common < length)  # a run of suffixes that share the window
    least = np.minimum.reduceat(turn[sa], runs)
    first = np.empty(len(s), np.int64)
    first[sa] = np.repeat(least, np.diff(np.concatenate([runs, [len(s)]])))
    place = begin[owner] + offset
    late = turn[place] != first[place]
    edge = np.flatnonzero(late & ~(np.concatenate([[False], late[:-1]]) & (offset > 0)))
    close = np.flatnonzero(late & ~np.concatenate([late[1:] & (offset[1:] > 0), [False]]))
    for a, b in zip(edge.tolist(), close.tolist(), strict=True):
        row = rows[owner[a]]
        yield row[0], row[1], row[2] + int(offset[a]), int(b - a) + length


def keyed_texts(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, part, hint, text) and the same with the text compressed; null texts are empty."""
    base = docs.select(F.col(id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("doc", F.xxhash64("text").alias("part"), F.hash("doc", "text").alias("hint"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press.compress(x.encode()) for x in batch.column(3).to_pylist()], pa.binary())], names=["doc", "part", "hint", "packed"])

    kind = base.schema["doc"].dataType.simpleString()
    return base, base.mapInArrow(pack, f"doc {kind}, part long, hint int, packed binary")


def compare_segments(found: DataFrame, length: int, shared: int, shard_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Byte runs to remove, and the distinct segments of groups too large for a shard, if there are any.

    found: (m, content, doc, part, start, windows, behind, raw). Of equal segments all but the first go whole.
    """
    order = F.struct("doc", "part", "start")
    distinct = found.groupBy("m", "content").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first(F.struct("windows", "behind", "raw")).alias("segment"))
    distinct = written(distinct.select("m", "content", "first", "n", "segment.*"))
    copies = found.select("m", "content", "doc", "part", "start", "windows").join(distinct.where("n > 1").select("m", "content", "first"), ["m", "content"])
    copies = written(copies.where(~order.eqNullSafe(F.col("first"))).select("doc", "part", "start", (F.col("windows") + length - 1).alias("size")))
    several = distinct.groupBy("m").agg(F.count("*").alias("segments")).where("segments > 1")
    ready = written(distinct.select("m", "behind", "first.doc", "first.part", "first.start", "windows", "raw").transform(join_split, several, ["m"]))
    small = F.col("segments") <= shared
    total, large = ready.agg(F.coalesce(F.sum(F.when(small, F.octet_length("raw"))), F.lit(0)), F.count_if(~small)).first()
    shards = max(1, -(-total // shard_bytes))
    dealt = ready.where(small).select(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"), "m", "behind", "doc", "part", "start", "windows", "raw")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    kind = f"doc {found.schema['doc'].dataType.simpleString()}, part long, start long, size long"
    types = (found.schema["doc"].dataType, T.LongType(), T.LongType(), T.LongType())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for _, rows in groups(slices(batches, 2000), 1):
            late = list(zip(*repeats_in_shard(trimmed(rows, length), length), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), to_arrow_type(t)) for x, t in zip(late, types, strict=True)], names=["doc", "part", "start", "size"])

    return copies.unionByName(dealt.mapInArrow(compare, kind)), ready.where(~small).drop("segments") if large else None


def parts_of_segments(segments: DataFrame, length: int, step: int = 8) -> DataFrame:
    """The same windows, a few to a segment, grouped by the bytes that all of them cover beside their minimizer.

    Windows that cover as much before their minimizer, up to the step, come together, so equal windows do.
    """
    parts = F.expr(f"""
        transform(sequence((behind - windows + 1) div {step}, behind div {step}), t -> named_struct(
            't', t, 'low', greatest(0, behind - {step} * t - {step - 1}), 'high', least(windows - 1, behind - {step} * t)))""")
    cut = segments.select("m", "doc", "part", "start", "behind", "raw", F.inline(parts)).where("low <= high")
    raw = F.expr(f"substring(raw, int(low) + 1, int(high - low) + {length})")
    core = F.expr(f"substring(raw, int(behind - {step} * t) + 1, {length - step + 1})")
    return cut.select(
        F.xxhash64("m", "t", core).alias("m"), F.unhex(F.md5(raw)).alias("content"), "doc", "part", (F.col("start") + F.col("low")).alias("start"),
        (F.col("high") - F.col("low") + 1).alias("windows"), (F.col("behind") - F.col("low")).alias("behind"), raw.alias("raw"),
    )


def compare_windows(segments: DataFrame, length: int) -> DataFrame:
    """Byte runs to remove: every window but the first of equal ones, met by two hashes over all tasks."""
    order = F.struct("doc", "part", "start")
    places = F.expr(f"transform(sequence(0, int(windows) - 1), i -> named_struct('h1', xxhash64(substring(raw, i + 1, {length})), 'h2', xxhash64(m, substring(raw, i + 1, {length})), 'start', start + i))")
    windows = segments.select("doc", "part", F.inline(places))
    first = windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = join_split(windows, first, ["h1", "h2"]).where(~order.eqNullSafe(F.col("first")))
    return late.select("doc", "part", "start", F.lit(length).cast("long").alias("size"))


def find_repeats(docs: DataFrame, packed: DataFrame, length: int = LENGTH, shared: int = SHARED, shard_bytes: int = SHARD_BYTES, buffer: int = BUFFER) -> DataFrame:
    """(doc, part, late): byte runs to remove, overlapping ones among them.

    docs: doc, part, hint (a hash of both) and text; packed: the same once each, with the text compressed.
    """
    found = written(repeated_segments(packed, known_by_document(minimizers(docs, length, buffer)), length, buffer))
    late, large = compare_segments(found, length, shared, shard_bytes)
    if large:  # a minimizer with very many surroundings
        more, large = compare_segments(written(parts_of_segments(large, length)), length, shared, shard_bytes)
        late = late.unionByName(more)
    if large:
        late = late.unionByName(compare_windows(large, length))
    return written(late.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "size")).alias("late")))


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, shared: int = SHARED, shard_bytes: int = SHARD_BYTES, buffer: int = BUFFER) -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (start and size of each maximal removed run), kept (the bytes left).

    A byte goes if a run of `length` bytes around it also starts earlier: in a document of smaller id, or earlier in its own
    document. Runs are judged on the input, as UTF-8, and never cross documents. A null text is empty, a null id smallest.
    Rows that agree in id and text are one document; rows that agree in id only are ordered by a hash of the text.
    """
    base, packed = keyed_texts(docs, id, text)
    once = packed.dropDuplicates(["hint", "doc", "part"])
    return cut_spans(packed, find_repeats(base, once, length, shared, shard_bytes, buffer), id)


def cut_spans(packed: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """(id, n_bytes, spans, kept) of all documents, found being (doc, part, late): byte runs to remove."""
    joined = packed.join(found.withColumnsRenamed({"doc": "d", "part": "p"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("part") == F.col("p")), "left").select("doc", "packed", "late")
    span = T.ArrayType(T.StructType().add("start", "long").add("size", "long"))
    out = T.StructType([T.StructField(id, packed.schema["doc"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        shape = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
        for batch in slices(batches):
            sizes, spans, kept = [], [], []
            for raw, late in zip((opened.decompress(x) for x in batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((r["start"], r["start"] + r["size"]) for r in late or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "size": b - a} for a, b in runs])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())], names=out.names)

    return joined.mapInArrow(cut, out)

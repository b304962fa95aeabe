"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_split, numbered, slices

SIZE = 3


def line_windows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per window of three lines that aren't all blank: two hashes of the lines, document, place.

    A place is the text's hash and the first line's number in one long, so that documents with the same id differ.
    """
    lines = docs.select(F.col(id).alias("doc"), F.hash(text).alias("part"), F.split(text, "\n", -1).alias("lines"))
    windows = F.expr(f"""
        transform(sequence(1, size(lines) - {SIZE - 1}), i -> named_struct(
            'h1', xxhash64(lines[i - 1], lines[i], lines[i + 1]),
            'h2', xxhash64(i - i, lines[i + 1], lines[i], lines[i - 1]),
            'place', shiftleft(cast(part as bigint), 32) | cast(i - 1 as bigint),
            'blank', trim(lines[i - 1]) = '' and trim(lines[i]) = '' and trim(lines[i + 1]) = ''))""")
    return lines.where(F.size("lines") >= SIZE).select("doc", F.inline(windows)).where("not blank").drop("blank")


def repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, part, starts): per document the windows that also start earlier, by id and then by line.

    The first occurrence is found by an aggregate that combines on the map side, and met again by a join that adaptive
    execution can split, so a window that a third of all documents share is in no single task.
    """
    windows = line_windows(docs, id, text)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_split(windows, first.select("h1", "h2", "first"), ["h1", "h2"]).where(~F.struct("doc", "place").eqNullSafe(F.col("first")))
    return later.groupBy("doc", F.shiftright("place", 32).cast("int").alias("part")).agg(F.collect_set(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("starts"))


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text left when every line of a window that also starts earlier is removed, n_lines and n_removed.

    Earlier means a smaller id (null is smallest) or the same document and an earlier line; windows are judged on the
    input. Lines are compared exactly. Texts of fewer than three lines and windows of blank lines are left alone; an empty
    text is one line, a null text stays null with 0 lines. Rows that agree in id and text are one document and share its
    result; rows that agree in id only are told apart by a hash of the text. Columns of the new names are replaced.
    """
    base = docs.drop("n_lines", "n_removed")
    at, n, plain = base.columns.index(text), len(base.columns), numbered(base)
    key, value = (plain.columns[base.columns.index(x)] for x in (id, text))
    found = repeated_windows(plain, key, value)
    joined = plain.join(found, F.col("doc").eqNullSafe(F.col(key)) & (F.col("part") == F.hash(value)), "left").drop("doc", "part")
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, counts, removed = [], [], []
            for value, starts in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True):
                lines = [] if value is None else value.split("\n")
                gone = np.zeros(len(lines), bool)
                for k in range(SIZE):
                    gone[np.array(starts or [], np.int64) + k] = True
                kept.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if starts else value)
                counts.append(len(lines))
                removed.append(int(gone.sum()))
            columns = list(batch.columns[:n])
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)

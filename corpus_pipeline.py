"""From raw documents to packed training sequences: each stage reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsforge.llm import decontaminate, jaccard, language, lines, packing
from obsforge.llm.common import remainder, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that shares no n-gram with a landmark scores 0; a single word of a learned language scores about 0.3.
LEAST_SCORE = 0.1


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Texts that are null, have no letter or score too low go."""
    model = language.fit_kernel_model(language.sample_languages(docs, remainder("doc_id", 4) != 2))
    scored = language.predict_language(docs.select(*COLUMNS), model)
    return scored.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line windows that occur earlier; what loses all its lines goes."""
    cut = lines.drop_repeated_lines(docs.select(*COLUMNS))
    kept = cut.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; texts without a word stay, repeated rows once."""
    kept = jaccard.similar_documents(docs).where("kept").select(F.col("doc_id").alias("id"), "text_hash")
    hashed = docs.select(*COLUMNS).withColumn("hash", F.xxhash64("text"))
    first = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    return first.dropDuplicates(["doc_id", "hash"]).select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark window."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: A string kernel, MinHash pruning and a tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

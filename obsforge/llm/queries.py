"""The operators of this package over the shared tables, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, collocations, decontaminate, jaccard, language, lines, neighbours, packing, paragraphs, quality, repeats, secret_scan, whitening
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_embedding_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["size"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, payload=("ids_crc32", "long", zlib.crc32))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.joined_spans(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined_spans(F.col("spans")).alias("spans"), count("entropy"),
    )


@query("op6_line_dedup", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
    w AS (SELECT doc_id, p, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w
          WHERE c IS NOT NULL AND NOT (trim(a, ' ') = '' AND trim(b, ' ') = '' AND trim(c, ' ') = '')),
    gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE k > 1)
    SELECT l.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE gone.p IS NULL), '') AS text
    FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id
""")  # fmt: skip
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = remainder("doc_id", 3) == 1
    machine = quality.fit_machine(quality.sample_features(docs, table(spark, sf_dir, "labels"), ~held_out))
    scored = quality.score_quality(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_kernel_model(language.sample_languages(docs, remainder("doc_id", 4) != 2))
    scored = language.predict_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op9_paragraph_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = paragraphs.drop_repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["size"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.decode("kept", "UTF-8").alias("text"))


@query("op10_decontamination", f"""
    WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win
           FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
    d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (win, n)),
    places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""")  # fmt: skip
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op12_lm_scoring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


@query("op13_collocations", r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size),
    f AS (SELECT lang, w[i : i + size - 1] AS gram, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    inside AS (SELECT lang, gram[i : j] AS gram, max(f) AS longer
               FROM (SELECT lang, gram, f, i, unnest(range(i + 1, len(gram) + 1)) AS j FROM (SELECT lang, gram, f, unnest(range(1, len(gram))) AS i FROM f))
               WHERE j - i + 1 < len(gram) GROUP BY ALL),
    kept AS (SELECT lang, gram, f.f AS a FROM f LEFT JOIN inside USING (lang, gram) WHERE len(gram) > 1 AND (longer IS NULL OR 100 * longer < 100 * f.f)),
    cuts AS (SELECT c.lang, c.gram, a, k, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
             FROM (SELECT lang, gram, a, unnest(range(1, len(gram))) AS k FROM kept) c JOIN total ON total.lang = c.lang
             JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1 : k] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1 : len(c.gram)]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank, array_to_string(gram, ' ') AS phrase, a, l, r, n, score
    FROM best QUALIFY rank <= 2000
""")  # fmt: skip
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.find_collocations(table(spark, sf_dir, "documents"))

"""Language ID and quality: held-out accuracy, inputs left alone, edges."""

import zlib

import numpy as np
import pytest

from obsforge.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(small):
    docs = small("documents")
    return language.fit_kernel_model(language.sample_languages(docs, queries.remainder("doc_id", 4) != 2))


def test_language_query_on_held_out_rows(spark, small):
    found = {r.doc_id: r for r in queries.op8(spark, SF).collect()}
    rows = small("documents").collect()
    assert set(found) == {r.doc_id for r in rows}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(found[r.doc_id].held_out == (r in held) for r in rows)
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_kernel_scores_match_a_plain_computation(model):
    table = language.symbol_table(model.alphabet)
    text = "Reush hewh, and ÉANAI onon that!"
    own = set(language.gram_codes(text, table).tolist())
    where = {g: k for k, g in enumerate(model.grams.tolist())}
    kernel = sum(model.landmarks[where[g]] for g in own if g in where) / np.sqrt(len(own))
    want = kernel @ model.weights
    presence, n = language.Presence(model.alphabet)(text, model.grams)
    assert n == len(own)
    assert np.allclose((presence @ model.landmarks / np.sqrt(n)) @ model.weights, want)


def test_grams_fold_case_and_what_is_no_letter():
    table = language.symbol_table("abc")
    assert language.gram_codes("A b", table).tolist() == language.gram_codes("a--1--B", table).tolist()


def test_language_edges(documents, model, spark):
    rows = [(1, None), (2, ""), (3, "12 $% \n"), (4, "and the thing was in that " * 30_000), (5, "日本語のテキスト"), (None, "and the"), (None, "and the")]
    df = documents(rows).withColumnRenamed("root", "score")  # a column of the result's name is replaced
    found = {r.doc_id: r for r in language.predict_language(df, model).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred == "en" and found[None].lang_pred == "en"
    assert found[5].score < 0.1 and found[5].set == "z"
    assert language.predict_language(documents([(1, "x")]).where("false"), model).count() == 0
    nothing = language.fit_kernel_model(language.sample_languages(documents([(1, "text", None)]), queries.remainder("doc_id", 4) != 2))
    assert language.predict_language(documents([(1, "text")]), nothing).first().lang_pred == "und"


def test_quality_query_on_held_out_rows(spark, small):
    found = {r.doc_id: r for r in queries.op7(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in small("labels").collect()}
    assert len(found) == small("documents").count()
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in found)
    assert np.mean([found[k].predicted == labels[k] for k in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in found.values())


def test_pairs_cost_one_pass():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    numbers, values = np.array([3, 10, 700, 9, 12]), rng.normal(size=5)
    got, _ = quality.margins(machine, numbers, values, np.array([0, 3]))
    for part, margin in ((slice(0, 3), got[0]), (slice(3, 5), got[1])):
        n, v = numbers[part], values[part]
        pairs = sum(machine.vectors[n[a]] @ machine.vectors[n[b]] * v[a] * v[b] for a in range(len(n)) for b in range(a))
        assert np.isclose(margin, 0.3 + machine.weights[n] @ v + pairs)


def test_quality_edges(documents, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = documents([(k, "good words in a row here" if k % 2 else "bad bad bad $$$ " * 9) for k in range(40)] + [(50, None), (51, ""), (None, "x" * 300_000)])
    machine = quality.fit_machine(quality.sample_features(docs, labels, queries.remainder("doc_id", 3) != 1))
    found = {r.doc_id: r.score for r in quality.score_quality(docs, machine).collect()}
    assert len(found) == 43 and all(0 <= s <= 1 for s in found.values()) and found[1] > 0.5 > found[2]
    empty = quality.fit_machine(quality.sample_features(docs, labels.where("false"), queries.remainder("doc_id", 3) != 1))
    assert quality.score_quality(docs, empty).first().score == 0.5
    assert quality.score_quality(docs.where("false"), machine).count() == 0

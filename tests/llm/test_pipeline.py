"""The pipeline as a whole, and that the package is on its own."""

import pathlib
import re

import pytest

import corpus_pipeline
from obsforge.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_stages(spark, stages):
    assert [n for n, _ in stages] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    columns = table(spark, SF, "documents").columns
    assert all(df.columns == columns for _, df in stages[:-1])
    before = table(spark, SF, "documents").count()
    for _, df in stages[:-1]:
        assert df.count() <= before and df.where("n_chars != char_length(text)").count() == 0
        before = df.count()
    assert before > 150  # clean documents stay


def test_run_packs_what_is_kept(spark, stages):
    kept = {r.doc_id for r in stages[-2][1].collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept
    assert len(rows) == stages[-1][1].count()


def test_stages_take_awkward_rows(spark, documents):
    rows = [(1, None, None), (2, "", "en"), (2, "", "en"), (None, "some words of a text", None), (3, "some words of a text", "en"), (3, "some words of a text", "en"), (4, "1234", "en")]
    docs = documents(rows).select(*corpus_pipeline.COLUMNS)
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, SF).count() >= 0
    kept = corpus_pipeline.keep_distinct(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text and " " in r.text) == [("None", "some words of a text")]


def test_nothing_else_imports_the_package():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("obsforge/**/*.py"), *root.glob("workload/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.parts:
            assert not re.search(r"obsforge[. ]llm|import llm|corpus_pipeline", path.read_text()), path

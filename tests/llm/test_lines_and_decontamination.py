"""Line dedup and decontamination: against their SQL, brute force and each other."""

import random

import pytest

from obsforge.llm import decontaminate, lines, queries
from workload.check import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def brute_lines(rows):
    seen, out = set(), {}
    for doc, text in rows:
        split = (text or "").split("\n")
        gone = set()
        for k in range(len(split) - 2):
            w = tuple(split[k : k + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[doc] = "\n".join(x for k, x in enumerate(split) if k not in gone) if gone else text
    return out


def test_lines_match_brute_force(documents):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(90, None), (91, ""), (92, "\n\n\n\n"), (93, "x\ny\nz\n" * 5000), (94, "x\ny\nz")]
    found = {r.doc_id: r.text for r in lines.drop_repeated_lines(documents(rows)).collect()}
    assert found == brute_lines(rows)


def test_rows_that_repeat_share_a_result(documents):
    text = "one\ntwo\nthree\nfour"
    found = lines.drop_repeated_lines(documents([(2, text), (2, text), (None, text), (2, text + "\nfive")])).collect()
    assert sorted((r.doc_id is None, r.n_lines, r.n_removed) for r in found) == [(False, 4, 4), (False, 4, 4), (False, 5, 4), (True, 4, 0)]
    assert lines.drop_repeated_lines(documents([(1, text)]).where("false")).count() == 0


ITEMS = [
    ("7", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("8", "Short item"), ("8", "Short item"), ("9", "!!! ..."),
    (None, "ünïcode wörds hère"), ("10", None), ("11", ""), ("12", "one"),
]
TEXTS = [
    None, "", "...", "ONE, two; three four five six seven eight nine ten eleven twelve thirteen and more", "a short ITEM here, a short item there", "ünïcode wörds hère ok",
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 400, "shortitem", "short\x00item",
]


def test_hash_join_agrees_with_broadcast(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = documents(list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[3]), (4, "other")])
    found = [decontaminate.find_contamination(docs, items, spans=True, broadcast_bytes=n).select("doc_id", "n_words", "n_hit", "items", "clean_text", "root") for n in (1 << 20, 0)]
    one, two = (sorted(map(repr, f.collect())) for f in found)
    assert one == two and len(one) == len(TEXTS) + 3
    got = {r.doc_id: r for r in found[0].collect()}
    assert got[3].n_hit == 13 and got[3].items == ["12", "7"] and got[3].clean_text == " and more"
    assert got[5].items == ["null"] and got[5].clean_text == " ok" and got[7].n_hit == 0 and got[8].n_hit == 2


def test_an_empty_benchmark_hits_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    for n in (1 << 20, -1):
        found = decontaminate.find_contamination(documents([(1, "some words"), (2, None)]), none, broadcast_bytes=n).collect()
        assert sorted((r.n_words, r.n_hit, r["items"]) for r in found) == [(0, 0, []), (2, 0, [])]

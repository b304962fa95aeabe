"""Whitening against plain arithmetic, scores against dictionaries of counts, phrases against counting every phrase."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsforge.llm import backoff, collocations, grams, queries, whitening
from obsforge.llm.common import remainder

LOW = {65 + k: 97 + k for k in range(26)}
VECTORS = "vec_id long, embedding array<double>, label int, id string, vector string, n int"


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(k, v, 0, "x", "y", 1) for k, v in rows], VECTORS).repartition(3)


def plain_whitening(rows, components=4):
    """(vec_id, component) to (n, deviation, whitened, explained), the covariance from exact products."""
    x = {k: [math.floor(256 * Fraction(c)) for c in v] for k, v in rows}
    fit = [list(v) for v in {tuple(v) for v in x.values()}]
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    y = [[n * v[i] - sums[i] for i in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in y), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes.T[::-1]
    out = {}
    for k, v in x.items():
        z = [n * a - s for a, s in zip(v, sums, strict=True)]
        for c in range(min(d, components)):
            out[k, c + 1] = (n, sum(a * a for a in z), float(np.dot(np.array([a / n for a in z]), axes[c]) / math.sqrt(values[c])), values[c] / values.sum())
    return out


def test_whitening_matches_plain_arithmetic(vectors):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1 + 3 * i) + (1000 if i == 2 else 0) for i in range(6)]) for k in range(200)]
    rows += [(500, rows[0][1]), (501, [c + 1e-9 for c in rows[1][1]])]  # repeated, and equal once quantised or nearly so
    odd = [(600, None), (601, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (602, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]), (603, [float("inf")] * 6), (604, [])]
    found = whitening.whiten(vectors(rows + odd)).collect()
    want = plain_whitening(rows)
    assert {(r.vec_id, r.component) for r in found} == set(want)
    sign = {c: math.copysign(1, next(r.whitened * want[0, c][2] for r in found if r.vec_id == 0 and r.component == c)) for c in range(1, 5)}
    for r in found:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert math.isclose(r.whitened, sign[r.component] * whitened, rel_tol=1e-8, abs_tol=1e-8)
        assert math.isclose(r.explained, explained, rel_tol=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_huge_entries_single_rows_and_other_lengths(vectors):
    big = [(k, [(-1) ** k * 1e14 * k, 3e13 * k * k, float(k)]) for k in range(9)]
    found = whitening.whiten(vectors(big + [(50, [1e300, -1e300]), (51, [5.0, 5.0]), (52, [7.0])])).collect()
    want = plain_whitening(big)
    for r in found:
        if r.vec_id < 50:
            assert (r.n, int(r.deviation)) == want[r.vec_id, r.component][:2]
            assert r.identity_error is not None
    assert sorted((r.vec_id, r.component) for r in found if r.vec_id >= 50) == [(50, 1), (50, 2), (51, 1), (51, 2), (52, 1)]
    single = next(r for r in found if r.vec_id == 52)
    assert (single.n, int(single.deviation), single.whitened, single.explained, single.identity_error) == (1, 0, None, 0.0, None)
    assert whitening.whiten(vectors([(1, None), (2, [])])).collect() == []
    repeated = whitening.whiten(vectors([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in repeated) == [("3", 1, 2)] * 3 + [("3", 2, 2)] * 3 + [("None", 1, 2), ("None", 2, 2)]


def test_squares_are_exact():
    rng = random.Random(1)
    y = np.array([[rng.randrange(-(1 << 60), 1 << 60) for _ in range(4)] for _ in range(300)])
    assert whitening.squares(y) == [sum(int(v) ** 2 for v in y[:, i]) for i in range(4)]
    half = y >> 1
    pairs = [sum((int(r[i]) + (int(r[j]) if j > i else 0)) ** 2 for r in half) for i in range(4) for j in range(i, 4)]
    assert whitening.pair_squares(half) == pairs and whitening.pair_squares(half.astype(object)) == pairs


def test_whitening_query_on_the_whole_table(spark, small):
    found = queries.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in small("embeddings").collect()]
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {len(fit)}
    deviation = dict(zip([k for k, _ in rows], ((len(fit) * x - fit.sum(0)) ** 2).sum(1).tolist(), strict=True))
    assert all(r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9 for r in found)
    assert np.allclose(sum(r.whitened**2 for r in found if r.component == 1) / len(rows), 1, atol=0.2)


def plain_scores(rows, learn, weights):
    """Of each row: (learned, n_tokens, n_known, N, base, score) from dictionaries of counts."""
    texts = [(k, ["<s>", *[w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOW)) if w], "</s>"]) for k, t in rows]
    one, two, three = (collections.Counter() for _ in range(3))
    for k, t in texts:
        if learn(k):
            one.update(t)
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    starts = one.pop("<s>", 0)
    n, v = sum(one.values()), len(one)
    out = []
    for k, t in texts:
        base = score = known = 0
        for i in range(1, len(t)):
            p = (one[t[i]] + 1) / (n + v + 1)
            base += math.log10(p)
            known += one[t[i]] > 0
            p = (two[t[i - 1], t[i]] + weights[0] * p) / ((one[t[i - 1]] if i > 1 else starts) + weights[0])
            if i > 1:
                p = (three[t[i - 2], t[i - 1], t[i]] + weights[1] * p) / (two[t[i - 2], t[i - 1]] + weights[1])
            score += math.log10(p)
        out.append((k, learn(k), len(t) - 1, known, n, base, score))
    return out


def same_scores(found, want):
    found = sorted(((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=repr)
    want = sorted(want, key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(sorted(found, key=lambda r: (str(r[:5]), r[5], r[6])), sorted(want, key=lambda r: (str(r[:5]), r[5], r[6])), strict=True):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2


@pytest.mark.parametrize("weights", [(3000.0, 10.0), (2.0, 0.5)])
def test_scores_match_dictionaries_of_counts(documents, monkeypatch, weights):
    monkeypatch.setattr(backoff, "STRIP", 7)
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(["a", "B", "c", "dé", "E"]) + rng.choice([" ", "\t", "  ", "\n", "\x1c"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    rows += [(90, None), (91, ""), (92, " \n "), (None, "a b"), (93, "a b c " * 4000), (94, "never seen before"), (60, "a b c"), (60, "a b c"), (60, "c b a")]
    found = backoff.score_texts(documents(rows), remainder("doc_id", 7) != 2, weights=weights).collect()
    same_scores(found, plain_scores(rows, lambda k: not held(k), weights))


def test_scores_over_many_blocks_and_buckets(documents, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(30))) for k in range(40)]
    whole = sorted(tuple(r) for r in backoff.score_texts(documents(rows), remainder("doc_id", 7) != 2).collect())
    monkeypatch.setattr(grams, "BUCKET_GRAMS", 50)
    blocks = grams.make_blocks(documents(rows).select(F.col("doc_id").alias("doc"), F.lit("").alias("space"), F.lit(True).alias("counted"), F.col("text").cast("binary").alias("text")), backoff.read_words)
    assert blocks.count() >= 3
    cut = sorted(tuple(r) for r in backoff.score_texts(documents(rows), remainder("doc_id", 7) != 2).collect())
    assert [r[:5] for r in cut] == [r[:5] for r in whole]
    assert all(math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(cut, whole, strict=True))


def test_scores_without_anything_to_learn_or_score(documents):
    found = backoff.score_texts(documents([(1, "some words"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert backoff.score_texts(documents([(1, "x")]).where("false"), F.lit(True)).collect() == []


def test_probabilities_of_all_next_words_add_up_to_one(documents):
    """p(w | a b) from scores of a text that ends behind w and of one that ends before it, and what follows w taken off."""
    learned = [(1, "a b a c a b"), (3, "b a a")]
    total = 0
    for w in ("a", "b", "c", "unknown", None):
        text = "a b" if w is None else f"a b {w}"
        score = {r.doc_id: r.score for r in backoff.score_texts(documents(learned + [(100, text), (101, "a b")]), F.col("doc_id") < 100).collect()}
        automaton = plain_scores(learned + [(100, text)], lambda k: k < 100, backoff.WEIGHT)[-1][6]
        assert math.isclose(score[100], automaton, rel_tol=1e-12)
        total += 10 ** (score[100] - prefix(learned, text, w))
    assert math.isclose(total, 1, rel_tol=1e-9)


def prefix(learned, text, w):
    """log10 p of all but the token w: the words before it, and the end where it isn't w itself."""
    one, two, three = (collections.Counter() for _ in range(3))
    for _, t in learned:
        t = ["<s>", *t.split(), "</s>"]
        one.update(t)
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    starts = one.pop("<s>")
    n, v = sum(one.values()), len(one)
    t = ["<s>", *text.split(), "</s>"]
    out = 0
    for i in range(1, len(t)):
        p = (one[t[i]] + 1) / (n + v + 1)
        p = (two[t[i - 1], t[i]] + backoff.WEIGHT[0] * p) / ((one[t[i - 1]] if i > 1 else starts) + backoff.WEIGHT[0])
        if i > 1:
            p = (three[t[i - 2], t[i - 1], t[i]] + backoff.WEIGHT[1] * p) / (two[t[i - 2], t[i - 1]] + backoff.WEIGHT[1])
        out += 0 if i == 3 else math.log10(p)
    return out


def test_contexts_help_on_texts_that_were_held_out(spark):
    found = queries.QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in found) > 0.95 * sum(r.base_score for r in found)
    assert sum(r.score > r.base_score for r in found) > 0.8 * len(found)


def plain_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    kept = {q: a for q, a in f.items() if len(q[1]) > 1 and a >= least}
    gone = {(g, q[i:j]) for (g, q), a in kept.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and a >= f[g, q[i:j]]}
    out = collections.defaultdict(list)
    for (g, q), a in kept.items():
        if (g, q) not in gone:
            score, k = min((1000 * a * n[g] // (f[g, q[:k]] * f[g, q[k:]]), k) for k in range(1, len(q)))
            out[g].append((-score, -a, " ".join(q).encode(), f[g, q[:k]], f[g, q[k:]]))
    return sorted((g, rank, p.decode(), -a, l, r, n[g], -s) for g, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize("seed", range(2))
def test_phrases_match_counting_every_phrase(documents, monkeypatch, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "Zürich", "|", "x-y", "\x1c"]
    rows = []
    for k in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, text + " one two three four five six seven" * rng.randint(0, 3), rng.choice(["en", "fr", None])))
    rows += [(90, None, "en"), (91, "", None), (92, " .,; ", "fr"), (93, "loop " * 5000, "de"), (93, "loop " * 5000, "de"), (None, "the of a", "en")]
    if seed:
        monkeypatch.setattr(grams, "BUCKET_GRAMS", 200)
    found = sorted(tuple(r) for r in collocations.find_collocations(documents(rows), least=8, top=25).collect())
    assert found == plain_phrases(rows, 8, 25)


def test_phrases_whose_products_pass_64_bits(documents):
    rows = [(1, "a b. " * 3000 + "c " * 4000, "en")]
    assert sorted(tuple(r) for r in collocations.find_collocations(documents(rows), least=2).collect()) == plain_phrases(rows, 2, 2000)
    assert 1000 * 10**12 * 10**13 > 2**63  # as decimals of 38 digits
    spark = documents(rows).sparkSession
    line = spark.sql("SELECT CAST(1000 AS decimal(38,0)) * CAST(1000000000000 AS decimal(38,0)) * CAST(10000000000000 AS decimal(38,0)) div (CAST(1000000000001 AS decimal(38,0)) * CAST(3 AS decimal(38,0))) AS x").first()
    assert line.x == 1000 * 10**12 * 10**13 // (3 * (10**12 + 1))


def test_no_phrases_in_empty_tables(documents):
    assert collocations.find_collocations(documents([(1, "a b", "en")]).where("false")).collect() == []
    assert collocations.find_collocations(documents([(1, "a b a b", "en"), (2, None, None)])).collect() == []

"""Similarity joins, vector links, components, passages, packing: against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsforge.llm import components, jaccard, neighbours, packing, paragraphs, queries

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def reach(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(k, k + 1) for k in range(50)] + [(100, k) for k in range(120, 160)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert {k: found.get(k, k) for k in range(n)} == dict(enumerate(reach(n, pairs)))
    a, b = np.array(pairs).T
    assert components.forest(n, a, b).tolist() == reach(n, pairs)


def brute_jaccard(rows):
    sets = [set(jaccard.shingles_of(t).tolist()) for _, t in rows]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    links = Counter(x for p in pairs for x in p)
    label = reach(len(rows), pairs)
    return {rows[k][0]: (links[k], rows[label[k]][0]) for k in range(len(rows))}


def test_similar_documents_match_brute_force(documents):
    rng = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(40, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    big = rng.choices(words, k=300)
    rows += [(1000 + k, " ".join(big[:k] + ["x"] + big[k:])) for k in range(300)]  # a group of more than one block
    rows += [(2000, None), (2001, ""), (2002, "..."), (2003, "one two"), (2004, "One, two!"), (2005, " ".join(words) * 60)]
    found = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.similar_documents(documents(rows)).collect()}
    assert found == brute_jaccard(rows)


def test_similar_documents_of_repeated_rows(documents):
    text = "a b c d e f g h"
    found = jaccard.similar_documents(documents([(5, text), (5, text), (None, text), (5, "z y x w v u")])).collect()
    assert sorted((str(r.doc_id), r.n_links, r.component_id) for r in found) == [("5", 0, 5), ("5", 2, 5), ("5", 2, 5), ("None", 2, 5)]
    assert jaccard.similar_documents(documents([(1, "x")]).where("false")).count() == 0


def test_pruning_keeps_pairs_above_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(3)
    kept = []
    for share in (0.3, 0.8, 0.9):
        left = rng.integers(0, 1 << 32, (200, jaccard.HASHES), dtype=np.uint32)
        right = np.where(rng.random(left.shape) < share, left, left + 1)
        a, b = jaccard.prune(left, right, least)
        kept.append((a == b).sum())
        assert (a == b).all()
    assert kept[0] == 0 and kept[1] >= 199 and kept[2] == 200


def brute_vectors(rows, threshold=0.9):
    good = [(k, neighbours.usable(v)) for k, v in rows]
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if good[a][1] is not None and good[b][1] is not None and good[a][1] @ good[b][1] >= threshold]
    links, label = Counter(x for p in pairs for x in p), reach(len(rows), pairs)
    return {rows[k][0]: (links[k], rows[label[k]][0]) for k in range(len(rows))}


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, (base + 0.12 * rng.normal(size=16)).tolist()) for k in range(rng.integers(1, 12))]
    rows += [(len(rows) + k, rows[0][1]) for k in range(3)] + [(len(rows) + 3 + k, rng.normal(size=16).tolist()) for k in range(100)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [float("inf")] * 16), (n + 5, [1e300] * 16), (n + 6, [1e-300] * 16)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, set string")
    monkeypatch.setattr(neighbours, "PER_CLUSTER", 60)
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert sum(v[0] for v in found.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert all(found[k][0] <= want[k][0] for k in want) and np.mean([found[k] == want[k] for k in want]) > 0.95
    assert found[n + 5] == (1, n + 5) and found[n + 6] == (1, n + 5)


def test_a_cluster_of_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=12)
    rows = [(k, (base + 0.05 * rng.normal(size=12)).tolist()) for k in range(150)]
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == brute_vectors(rows)
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_is_told_by_vectors_that_have_partners(spark):
    rng = np.random.default_rng(3)
    units = rng.normal(size=(1000, 32))
    units[20:40] = units[:20] + 0.05 * rng.normal(size=(20, 32))  # scattered pairs
    units[40:44] = units[44] + 0.05 * rng.normal(size=(4, 32))  # a group with many copies
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows = [(b"%d" % k, x.tobytes(), 1000 if 40 <= k < 45 else 1) for k, x in enumerate(units)]
    classes = spark.createDataFrame(rows, "set binary, unit binary, copies long").repartition(3)
    partners, enough = neighbours.true_partners(classes, 0.9, len(rows))
    assert partners == {b"%d" % k: 1 if k < 40 else 4 for k in range(45)} and enough
    assert not neighbours.true_partners(classes, 0.9, len(rows), (50, 100))[1]
    group = [(b"%d" % k, b"40", 4000, 4) for k in range(40, 45)]  # all links of the group, and none of the pairs'
    linked = spark.createDataFrame(group, "a binary, b binary, links long, peers long")
    assert neighbours.found_share(partners, linked) == pytest.approx(5 / 45)


def test_vector_query_returns_every_row(spark, small):
    rows = queries.op1(spark, SF).collect()
    assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in small("embeddings").collect())
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_passages_inside_other_text_are_removed(documents):
    rng = random.Random(8)

    def prose(n):
        out = []
        while n > 0:
            k = min(n, rng.randint(8, 14))
            out.append(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(k)) + ".")
            n -= k
        return " ".join(out)

    passage = prose(70)
    rows = [(k, prose(200)) for k in range(20)]
    rows += [(100 + k, f"{prose(60)[:-1]} {passage} {prose(50)}") for k in range(30)]
    rows += [(200, None), (201, ""), (202, "short."), (203, rows[3][1]), (204, rows[3][1].replace(rows[3][1].split()[100], "changed"))]
    found = {r.doc_id: r for r in paragraphs.drop_repeated_passages(documents(rows)).collect()}
    texts = {k: (t or "").encode() for k, t in rows}
    for k in list(range(20)) + [100, 200, 201, 202]:
        assert bytes(found[k].kept) == texts[k]
    for k in range(101, 130):
        gone = len(texts[k]) - len(found[k].kept)
        assert 0.6 * len(passage) < gone < 1.2 * len(passage)
    assert len(found[203].kept) < 0.2 * len(texts[203]) and len(found[204].kept) < 0.7 * len(texts[204])
    assert all(sum(s["size"] for s in r.spans) == r.n_bytes - len(r.kept) for r in found.values())


def test_passages_without_marks_or_with_short_lines_cut_anywhere(documents):
    """Any 51 words copied into other text lose a run of 26; the first copy stays whole."""
    rng = random.Random(12)
    rows, passages = [], {}
    for k in range(120):
        gap = [lambda n: " ", lambda n: "\n" if n % 5 == 4 else " ", lambda n: " | "][k % 3]

        def words(n, gap=gap):
            return "".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + gap(i) for i in range(n))

        passages[k] = words(51)
        rows += [(1000 * copy + k, f"{words(rng.randint(0, 40))}{passages[k]}{words(rng.randint(0, 40))}") for copy in (0, 1)]
    found = {r.doc_id: r for r in paragraphs.drop_repeated_passages(documents(rows)).collect()}
    for (a, text), (b, other) in zip(rows[::2], rows[1::2], strict=True):
        assert bytes(found[a].kept) == text.encode()
        at = other.index(passages[a])
        gone = {i for s in found[b].spans for i in range(s.start, s.start + s["size"])} & set(range(at, at + len(passages[a])))
        assert len(other[min(gone) : max(gone) + 1].replace("|", " ").split()) >= 26, b


def test_a_sentence_repeated_in_one_document_alone(documents):
    rng = random.Random(13)
    sentence = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(20)) + ". "
    twice = [" ".join("w%d" % (100 * d + k) for k in range(18)) + ". " for d in range(12)]  # too short for a fixed run to come back
    lines = "one line of five words\nand five words after it\n"
    rows = [(1, sentence * 40), (2, lines * 200), (3, "once only, " + sentence[::-1])] + [(10 + d, x * 2) for d, x in enumerate(twice)]
    found = {r.doc_id: bytes(r.kept) for r in paragraphs.drop_repeated_passages(documents(rows)).collect()}
    assert found[1].startswith(sentence.encode()) and len(found[1]) < 4 * len(sentence)
    assert found[2].startswith(lines.encode()) and len(found[2]) < 20 * len(lines)
    assert [found[10 + d].decode() for d in range(12)] == twice
    assert found[3] == rows[2][1].encode()


def test_passages_of_long_texts_in_parts():
    rng = random.Random(1)
    text = ". ".join(" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 20))) for _ in range(400)).encode()
    whole = {(a, b) for _, p in paragraphs.read_paragraphs([text]) for a, b in zip(p.start.tolist(), p.size.tolist(), strict=True)}
    parts = {(a, b) for _, p in paragraphs.read_paragraphs([text], bound=5000, overlap=3000) for a, b in zip(p.start.tolist(), p.size.tolist(), strict=True)}
    assert parts == whole and len(whole) > 100


def check_pieces(pieces, texts, window):
    whole = Tokenizer.from_file(TOKENIZER)
    by_text = Counter()
    for (doc, turn), found in pieces.items():
        ids = whole.encode(texts[doc][turn] or "", add_special_tokens=False).ids + [packing.END]
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.ids == ids[at : at + p.length] and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
        by_text[doc] += 1
    assert by_text == Counter({k: len(v) for k, v in texts.items()})


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_is_an_exact_round_trip(documents, window):
    rng = random.Random(window)
    rows = [(k, " ".join("".join(rng.choices("abcdeé,'1 ", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 90)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, "日本語 text <|endoftext|> ﬁ"), (503, "word " * 30_000), (None, "null id")]
    found = packing.pack_documents(documents(rows), TOKENIZER, window=window).collect()
    pieces = {}
    for r in found:
        pieces.setdefault((r.doc_id, 0), []).append(r)
    check_pieces(pieces, {k: [t] for k, t in rows}, window)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    fills = []
    for parts in by.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        fills.append(at)
    assert sum(f < window for f in fills) <= 1 and sorted(by) == list(range(len(by)))


def test_packing_rows_that_repeat_and_none(documents):
    found = packing.pack_documents(documents([(1, "a b"), (1, "a b"), (1, "c")]), TOKENIZER, window=16).collect()
    assert sorted(r.length for r in found) == [2, 3, 3] and len({(r.sequence_id, r.offset) for r in found}) == 3
    assert packing.pack_documents(documents([(1, "x")]).where("false"), TOKENIZER).count() == 0


def test_packing_query_digests(spark, small):
    whole = Tokenizer.from_file(TOKENIZER)
    found = {}
    for r in queries.op4(spark, SF).collect():
        found.setdefault(r.doc_id, []).append(r)
    for row in small("documents").collect():
        ids = np.array(whole.encode(row.text or "", add_special_tokens=False).ids + [1], "<u4")
        for p in found[row.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in found[row.doc_id]) == len(ids)


def test_counts_solve_the_histogram():
    histogram = np.zeros(64, np.int64)
    histogram[[20, 44, 10, 34]] = [30, 12, 9, 9]
    rows = packing.combinations(histogram, 64, 100)
    used = np.zeros(64)
    for r, n in zip(rows, packing.solve_counts(histogram, rows), strict=True):
        assert r.sum() == 64 and n >= 0
        np.add.at(used, r[r > 0], n)
    assert np.abs(used - histogram).sum() < 0.35 * histogram.sum()

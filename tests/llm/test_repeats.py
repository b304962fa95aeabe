"""Byte-exact repeat removal against brute force, and the suffix arrays below it."""

import hashlib
import random

import numpy as np
import pytest

from obsforge.llm import queries, repeats, suffix_array


def brute_force(rows, length):
    """{id: (n_bytes, spans, kept)} by a table of every window, in order of id."""
    seen, found = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]])))
        spans = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        found[doc] = (len(raw), spans, bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g))
    return found


def removed(df, **options):
    return {r.doc_id: (r.n_bytes, [(s.start, s["size"]) for s in r.spans], bytes(r.kept)) for r in repeats.drop_repeats(df, **options).collect()}


def test_query_matches_brute_force(spark, small):
    want = brute_force([(r.doc_id, r.text) for r in small("documents").collect()], 100)
    got = queries.op2(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and any(r.n_removed for r in got)
    for r in got:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("shared", [0, 2, 500])  # windows by hash only, all ways, shards only
def test_ways_agree_with_brute_force(documents, shared):
    rng = random.Random(shared)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)] + ["ab" * 90, "x" * 150]
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 20)], " ".join(rng.choices(words, k=rng.randint(0, 10)))]
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "short"), (105, "y" * 99), (106, "y" * 100), (107, "y" * 1000), (108, "é" * 60)]
    assert removed(documents(rows), shared=shared, shard_bytes=20_000) == brute_force(rows, 100)


def test_a_long_text_comes_in_parts(documents):
    rng = random.Random(9)
    body = "".join(rng.choices("abcdefgh ", k=5000))
    rows = [(1, body * 3), (2, "z" + body[100:4000]), (3, body[50:] + body[:49])]
    assert removed(documents(rows), buffer=700) == brute_force(rows, 100)
    texts = [t.encode() for _, t in rows]
    windows = sum(int(w.sum()) for *_, w, _ in repeats.segments(texts, 100, 700))
    assert windows == sum(len(t) - 99 for t in texts)


def test_repeated_rows_share_a_result_and_null_is_the_smallest_id(documents):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = repeats.drop_repeats(documents([(7, text), (7, text), (None, text), (3, text)])).collect()
    assert sorted((r.doc_id is None, len(r.kept)) for r in got) == [(False, 0), (False, 0), (False, 0), (True, 300)]
    assert repeats.drop_repeats(documents([(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 600])
def test_suffix_arrays_and_common_prefixes(few, monkeypatch):
    monkeypatch.setattr(suffix_array, "FEW_SYMBOLS", few)
    rng = random.Random(few)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 10])
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        sa = suffix_array.suffix_array(np.array(text), k + 1)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        common = suffix_array.permuted_common_prefixes(np.array(text), sa)
        for a, b in zip(want, want[1:]):
            n = 0
            while text[a + n : a + n + 1] == text[b + n : b + n + 1]:
                n += 1
            assert common[b] == n

"""Log-probabilities of texts under a backoff automaton of smoothed n-grams.

Counts of all words, pairs and triples of the training texts are gathered over the corpus (module grams) and answered to
each block of texts for the grams it holds. Over a block these are the part of the automaton that its texts can reach:
every gram of fewer than ORDER words that was counted is a state, every counted gram an arc from the state of its first
words, weighted by its smoothed log-probability, and every state has a failure arc to the state without its first word,
weighted by what smoothing leaves for words not seen there. A text is read once, left to right, carrying its state.

Smoothing is Bayesian with the shorter context as prior: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without
its first word, c counts training texts and m is WEIGHT of h's length; without a context, p(w) = (c(w) + 1) / (N + V + 1), N
tokens and V distinct ones in training. Each sums to 1 over all words and one unknown one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grams import Block, Level, count_grams, make_blocks, with_totals

ORDER = 3
WEIGHT = (3000.0, 10.0)  # of the prior, for contexts of one and of two words
#: A text's start and its end: bytes that no UTF-8 text holds.
START, END = b"\xfe", b"\xfd"
STRIP = 512  # tokens that one lane of a traversal scores


def read_words(text: bytes) -> list[bytes]:
    return [START, *text.lower().split(), END]


class Automaton(NamedTuple):
    """States are 0, the empty one, words by number, and pairs of words after them.

    Arcs are numbered by the grams they complete, pairs before triples; `pair` and `triple` give for each place of the block the
    arc that reads its word from the state of the one or two words before it, -1 where training has none.
    """

    words: int
    pair: np.ndarray
    triple: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    first_weight: np.ndarray  # of each word, from the empty state
    first_next: np.ndarray
    fail_weight: np.ndarray  # of each state
    fail_next: np.ndarray

    def follow(self, state: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of the word at one place for each of many states, over as many failure arcs as it takes."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            arc = np.where(state >= self.words, self.triple[place], self.pair[place])
            empty, hit = state == 0, (state > 0) & (arc >= 0)
            weight[lane[empty]] += self.first_weight[word[empty]]
            after[lane[empty]] = self.first_next[word[empty]]
            weight[lane[hit]] += self.weight[arc[hit]]
            after[lane[hit]] = self.next[arc[hit]]
            fails = ~(empty | hit)
            lane, state, place, word = lane[fails], state[fails], place[fails], word[fails]
            weight[lane] += self.fail_weight[state]
            state = self.fail_next[state]
        return weight, after


def build_automaton(levels: list[Level], totals: list[np.ndarray], first: np.ndarray, weights: tuple[float, ...]) -> Automaton:
    """first: probability of each word without a context."""
    words = len(first)
    single, pair, triple = totals
    one, two, three = levels
    # The pair that a triple's last two words make: it starts one place behind it.
    tail, there = np.zeros(len(triple), np.int64), np.flatnonzero(three.at >= 0)
    tail[three.at[there]] = two.at[there + 1]
    p2 = (pair + weights[0] * first[two.last]) / (single[two.parent] + weights[0])
    p3 = (triple + weights[1] * p2[tail]) / (pair[three.parent] + weights[1])
    fail_weight = np.concatenate([np.log10(weights[0] / (single + weights[0])), np.log10(weights[1] / (pair + weights[1]))])
    fail_weight[0] = 0

    def read_at(level: Level, counts: np.ndarray, behind: int, start: int) -> np.ndarray:
        arcs = np.full(len(level.at), -1, np.int64)
        begin = np.flatnonzero(level.at >= 0)
        grams = level.at[begin]
        arcs[begin + behind] = np.where(counts[grams] > 0, grams + start, -1)
        return arcs

    return Automaton(
        words,
        read_at(two, pair, 1, 0),
        read_at(three, triple, 2, len(pair)),
        np.log10(np.concatenate([p2, p3])),
        words + np.concatenate([np.arange(len(pair)), tail]),
        np.log10(first),
        np.where(single > 0, one.key, 0),
        fail_weight,
        np.concatenate([np.zeros(words, np.int64), np.where(single[two.last] > 0, two.last, 0).astype(np.int64)]),
    )


def traverse(automaton: Automaton, tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-probability of each text, whose tokens are begin (its start, not scored) to end.

    Long texts are cut into strips that are read side by side. A state depends on the ORDER - 1 words before it at most, so a
    strip reads that many ahead of those it scores.
    """
    lengths = ends - begins - 1
    strips = -(-lengths // STRIP)
    text = np.repeat(np.arange(len(begins)), strips)
    number = np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)
    scored = begins[text] + 1 + number * STRIP
    stop = np.minimum(scored + STRIP, ends[text])
    at = np.maximum(scored - (ORDER - 1), begins[text])
    by_length = np.argsort(at - stop, kind="stable")
    text, scored, stop, at = text[by_length], scored[by_length], stop[by_length], at[by_length]
    total, state = np.zeros(len(text)), np.zeros(len(text), np.int64)
    active = len(text)
    while active:
        place = at[:active]
        weight, state[:active] = automaton.follow(state[:active], place, tokens[place])
        total[:active] += np.where(place >= scored[:active], weight, 0)
        at += 1
        while active and at[active - 1] >= stop[active - 1]:
            active -= 1
    return np.bincount(text, weights=total, minlength=len(begins))


def score_texts(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHT) -> DataFrame:
    """One row per row of docs: id, learned, n_tokens, n_known, train_tokens, base_score, score.

    Words are what stands between spaces, tabs and line ends, A-Z lower-cased; the end of a text is a token too. The model
    is learned from the rows where learn holds. n_known counts tokens that occur in training; base_score is the log10
    probability without contexts, score that of the automaton. Null and empty texts are the end alone, and learned as such;
    rows that repeat an id or a text count each time and have a result each; a null id stays null; an empty table gives no
    row. With nothing to learn from, every token has the probability 1.
    """
    source = docs.select(F.col(id).alias("doc"), F.lit("").alias("space"), F.coalesce(learn, F.lit(False)).alias("counted"), F.col(text).cast("binary").alias("text"))
    kind = T.StructType([source.schema["doc"]]).add("learned", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    blocks = make_blocks(source, read_words)
    answers = count_grams(blocks, ORDER)
    sums = answers.where("block < 0").agg(F.sum("words"), F.sum("tokens")).first()
    all_words, all_tokens = (int(x or 0) for x in sums)

    def score(row: dict, block: Block, levels: list[Level], totals: list[np.ndarray]) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        counts = totals[0]
        start = int(block.tokens[0])  # every text begins with it; it is a context, not a token
        learned = all_tokens - int(counts[start])
        distinct = all_words - int(counts[start] > 0)
        first = (counts + 1) / (learned + distinct + 1)
        ends = np.cumsum(block.sizes)
        begins, ends = ends - block.sizes, ends - 1
        scores = traverse(build_automaton(levels, totals, first, weights), block.tokens, begins, ends)
        inside = np.ones(len(block.tokens), bool)
        inside[begins], inside[ends] = False, False
        base = np.add.reduceat(np.where(inside, np.log10(first)[block.tokens], 0.0), begins)
        known = np.add.reduceat((inside & (counts[block.tokens] > 0)).astype(np.int64), begins)
        arrow = to_arrow_schema(kind)
        columns = [row["docs"], block.counted, ends - begins - 1, known, np.full(len(begins), learned), base, scores]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return with_totals(blocks, answers, score, ORDER, kind).withColumnRenamed("doc", id)

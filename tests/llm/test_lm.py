import collections
import math

import pytest
from pyspark.sql import functions as F

from framewise.llm import lm_scoring
from framewise.llm.queries import QUERIES, remainder
from framewise.llm.shared import documents
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose, words


def by_hand(train, order, weights):
    """The same model from plain counters; ``weights`` by bucket."""
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        for i in range(order - 1, len(w)):
            for n in range(1, order + 1):
                grams[n][tuple(w[i - n + 1 : i + 1])] += 1
                grams[0][(n, tuple(w[i - n + 1 : i]))] += 1
    tokens, vocabulary = sum(grams[1].values()), len(grams[1])

    def probability(w, i):
        bucket, parts = 0, [1 / (vocabulary + 1)]
        for n in range(1, order + 1):
            context = grams[0][(n, tuple(w[i - n + 1 : i]))]
            parts.append(grams[n][tuple(w[i - n + 1 : i + 1])] / context if context else parts[0])
            if n > 1 and context:
                bucket = (n - 2) * lm_scoring.BUCKETS + int(math.log2(context)) + 1
        near = weights[min(weights, key=lambda b: (abs(b - bucket), b))]
        return sum(a * b for a, b in zip(near, parts, strict=True))

    def score(t):
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        return sum(math.log10(probability(w, i)) for i in range(order - 1, len(w)))

    return grams, tokens, vocabulary, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_counts(spark, scratch, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PARTITION_ENTRIES", 500)
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 700)
    texts = [(i, " ".join(prose(i % 17, 60).split()[i % 5 :]) + " the end", "a") for i in range(120)]
    captured = {}
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda h, o: captured.setdefault("w", learn(h, o)))
    got = lm_scoring.score(docs(spark, texts), scratch, F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 5, order).collect()
    weights = {r.bucket: r.weights for r in captured["w"].collect()}
    assert all(sum(w) == pytest.approx(1) and min(w) >= 0 for w in weights.values())
    train = [t for i, t, _ in texts if i % 7 != 2]
    grams, tokens, vocabulary, score = by_hand(train, order, weights)
    text = {i: t for i, t, _ in texts}
    assert len(got) == len(texts)
    for r in got:
        w = [*words(text[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(w), tokens, r.doc_id % 7 == 2)
        assert r.n_known == sum(grams[1][(x,)] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((grams[1][(x,)] + 1) / (tokens + vocabulary + 1)) for x in w))
        assert r.score == pytest.approx(score(text[r.doc_id]))


def test_weights_raise_the_likelihood(spark):
    """EM finds the mixture that made the counts."""
    rows = [(3, [0, 160], 900), (3, [0, -10000], 100), (4, [-10000, 32], 50)]
    got = {r.bucket: r.weights for r in lm_scoring.learn_weights(spark.createDataFrame(rows, "bucket int, steps array<int>, n long"), 2).collect()}
    assert got[3][2] > 0.85 and sum(got[3]) == pytest.approx(1) and got[4][1] == pytest.approx(0, abs=1e-6)


def test_awkward_rows(spark, scratch):
    got = lm_scoring.score(docs(spark, AWKWARD, extra=True), scratch, F.col("doc_id") == 7, F.col("doc_id") == 9).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(words(t)) + 1 for _, t, _ in AWKWARD)
    assert all(r.score < 0 and math.isfinite(r.score) and r.base_score < 0 for r in got)
    nothing = lm_scoring.score(docs(spark, AWKWARD), scratch, F.lit(True), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_empty(spark, scratch):
    assert lm_scoring.score(spark.createDataFrame([], DOCS), scratch, F.lit(False), F.lit(False)).count() == 0


def test_query_beats_the_base_on_texts_it_never_saw(spark):
    rows = [r for r in QUERIES["op3_lm_scoring"](spark, SF).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_query_counts_trigrams(spark, scratch):
    rest = remainder(7)
    want = lm_scoring.score(documents(spark, SF), scratch, rest == 2, rest == 5, order=3)
    assert {r.doc_id: r.score for r in QUERIES["op3_lm_scoring"](spark, SF).collect()} == pytest.approx({r.doc_id: r.score for r in want.collect()})

import collections

import pytest

from framewise.llm import mixing
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose, words


def by_hand(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: repeat * n for s, n in sizes.items()}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, scratch, extra):
    rows = mixing.taken_words(mixing.mix(docs(spark, AWKWARD, extra), scratch)).collect()
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t, _ in AWKWARD)
    sizes = collections.Counter()
    for _, text, source in AWKWARD:
        sizes[source] += len(words(text))
    target = by_hand(sizes)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_a_hot_source_and_many_shards(spark, scratch):
    table = [(i, prose(i, 20 + i % 90), "hot" if i % 3 else f"s{i % 11}") for i in range(600)]
    mixed = mixing.mix(docs(spark, table), scratch, block_words=16, shard_slots=64, chunk_rows=20)
    rows = mixing.taken_words(mixed).collect()
    again = mixing.taken_words(mixing.mix(docs(spark, table), scratch, block_words=16, shard_slots=64, chunk_rows=20)).collect()
    assert sorted(rows) == sorted(again)
    taken, target = collections.Counter(), {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    slots = mixed.slots.collect()
    assert len({r.slot for r in slots}) == len(slots) and {r.shard for r in slots} == {r.slot // 64 for r in slots}
    assert len({(r.rank, r["pass"], r.block) for r in slots}) == len(slots)
    # Shards draw by weight: every large one has slots of the hot source, not all of one shard.
    per = collections.Counter((r.shard, r.source) for r in slots)
    assert len({s for s, name in per if name == "hot"}) > 3


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, size):
    from pyspark.sql import functions as F

    got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(3)).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(size))


def test_documents_of_a_mix(spark, scratch):
    table = [(i, f"  {prose(i, 5 + i)}\n", "ab"[i % 2]) for i in range(60)] + [(1, prose(1, 6), "b"), (99, None, "a")]
    source = docs(spark, table, extra=True)
    mixed = mixing.mix(source, scratch, block_words=16)
    out = mixing.mixed_documents(source, mixed)
    assert out.columns == source.columns
    taken = collections.Counter()
    whole = {(i, s): t for i, t, s in table}
    for r in out.collect():
        taken[r.source] += len(words(r.text))
        assert not r.text or r.text.strip() in whole[r.doc_id, r.source] or len(words(r.text)) < len(words(whole[r.doc_id, r.source]))
    target = {r.source: r.target for r in mixing.taken_words(mixed).collect()}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_empty(spark, scratch):
    assert mixing.taken_words(mixing.mix(spark.createDataFrame([], DOCS), scratch)).count() == 0
    blank = docs(spark, [(1, None, "a"), (2, " ", "b")])
    assert [(r.taken, r.target) for r in mixing.taken_words(mixing.mix(blank, scratch)).collect()] == [(0, 0.0), (0, 0.0)]


def test_query(spark):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), __import__("framewise.llm.shared", fromlist=["Scratch"]).Scratch(spark, "plan")).pieces
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text

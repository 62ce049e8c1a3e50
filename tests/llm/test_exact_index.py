import hashlib

from framewise.llm import exact_index
from tests.llm.helpers import AWKWARD, DOCS, docs


def test_awkward_rows(spark):
    table = docs(spark, AWKWARD, extra=True)
    index = exact_index.DigestIndex(spark, buckets=4)
    index.admit(table)
    rows = exact_index.group_rows(table, index).collect()
    assert len(rows) == len(AWKWARD)
    groups = {}
    for i, text, _ in AWKWARD:
        groups.setdefault(hashlib.sha256((text or "").encode()).digest(), []).append(i)
    for r in rows:
        mine = groups[bytes(r.digest)]
        assert r.group_size == len(mine) and r.keep_id == max(i for i in mine if i is not None)
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_index.unique_rows(table)
    assert kept.columns == table.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, _ in AWKWARD})


def test_later_batches_lose_to_the_index(spark):
    index = exact_index.DigestIndex(spark, buckets=4)
    index.admit(docs(spark, [(5, "a", "s"), (6, "a", "s"), (1, "b", "s")]))
    second = docs(spark, [(9, "a", "s"), (3, "c", "s"), (8, "c", "s")])
    index.admit(second)
    assert sorted(r.doc_id for r in index.read().collect()) == [1, 6, 8]
    assert [r.doc_id for r in exact_index.unique_rows(second, index).collect()] == [8]
    again = exact_index.group_rows(second, index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(9, 6, False), (3, 8, False), (8, 8, True)}


def test_the_index_is_read_without_exchange(spark):
    index = exact_index.DigestIndex(spark, buckets=8)
    table = docs(spark, [(i, str(i), "s") for i in range(50)])
    index.admit(table)
    known = index.read().select("digest").hint("merge")
    fresh = table.select(exact_index.digest(table.text).alias("digest")).distinct()
    plan = fresh.join(known, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in side and side.count("Exchange") <= 2


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    index = exact_index.DigestIndex(spark)
    index.admit(empty)
    assert exact_index.group_rows(empty, index).count() == 0 and exact_index.unique_rows(empty).count() == 0

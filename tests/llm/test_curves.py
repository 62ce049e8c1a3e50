import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import curve_ann
from framewise.llm.queries import QUERIES
from tests.conftest import SF

TABLE = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k, modulus):
    ok = sorted((i, np.array(v, np.float32).astype(float)) for i, v in rows)
    out = {}
    for i, q in ok:
        if i % modulus == 0:
            near = sorted((-float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), j) for j, v in ok if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def check(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {q for q, near in want.items() if near}
    for q, near in found.items():
        assert [s for _, s in near] == pytest.approx([s for _, s in want[q]], abs=1e-12) and [j for j, _ in near] == [j for j, _ in want[q]]


@pytest.mark.parametrize("n,wide", [(2500, 16), (300, 3), (7, 64), (1, 4)])
def test_against_all_pairs(spark, scratch, n, wide):
    r = np.random.default_rng(n)
    rows = [(i, r.normal(size=wide).astype(np.float32).tolist()) for i in range(n)]
    got = curve_ann.nearest(spark.createDataFrame([(*x, 0) for x in rows], TABLE), F.col("vec_id") % 10 == 0, scratch, k=5).collect()
    check(got, by_hand(rows, 5, 10))


def test_hot_cluster_and_ties(spark, scratch):
    r = np.random.default_rng(3)
    hot = r.normal(size=8)
    rows = [(i, (hot + r.normal(size=8) * 1e-3).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] + [0.0] * 7) for i in range(40)]
    got = curve_ann.nearest(spark.createDataFrame([(*x, 0) for x in rows], TABLE), F.col("vec_id") % 100 == 0, scratch, k=5).collect()
    assert {r.query_id: [x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == r.query_id] for r in got}[1000] == [1001, 1002, 1003, 1004, 1005]
    check([r for r in got if r.query_id < 1000], {q: n for q, n in by_hand(rows, 5, 100).items() if q < 1000})


def test_awkward_rows(spark, scratch):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (30, []), (40, [0.0, 0.0]), (50, [1.0, nan]), (60, [inf, 1.0]), (70, [1.0, None]), (None, [1.0, 1.0]), (80, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (10, [0.0, 2.0]), (10, [0.0, 2.0])]
    table = spark.createDataFrame([(*x, 0) for x in bad + good], TABLE).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("rank", F.lit(1))
    check(curve_ann.nearest(table, F.col("vec_id") % 10 == 0, scratch, k=5).collect(), by_hand(good[:4], 5, 10))
    assert curve_ann.nearest(spark.createDataFrame([], TABLE), F.col("vec_id") % 10 == 0, scratch).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_moves_by_single_steps(dims, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = curve_ann.hilbert(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op6_curve_ann"](spark, SF).collect(), by_hand(rows, 5, 50))

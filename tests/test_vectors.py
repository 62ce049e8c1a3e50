"""Clustering and scoring: exact where the rule is sequential, invariants where a model is fitted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.adapters import table
from framewise.operators import scorer, vectors
from tests.conftest import SF


def follow(rows, threshold):
    means, sizes, labels = [], [], []
    for v in rows:
        sims = [float(v @ m / (np.linalg.norm(v) * np.linalg.norm(m))) for m in means]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or sims[best] < threshold:
            means.append(v.copy())
            sizes.append(1)
            labels.append(len(means) - 1)
        else:
            sizes[best] += 1
            means[best] += (v - means[best]) / sizes[best]
            labels.append(best)
    return labels


@pytest.fixture(scope="module")
def segments(spark):
    """Three speakers with noise, 40 segments per video."""
    rng = np.random.default_rng(5)
    base = np.eye(3, 8)
    rows = [(v, i, (base[rng.integers(3)] + rng.normal(0, 0.1, 8)).tolist()) for v in range(4) for i in range(40)]
    return spark.createDataFrame(rows, "video_id int, frame_idx bigint, emb array<double>")


def test_leader_cluster_is_sequential_within_a_block(segments):
    got = vectors.leader_cluster(segments, "emb", 0.55).toPandas().sort_values(["video_id", "frame_idx"])
    for _, part in got.groupby("video_id"):
        assert list(part.cluster) == follow([np.array(e) for e in part.emb], 0.55)


def by_levels(rows, threshold, block, fan):
    """The rule for videos of any length, with plain lists: follow in each stretch, then merge summaries level by level."""
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    names, level = [], []
    for g in range(0, len(rows), block):
        part = rows[g : g + block]
        labels = follow(part, threshold)
        level.append([(np.mean([v for v, x in zip(part, labels, strict=True) if x == c], axis=0), labels.count(c)) for c in range(max(labels) + 1)])
        names += [(len(level) - 1, x) for x in labels]
    while len(level) > 1:
        merged, moved = [], {}
        for first in range(0, len(level), fan):
            known = []
            for child in range(first, min(first + fan, len(level))):
                pairs = sorted((-cosine(m, v), p, c) for p, (m, _) in enumerate(known) for c, (v, _) in enumerate(level[child]))
                taken, place = set(), {}
                for sim, p, c in pairs:
                    if -sim >= threshold and p not in taken and c not in place:
                        taken.add(p)
                        place[c] = p
                for c, (v, n) in enumerate(level[child]):
                    if c in place:
                        m, k = known[place[c]]
                        known[place[c]] = ((m * k + v * n) / (k + n), k + n)
                    else:
                        place[c] = len(known)
                        known.append((v, n))
                    moved[child, c] = (len(merged), place[c])
            merged.append(known)
        names, level = [moved[x] for x in names], merged
    return [c for _, c in names]


@pytest.mark.parametrize(("block", "fan"), [(4, 2), (7, 3), (16, 16), (3, 16)])
def test_leader_cluster_merges_stretches_level_by_level(segments, block, fan, monkeypatch):
    monkeypatch.setattr(vectors, "LEADER_FAN", fan)
    got = vectors.leader_cluster(segments, "emb", 0.55, block=block).toPandas().sort_values(["video_id", "frame_idx"])
    assert len(got) == 160
    for _, part in got.groupby("video_id"):
        assert list(part.cluster) == by_levels([np.array(e) for e in part.emb], 0.55, block, fan)


def test_a_speaker_who_returns_keeps_the_number(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(0, i, a) for i in range(10)] + [(0, i, b) for i in range(10, 30)] + [(0, i, a) for i in range(30, 40)]
    rows += [(None, i, b) for i in [*range(5), *range(5000, 5005)]]  # nothing in between
    df = spark.createDataFrame(rows, "video_id int, frame_idx bigint, emb array<double>")
    got = {(r.video_id, r.frame_idx): r.cluster for r in vectors.leader_cluster(df, "emb", 0.55, block=10).collect()}
    assert [got[0, i] for i in range(40)] == [0] * 10 + [1] * 20 + [0] * 10
    assert len(got) == 50 and {v for k, v in got.items() if k[0] is None} == {0}


def test_one_tile_and_many_tiles_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 6).tolist() if i % 11 else None if i % 2 else [0.0] * 5) for i in range(300)]
    centres = spark.createDataFrame([(str(c), rng.normal(0, 1, 6).tolist()) for c in range(90)] + [("z", [0.0] * 6)], "cluster string, centroid array<double>")
    df = spark.createDataFrame(rows, "id int, v array<double>")
    whole = {r.id: (r.cluster, pytest.approx(r.similarity)) for r in vectors.assign_centroid(df, "v", centres).collect()}
    monkeypatch.setattr(vectors, "TILE_BYTES", 1000)
    monkeypatch.setattr(vectors, "STRIP_CELLS", 50)
    assert {r.id: (r.cluster, r.similarity) for r in vectors.assign_centroid(df, "v", centres).collect()} == whole
    assert whole[0][0] is None and whole[11][0] is None and len(whole) == 300


def test_a_hundred_thousand_centroids(spark):
    """Far more than one tile: every vector finds itself."""
    centres = spark.range(100_000).select(F.col("id").alias("cluster"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(7) + F.pmod(F.xxhash64("id", i), F.lit(1000)) / 100.0).alias("centroid"))
    centres = centres.select("cluster", F.transform("centroid", lambda x: x * 0 + F.floor(x)).alias("centroid"))
    asked = centres.where("cluster % 500 = 0").select("cluster", F.col("centroid").alias("v")).withColumnRenamed("cluster", "id")
    got = vectors.assign_centroid(asked, "v", centres).collect()
    assert len(got) == 200 and all(r.similarity == pytest.approx(1) for r in got)


def test_average_linkage_against_all_pairs():
    rng = np.random.default_rng(1)
    points = [np.eye(6)[rng.integers(6)] + rng.normal(0, 0.3, 6) for _ in range(40)]
    units = [p / np.linalg.norm(p) for p in points]
    groups = [[i] for i in range(40)]
    mean = lambda a, b: np.mean([1 - units[i] @ units[j] for i in a for j in b])
    while len(groups) > 1:
        d, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > 0.3:
            break
        groups[i] += groups.pop(j)
    owner = vectors.average_linkage(np.array(units), np.ones(40), 0.3)
    assert sorted(sorted(i for i, x in enumerate(owner) if x == g) for g in set(owner)) == sorted(map(sorted, groups))


@pytest.mark.parametrize("most", [2000, 12])
def test_global_identity_finds_planted_identities(spark, most):
    """By distance, whatever their number; null, zero and broken vectors belong to none."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 9, (np.eye(9, 16)[i % 9] + rng.normal(0, 0.05, 16)).tolist()) for i in range(900)]
    rows += [(900, None, None), (901, None, [0.0] * 16), (902, None, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id int, who int, emb array<double>").repartition(20)
    got = vectors.global_identity(df, "emb", 0.3, most).toPandas()
    real = got[got.who.notna()]
    assert len(got) == 903 and real.groupby("who").cluster.nunique().max() == 1 and real.cluster.nunique() == 9
    assert got[got.id.isin([900, 902])].cluster.isna().all() and got[got.id == 901].similarity.item() == 0 and real.similarity.between(0.7, 1.0001).all()


def test_identical_vectors_share_one_identity(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 2.0]) for i in range(40)], "id int, emb array<double>")
    got = vectors.global_identity(df, "emb").toPandas()
    assert got[got.id % 3 > 0].cluster.tolist() == [0] * 26 and got[got.id % 3 == 0].cluster.tolist() == [1] * 14


def test_valid_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1e-12]), (3, [1.0, float("nan")]), (4, None)], "id int, v array<double>")
    assert [r.id for r in vectors.valid_vectors(df, "v").collect()] == [1]


def test_embeddings_are_assigned_to_their_best_centroid(spark):
    e = table(spark, SF, "embeddings")
    centres = vectors.centroids(e, "embedding", "label")
    got = vectors.assign_centroid(e, "embedding", centres, "label").toPandas()
    c = np.stack(centres.orderBy("cluster").toPandas().centroid)
    v = np.stack(got.embedding)
    sims = (v @ c.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(c, axis=1))
    assert list(got.cluster) == list(sims.argmax(axis=1))


def test_scorer_separates_and_balances(spark):
    df = spark.range(400).select((F.col("id") % 10 == 0).cast("int").alias("y"), (F.col("id") % 10 * 1.0).alias("x"), F.rand(1).alias("z"))
    weighted = scorer.balanced_weights(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).toPandas()
    assert weighted.w.tolist() == pytest.approx([200, 200])
    model = scorer.fit_scorer(df, ["x", "z"], "y")
    scored = scorer.score(model, df).toPandas()
    assert ((scored.probability > 0.5).astype(int) == scored.y).mean() > 0.95
    assert scored.confidence.between(-1, 1).all()

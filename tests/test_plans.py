"""Scans that read once, windows of any width, exact thresholds and lanes, null keys, and generators of long videos."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import catalog.load  # noqa: F401
from catalog.registry import QUERIES
from framewise.operators import align, ensemble, intervals, metrics, selection, smoothing, windows
from framewise.plans import blocks
from tests.conftest import SF


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(("name", "most"), [
    ("cumulative", 2), ("complement", 4), ("density_window", 2), ("overlap_pairs", 2), ("align_report", 4), ("validate_videos", 7), ("validation_summary", 7),
])
def test_sources_are_read_few_times(spark, name, most):
    plan = executed(QUERIES[name](spark, SF))
    assert len(re.findall(r"FileScan parquet", plan)) <= most and "ReusedExchange" in plan


def test_two_phase_keeps_null_keys_and_all_kinds(spark, small_blocks):
    r = random.Random(4)
    rows = [(k, i, None if r.random() < 0.3 else r.randint(-9, 9)) for k in (1, None) for i in range(40)]
    df = blocks.with_block(spark.createDataFrame(rows, "k int, i bigint, x int"), "i")
    x = F.col("x")
    for inclusive in (True, False):
        got = blocks.two_phase(
            df, "k", "i", running={"s": ("sum", x), "n": ("count", x), "l": ("last", x), "m": ("max", x)}, backward={"b": ("last", x), "bs": ("sum", x)},
            stats={"lo": ("min", x), "all": ("count", F.lit(1))}, inclusive=inclusive,
        ).collect()
        assert len(got) == 80
        for row in got:
            mine = [v for k, i, v in rows if k == row.k]
            before, after = mine[: row.i + inclusive], mine[row.i + 1 - inclusive :]
            real = [v for v in before if v is not None]
            later = [v for v in after if v is not None]
            assert (row.s, row.n, row.l, row.m) == (sum(real), len(real), real[-1] if real else None, max(real, default=None))
            assert (row.b, row.bs, row.lo, row.all) == (later[0] if later else None, sum(later), min(v for v in mine if v is not None), 40)


@pytest.mark.parametrize("rows_per_block", [7, 50, 16384])
def test_rolling_windows_against_pandas(spark, rows_per_block, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", rows_per_block)
    r = np.random.default_rng(1)
    n = 300
    data = pd.DataFrame({"far": 1e6 + r.normal(0, 0.01, n), "flat": np.where(np.arange(n) % 100 < 60, 5.5, r.normal(0, 100, n)), "gaps": r.normal(0, 1, n)})
    data.loc[r.random(n) < 0.2, "gaps"] = None
    odd = [float("nan") if i == 40 else float("inf") if i == 120 else float("-inf") if i in (190, 260) else float(i % 7) for i in range(n)]
    rows = [(None, i, *(None if pd.isna(v) else float(v) for v in row), odd[i]) for i, row in enumerate(data.itertuples(index=False))]
    df = spark.createDataFrame(rows, "video_id int, frame_idx bigint, far double, flat double, gaps double, odd double")
    sizes, cols = [3, 10, 31, 120], ["far", "flat", "gaps", "odd"]
    got = windows.rolling_std(windows.rolling_mean(df, cols, sizes), cols, sizes).orderBy("frame_idx").toPandas()
    assert len(got) == n
    for size in sizes:
        for i in range(n):
            lo, hi = max(0, i - size // 2), i + (size - 1) // 2 + 1
            for c in cols[:3]:
                part = data[c].iloc[lo:hi].dropna()
                mean, dev = got[f"{c}_ma{size}"][i], got[f"{c}_std{size}"][i]
                assert mean == pytest.approx(part.mean(), rel=1e-12, abs=1e-9) if len(part) else pd.isna(mean)
                want = part.std() if len(part) > 1 else 0.0
                assert dev == pytest.approx(want, rel=1e-5, abs=2e-6 if c != "far" else 1e-7)
                if c == "flat" and part.nunique() == 1:
                    assert dev == 0
            part = np.array(odd[lo:hi])
            with np.errstate(invalid="ignore"):
                mean = got[f"odd_ma{size}"][i]
                assert (math.isnan(mean) and math.isnan(part.mean())) or mean == pytest.approx(part.mean())
            assert math.isnan(got[f"odd_std{size}"][i]) == (not np.isfinite(part).all())


def test_keyframes_against_plain_interpolation(spark, small_blocks):
    r = random.Random(6)
    clips, frames = [], []
    for c in [*range(25), None]:
        clips.append((c, r.choice([0, 1, 5, 40]), 7.5 if r.random() < 0.2 else None))
        frames += [(c, r.randint(-10, 50), r.choice([None, 1.0, 2.0, -3.0])) for _ in range(r.choice([0, 1, 2, 6]))]
    frames.append((99, 3, 1.0))  # of no clip
    for step in (1, 3):
        done = align.keyframe_values(
            spark.createDataFrame(clips, "clip int, length int, fixed double"), spark.createDataFrame(frames, "clip int, when bigint, value double"),
            "length", "fixed", 100.0, step=step,
        ).collect()
        got = {(x.clip, x.when): x.value for x in done}
        assert len(got) == len(done) == sum(len(range(0, n, step)) for _, n, _ in clips)
        least = lambda xs: min(xs, key=lambda v: (v is not None, v or 0))
        most = lambda xs: max(xs, key=lambda v: (v is not None, v or 0))
        for c, n, fixed in clips:
            own = {}
            for k, w, v in frames:
                if k == c:
                    own.setdefault(w, []).append(v)
            for t in range(0, n, step):
                before, after = [w for w in own if w <= t], [w for w in own if w > t]
                a, b = most(own[max(before)]) if before else None, least(own[min(after)]) if after else None
                mixed = b if a is None else a if b is None else a + (b - a) * ((t - max(before)) / (min(after) - max(before)))
                want = fixed if fixed is not None else mixed if mixed is not None else 100.0
                assert got[c, t] == pytest.approx(want), (c, t)


def clip_frames(scores, threshold, length):
    total = run = 0
    for s in [*scores, None]:
        if s is not None and s >= threshold:
            run += 1
        else:
            total, run = total + (run if run >= length else 0), 0
    return total


@pytest.mark.parametrize("min_seconds", [0.0, 0.5, 2.0, 50.0])
def test_the_adjusted_threshold_is_the_largest_that_satisfies(spark, small_blocks, min_seconds):
    r = random.Random(8)
    rows = [(v, i, None if r.random() < 0.05 else round(r.random(), 2) if v != 2 else 0.5) for v in (0, 1, 2, None) for i in range(90) if v != 1 or i % 30]
    df = spark.createDataFrame(rows, "video_id int, frame_idx bigint, score double")
    current = df.groupBy("video_id").agg(F.lit(0.93).alias("threshold"))
    got = {x.video_id: x for x in selection.adjust_threshold(df, "score", current, "threshold", min_seconds, 0.3).collect()}
    for v in (0, 1, 2, None):
        scores = [next((s for k, i, s in rows if k == v and i == t), None) for t in range(90)]
        tried = sorted({0.93, *(s for s in scores if s is not None and s < 0.93)}, reverse=True)
        best = next((t for t in tried if clip_frames(scores, t, 3) >= min_seconds * 10), None)
        assert got[v].satisfied == (best is not None)
        assert got[v].threshold == (best if best is not None else min(s for s in scores if s is not None))


def first_fit(clips):
    ends, lanes = [], []
    for s, e in clips:
        lane = next((i for i, t in enumerate(ends) if s >= t), len(ends))
        ends[lane:lane + 1] = [e]
        lanes.append(lane)
    return lanes


def test_lanes_are_first_fit_on_many_simultaneous_clips(spark):
    r = random.Random(9)
    clips = sorted((r.randint(0, 4000), i) for i in range(10_000))
    rows = [(0 if i % 4 else None, i, s, s + 3000 + r.randint(0, 3000)) for s, i in clips]
    got = intervals.pack_lanes(spark.createDataFrame(rows, "video_id int, id int, start_frame bigint, end_frame bigint"), "id").collect()
    assert len(got) == 10_000
    for v in (0, None):
        mine = sorted((x.start_frame, x.id, x.end_frame, x.lane) for x in got if x.video_id == v)
        assert [x[3] for x in mine] == first_fit([(s, e) for s, _, e, _ in mine])


def test_null_keys_meet(spark, small_blocks):
    rows = [(None, i, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx bigint, score double")
    assert all(x.smoothed == pytest.approx(1.0) for x in smoothing.exponential(df, "score", 0.9).collect())
    clips = spark.createDataFrame([(None, 5, 20, "hello", 0)], "video_id int, start_frame bigint, end_frame bigint, text string, ord int")
    assert sum(x.caption_active for x in align.frame_concat(df, clips, "ord", "text").collect()) == 15
    assert [x.mean_score for x in intervals.score_clips(clips, df, "score").collect()] == [1.0]
    assert sum(x.text == "hello" for x in align.frame_first_match(df, clips, "ord", ["text"]).collect()) == 15
    totals = spark.createDataFrame([(None, 30)], "video_id int, last bigint")
    assert sum(x.active for x in align.label_grid(clips, totals, "last").collect()) == 15
    assert align.zip_by_index(df, df.withColumnRenamed("score", "other")).count() == 200


def test_scores_that_crowd_are_split(spark):
    """Nearly all scores lie in one bucket of a fixed grid."""
    df = spark.range(20_000).select((F.lit(0.5) + F.col("id") * 1e-9).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    spread = blocks.range_blocks(df.groupBy("score").count(), [], "score").groupBy(blocks.BLOCK).count().collect()
    assert len(spread) == 8 and max(x["count"] for x in spread) < 8000
    curve = metrics.pr_curve(df, "score", "y").orderBy("threshold").collect()
    assert [x.n_pred for x in curve] == list(range(20_000, 0, -1)) and curve[0].tp == 6667


def test_names_are_numbered_in_any_order(spark):
    rows = [("b", 0.5, "t2"), ("a", 0.25, "t9"), ("c", 0.25, "t1"), ("b", -1.0, "t3"), ("a", float("inf"), "t8")]
    df = spark.createDataFrame(rows, "name string, at double, stamp string")
    assert {x.name: x.asset_id for x in ensemble.first_seen_id(df, (), "name", "at").collect()} == {"b": 0, "a": 1, "c": 2}
    assert {x.name: x.asset_id for x in ensemble.first_seen_id(df, (), "name", "stamp").collect()} == {"c": 0, "b": 1, "a": 2}


def test_a_long_video_is_generated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 100)
    totals = spark.createDataFrame([(1, 50_000), (None, 3), (2, -1)], "video_id int, last bigint")
    made = align.grid(totals, "last")
    assert {r.video_id: (r.n, r.lo, r.hi) for r in made.groupBy("video_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi")).collect()} == {
        1: (50_001, 0, 50_000), None: (4, 0, 3)}
    parts = made.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(parts) > 4 and max(x["count"] for x in parts) < 25_000


def test_long_segments_are_cut_once(spark):
    texts = [
        "  one. two!　three 、 four  ", "no marks at all ", "   ", "", None, "...", "a.\n\n b ?c", " . x", "é。\t\tü", "tail.   ", "one . .  two", "a" * 50 + " " * 500 + "b. c",
    ]
    segs = spark.createDataFrame([(i, 0, 100 if i % 7 else 40, t) for i, t in enumerate(texts * 2)], "id int, s int, e int, text string")
    done = intervals.split_long(segs, "text", "s", "e", 50, ("id",))
    # What is cut beside a generator is cut again for every piece.
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {}
    for r in done.orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.piece, r.piece_start, r.piece_end))
    assert len(got) == len(texts) * 2
    for i, text in enumerate(texts * 2):
        pieces = [p.strip() for p in re.findall("[^。、！？.,!?]*[。、！？.,!?]|[^。、！？.,!?]+", text or "") if p.strip()]
        if i % 7 == 0 or len(pieces) < 2:
            assert [p for p, _, _ in got[i]] == [text] and got[i][0][2] == (100 if i % 7 else 40)
            continue
        ends = np.minimum(np.cumsum([len(p) for p in pieces]) * (100 / len(text)), 100)
        assert [p for p, _, _ in got[i]] == pieces
        assert [b for _, _, b in got[i]] == pytest.approx(list(ends)) and [a for _, a, _ in got[i]] == pytest.approx([0, *ends[:-1]])

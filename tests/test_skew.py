"""One video holds most rows: results stay exact and no task receives a whole video."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewise.operators import align, intervals, selection, windows
from framewise.plans import blocks


@pytest.fixture(scope="module")
def hot(spark):
    """600 frames of video 0, 20 frames each of ten others."""
    rng = random.Random(3)
    rows = [(0, i, rng.randrange(100), int(rng.random() < 0.6)) for i in range(600)]
    rows += [(v, i, rng.randrange(100), int(rng.random() < 0.6)) for v in range(1, 11) for i in range(20)]
    return spark.createDataFrame(rows, "video_id int, frame_idx bigint, x int, on_ int")


def pandas_runs(pdf, gap=0):
    """Runs of set frames, joined across at most ``gap`` unset ones."""
    out = []
    for video, part in pdf.sort_values("frame_idx").groupby("video_id"):
        for i in part[part.on_ == 1].frame_idx:
            if out and out[-1][0] == video and i - out[-1][2] <= gap:
                out[-1][2] = i + 1
            else:
                out.append([video, i, i + 1])
    return sorted(map(tuple, out))


def test_runs_and_merging_across_blocks(spark, small_blocks, hot):
    pdf = hot.toPandas()
    found = intervals.extract_clips(hot, "on_")
    assert sorted((r.video_id, r.start_frame, r.end_frame) for r in found.collect()) == pandas_runs(pdf)
    merged = intervals.merge_gaps(found, 2)
    assert sorted((r.video_id, r.start_frame, r.end_frame) for r in merged.collect()) == pandas_runs(pdf, 2)


def test_running_sums(spark, small_blocks, hot):
    pdf = hot.toPandas().sort_values(["video_id", "frame_idx"])
    pdf["want"] = pdf.groupby("video_id").x.cumsum()
    got = blocks.two_phase(
        blocks.with_block(hot, "frame_idx"), "video_id", "frame_idx", running={"total": ("sum", F.col("x"))},
        backward={"rest": ("sum", F.col("x"))}, stats={"all_": ("sum", F.col("x"))},
    ).toPandas().sort_values(["video_id", "frame_idx"])
    assert list(got.total) == list(pdf.want)
    assert list(got.rest) == list(got.all_ - got.total + got.x)


def windows_by(df):
    """Partition columns of every window in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"windowspecdefinition\(([^)]*?)(?: ASC| DESC|, specified)", plan)], plan


def test_no_window_over_rows_is_partitioned_by_video_alone(spark, hot):
    chains = [
        windows.rolling_mean(hot, ["x"], [5]), windows.silence_timer(hot, "on_"), windows.cumulative(hot, "on_"),
        intervals.extract_clips(hot, "on_"), intervals.merge_gaps(intervals.extract_clips(hot, "on_"), 2),
    ]
    for df in chains:
        specs, plan = windows_by(df)
        assert specs
        for spec in specs:
            # A carry window orders by the block: it sees one pre-aggregated row per block.
            assert blocks.BLOCK in spec or "_lane" in spec or "_s_" in plan, spec
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shuffle_for_bounded_windows(spark, hot):
    plan = windows.temporal_features(hot, ["x"], "on_")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def brute_budget(clips, target, limit):
    total, taken = 0, []
    for score, start, length in sorted(clips, key=lambda c: (-c[0], c[1])):
        if total >= target:
            break
        if total + length <= limit:
            total += length
            taken.append(start)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(6))
def test_budget_against_brute_force(spark, seed):
    rng = random.Random(seed)
    clips = [(rng.randrange(30), i * 50, rng.choice([1, 2, 3, 5, 8, 13, 30, 44])) for i in range(400)]
    df = spark.createDataFrame([(1, s, s + n, float(sc)) for sc, s, n in clips], "video_id int, start_frame bigint, end_frame bigint, score double")
    got = sorted(r.start_frame for r in selection.select_budget(df, "score", 60, 75).collect())
    assert got == brute_budget(clips, 60, 75)


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_and_lanes_against_brute_force(spark, small_blocks, seed):
    rng = random.Random(seed)
    # Many clips share a few starts, as copies do.
    clips = [(i, s := rng.choice([0, 3, 3, 3, 20, 41]) + rng.randrange(3), s + rng.randrange(0, 12)) for i in range(120)]
    df = spark.createDataFrame([(1, i, s, e) for i, s, e in clips], "video_id int, ord int, start_frame bigint, end_frame bigint")
    real = [c for c in clips if c[2] > c[1]]
    got = {r.ord: (r.partners, r.overlap_frames) for r in intervals.overlaps(df).collect()}
    for i, s, e in real:
        shared = [min(e, e2) - max(s, s2) for j, s2, e2 in real if j != i and max(s, s2) < min(e, e2)]
        assert got[i] == (len(shared), sum(shared))
    pairs = sorted((a[0], b[0]) for a in real for b in real if a[0] < b[0] and max(a[1], b[1]) < min(a[2], b[2]))
    assert sorted((r.clip1, r.clip2) for r in intervals.overlap_report(df, "ord", 20).collect()) == pairs[:20]
    lanes, want = [], {}
    for i, s, e in sorted(clips, key=lambda c: (c[1], c[0])):
        lane = next((n for n, t in enumerate(lanes) if s >= t), len(lanes))
        lanes[lane:lane + 1] = [e]
        want[i] = lane
    assert {r.ord: r.lane for r in intervals.pack_lanes(df, "ord").collect()} == want


def test_interval_join_meets_each_pair_once(spark, small_blocks):
    frames = spark.range(100).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"))
    spans = spark.createDataFrame([(1, 0, 100, 0), (1, 6, 8, 1), (1, 50, 50, 2)], "video_id int, start_frame bigint, end_frame bigint, ord int")
    assert align.interval_join(frames, spans).count() == 102

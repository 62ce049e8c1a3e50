"""Literal cases that pin down edge rules."""

import pytest
from pyspark.sql import functions as F

from framewise.functions import naming, text, times
from framewise.operators import align, datasets, ensemble, intervals, metrics, selection, smoothing, windows
from framewise.plans import blocks

pytestmark = pytest.mark.usefixtures("small_blocks")


def series(spark, values, video=1, name="x"):
    return spark.createDataFrame([(video, i, v) for i, v in enumerate(values)], f"video_id int, frame_idx bigint, {name} double")


def column(df, name, order="frame_idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_value_change_first_row_counts(spark):
    assert column(windows.value_change(series(spark, [1.0, 1.0, 2.0]), "x"), "x_changed") == [1, 0, 1]


def test_even_centred_window(spark):
    got = column(windows.rolling_mean(series(spark, [float(i) for i in range(20)]), ["x"], [10]), "x_ma10")
    want = [sum(range(max(0, i - 5), min(20, i + 5))) / (min(20, i + 5) - max(0, i - 5)) for i in range(20)]
    assert got == pytest.approx(want)


def test_single_row_timing_is_positive_zero(spark):
    row = windows.cut_timing(series(spark, [3.0]), "x").first()
    assert str(row.time_since_prev) == str(row.time_to_next) == "0.0"


def clip_rows(spark, spans, extra="", start="start_frame", end="end_frame"):
    return spark.createDataFrame([(1, *s) for s in spans], f"video_id int, {start} bigint, {end} bigint{extra}")


def test_budget_skips_what_does_not_fit(spark):
    clips = clip_rows(spark, [(0, 80, 10.0), (100, 175, 9.0), (200, 220, 8.0)], ", score double")
    kept = selection.select_budget(clips, "score", 90, 150).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in kept] == [(0, 80), (200, 220)]


def test_budget_keeps_all_within_target(spark):
    clips = clip_rows(spark, [(0, 20, 1.0), (30, 60, 9.0)], ", score double")
    assert selection.select_budget(clips, "score", 90, 150, only_if_over=True).count() == 2


def test_order_of_merge_and_filter(spark):
    clips = clip_rows(spark, [(0, 20), (25, 45)])
    merged_first = intervals.refine_clips(clips, 5, 30, ("merge", "filter")).collect()
    assert [(r.start_frame, r.end_frame) for r in merged_first] == [(0, 45)]
    assert intervals.refine_clips(clips, 5, 30, ("filter", "merge")).count() == 0


@pytest.mark.parametrize("mode,n,length,overlap,starts", [
    ("tail", 1500, 1000, 500, [0, 500]), ("tail", 1501, 1000, 500, [0, 500, 501]), ("tail", 30, 1000, 500, [0]),
    ("drop", 1499, 1000, 500, [0]), ("drop", 999, 1000, 500, []), ("pad", 250, 100, 0, [0, 100, 200]),
    ("pad", 100, 100, 0, [0]), ("tail", 70, 40, 10, [0, 30, 30]),
])
def test_window_starts(spark, mode, n, length, overlap, starts):
    df = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"), F.col("id").cast("double").alias("x"))
    cut = datasets.windows(df, ["x"], length, overlap, mode).orderBy("window_index").collect()
    assert [r.window_start for r in cut] == starts
    assert all(len(r["values"]) == len(r.mask) == length for r in cut)
    assert [r.total_windows for r in cut] == [len(starts)] * len(starts)
    if mode == "pad" and n == 250:
        assert cut[-1].padding_length == 50


def test_first_fit_lanes(spark):
    clips = clip_rows(spark, [(0, 5, 0), (1, 3, 1), (3, 6, 2), (5, 7, 3)], ", ord int")
    assert column(intervals.pack_lanes(clips, "ord"), "lane", "ord") == [0, 1, 1, 0]


def test_last_clip_wins_for_params_first_for_names(spark):
    clips = clip_rows(spark, [(0, 10, 0, 0, "A", 1.0), (5, 15, 1, 0, "B", 2.0)], ", ord int, track int, name string, scale double")
    totals = spark.createDataFrame([(1, 16)], "video_id int, steps int")
    cells = align.clips_to_frames(clips, totals, "steps", ["scale"], "ord", tracks=1)
    assert [r.scale for r in cells.where("frame_idx = 7").collect()] == [2.0]
    frames = spark.createDataFrame([(1, 7, 0)], "video_id int, frame_idx bigint, track int")
    assert align.frame_clip_attrs(frames, clips, ["name"], "ord").first().name == "A"


def test_asof_before_first_source(spark):
    targets = spark.createDataFrame([(1, 1), (1, 6)], "video_id int, time bigint")
    sources = spark.createDataFrame([(1, 5, 9.0), (1, 8, 4.0)], "video_id int, time bigint, v double")
    assert column(align.asof_ffill(targets, sources, ["v"], width=3), "v_asof", "time") == [9.0, 9.0]


def test_interpolation_clamps_and_marks(spark):
    targets = spark.createDataFrame([(1, t) for t in (0, 5, 10, 15, 40)], "video_id int, time bigint")
    sources = spark.createDataFrame([(1, 5, 1.0), (1, 15, 3.0)], "video_id int, time bigint, v double")
    done = align.interp_linear(targets, sources, ["v"], 2, width=4)
    assert column(done, "v_interp", "time") == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert column(done, "interpolated", "time") == [True, False, True, False, True]


def test_label_grid_has_every_tick(spark):
    totals = spark.createDataFrame([(1, 6000)], "video_id int, last int")
    grid = align.label_grid(clip_rows(spark, [(10, 20), (15, 30)]), totals, "last")
    assert grid.count() == 6001
    assert grid.agg(F.sum("active")).first()[0] == 20


def test_texts_joined_in_list_order(spark):
    frames = spark.createDataFrame([(1, 2)], "video_id int, frame_idx bigint")
    clips = clip_rows(spark, [(0, 5, 1, "b"), (1, 4, 0, "a")], ", ord int, text string")
    row = align.frame_concat(frames, clips, "ord", "text").first()
    assert (row.caption_text, row.caption_active) == ("a | b", 1)


def test_hard_vote_differs_from_prediction(spark):
    votes = spark.createDataFrame([(1, 0.95), (1, 0.45), (1, 0.45)], "f int, p double")
    row = ensemble.ensemble(votes, "hard", ["f"], "p").first()
    assert (row.vote, row.prediction) == (0, 1)


def test_complement_of_nested_clips(spark):
    totals = spark.createDataFrame([(1, 20), (2, 4)], "video_id int, total bigint")
    gaps = intervals.complement(clip_rows(spark, [(0, 10), (2, 4)]), totals, "total").orderBy("video_id").collect()
    assert [(r.video_id, r.gap_start, r.gap_end, r.covered) for r in gaps] == [(1, 10, 20, 10), (2, 0, 4, 0)]


def test_short_series_is_not_smoothed(spark):
    for method in ("ma", "savgol"):
        assert column(smoothing.smooth(series(spark, [1.0, 5.0, 1.0]), "x", method, window=5), "smoothed") == [1.0, 5.0, 1.0]


def test_savgol_weights():
    assert smoothing.savgol_weights(5, 2) == pytest.approx([w / 35 for w in (-3, 12, 17, 12, -3)])
    assert len(smoothing.savgol_weights(4, 2)) == 5
    assert smoothing.savgol_weights(3, 9) == pytest.approx([0, 1, 0], abs=1e-9)


def test_ema_by_window_and_alpha_one(spark):
    xs = [float(x) for x in (1, 4, 2, 8, 5, 7, 1, 3, 3, 9, 2)]
    for alpha, window in ((0.3, None), (None, 4), (1.0, None), (0.9, None)):
        a = alpha if alpha else 2 / (window + 1)
        want = [xs[0]]
        for x in xs[1:]:
            want.append(a * x + (1 - a) * want[-1])
        got = column(smoothing.exponential(series(spark, xs), "x", alpha, window), "smoothed")
        assert got == pytest.approx(want)


def test_ema_over_many_blocks(spark):
    xs = [float((i * 37) % 101) for i in range(1500)]
    want = [xs[0]]
    for x in xs[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert column(smoothing.exponential(series(spark, xs), "x", 0.3), "smoothed") == pytest.approx(want, abs=1e-9)


def test_threshold_of_zero_gives_way(spark):
    scores = series(spark, [0.0] * 10 + [1.0] * 10, name="score")
    # From the lowest threshold on, 20 frames; above it 10. Both are admissible for 2 s.
    row = selection.search_threshold(scores, "score", 2.0).first()
    assert row.threshold > 0 and row.active_frames == 10


def test_short_video_is_accepted_whole(spark):
    row = selection.search_threshold(series(spark, [0.2, 0.4], name="score"), "score", 180.0).first()
    assert (row.threshold, row.active_frames) == (-0.8, 2)


def test_best_track_tie_goes_to_lowest(spark):
    scores = spark.createDataFrame([(1, 0, 2, 0.8), (1, 0, 1, 0.8), (1, 1, 0, 0.1)], "video_id int, frame_idx bigint, track int, p double")
    assert column(selection.best_track(scores, "p", 0.5), "best_track") == [1, -1]


def test_merge_short_uses_each_segment_once(spark):
    spans = [(0, 4, 0, "a"), (5, 9, 1, "b"), (10, 14, 2, "c"), (15, 60, 3, "d"), (70, 72, 4, "e")]
    segs = clip_rows(spark, spans, ", pos bigint, text string")
    done = intervals.merge_short(segs, "text", "start_frame", "end_frame", "pos", 5, 5).orderBy("pos").collect()
    assert [(r.start_frame, r.end_frame, r.text) for r in done] == [(0, 9, "a b"), (10, 60, "c d"), (70, 72, "e")]


def test_split_at_sentence_marks(spark):
    segs = spark.createDataFrame([(1, 0, 100, "ab。cd！ ef")], "id int, s int, e int, text string")
    done = intervals.split_long(segs, "text", "s", "e", 50, ("id",)).orderBy("part").collect()
    assert [r.piece for r in done] == ["ab。", "cd！", "ef"]
    assert done[0].piece_end == pytest.approx(100 * 3 / 9)


def test_text_features(spark):
    # One text per class.
    rows = [("ひらがな",), ("latin",), ("漢字 mix",), ("カタカナ",), ("まぜ、MIX！",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.text_features(F.col("t"))).collect()]
    assert got[0] == [4, 1, 0, 0, 0, 0.08]
    assert got[1] == [5, 0, 0, 0, 0, 0.1]
    assert got[2][3] == 1 and got[3][2] == 1 and got[4][1] == got[4][4] == 1
    assert got[5] == got[6] == [0] * 6


def test_names_and_times(spark):
    rows = spark.createDataFrame([("Alice_happy_001.png", "1001/30000s"), ("bob-sad.PNG", "90"), ("_x_", "zz")], "n string, t string")
    got = rows.select(naming.speaker_base_name(F.col("n")), times.parse_time(F.col("t"))).collect()
    assert [g[0] for g in got] == ["alice", "bob", "x"]
    assert [g[1] for g in got] == pytest.approx([1001 / 30000, 3.0, 0.0])


def test_fold_sizes_follow_the_greedy_rule():
    import random

    rng = random.Random(1)
    for _ in range(200):
        loads = [rng.randrange(50) for _ in range(4)]
        size, count = rng.randrange(1, 12), rng.randrange(0, 40)
        slow, want = list(loads), [0] * 4
        for _ in range(count):
            f = slow.index(min(slow))
            slow[f] += size
            want[f] += 1
        assert datasets._share_out(loads, size, count) == want


def test_augment_shift_is_a_rotation(spark):
    done = datasets.augment_shift(series(spark, [float(i) for i in range(10)]), 3)
    assert column(done, "x") == [7.0, 8.0, 9.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_augment_noise_is_repeatable(spark):
    df = series(spark, [float(i) for i in range(50)])
    a, b = (column(datasets.augment_noise(df.repartition(n), ["x"], seed=9, chance=1.0), "x") for n in (1, 5))
    assert a == b and a != column(df, "x")


def test_negative_axis_blocks(spark):
    got = spark.createDataFrame([(v,) for v in (-8, -7, -1, 0, 6, 7)], "v bigint").select(blocks.int_div("v", 7)).collect()
    assert [r[0] for r in got] == [-2, -1, -1, 0, 0, 1]


def test_density_counts_both_ends_and_repeated_times(spark):
    times = [0, 0, 3, 10, 13, 14, 30]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "video_id int, frame_idx bigint, t bigint")
    got = windows.density(df, "t", 10)
    want = [sum(abs(a - b) <= 10 for b in times) for a in times]
    assert column(got, "neighbours") == want
    assert column(got, "density") == pytest.approx([w / max(want) for w in want])


@pytest.mark.parametrize("factor", [0.8, 1.0, 1.25])
def test_warp_repeats_the_last_row(spark, factor):
    done = datasets.augment_warp(series(spark, [float(i) for i in range(20)]), factor)
    assert column(done, "x") == [float(int(min(i * factor, 19))) for i in range(20)]


def test_one_constant_video_does_not_end_the_threshold_search(spark):
    scores = spark.createDataFrame([(1, i, 0.5) for i in range(50)] + [(2, i, i / 50) for i in range(50)], "video_id int, frame_idx bigint, score double")
    got = {r.video_id: r.threshold for r in selection.search_threshold(scores, "score", target=2.0).collect()}
    assert got[1] == 0.5 and 0 < got[2] < 1


def test_metrics_of_nothing_are_null(spark):
    clips = spark.createDataFrame([(1, 0, 30, 3.0)], "video_id int, start_frame bigint, end_frame bigint, seconds double")
    one = clips.select("video_id")
    for pred, truth in ((clips.where("false"), clips), (clips, clips.where("false"))):
        assert metrics.duration_kl(pred, truth, "seconds").first()[0] is None
        row = metrics.clip_metrics(pred, truth, one).first()
        assert (row.avg_pred_clip_seconds is None) != (row.avg_true_clip_seconds is None)


def test_models_of_no_quality_weigh_alike(spark):
    quality = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model string, f1 double")
    assert [r.weight for r in ensemble.model_weights(quality, "model", "f1").collect()] == [0.5, 0.5]


def test_nan_lasts_in_exponential_smoothing(spark):
    rows = [(1, i, float("nan") if i == 10 else 1.0) for i in range(2000)]
    got = column(smoothing.exponential(spark.createDataFrame(rows, "video_id int, frame_idx bigint, x double"), "x"), "smoothed", "frame_idx")
    assert got[:10] == pytest.approx([1.0] * 10) and all(v != v for v in got[10:])


def test_assets_beyond_nine_keep_their_number(spark):
    rows = [(1, i, 0, 0.9, a) for i, a in enumerate([12, 12, 14, 12, 15])]
    frames = spark.createDataFrame(rows, "video_id int, frame_idx bigint, track int, prob double, asset_id int")
    assert selection.track_segments(frames, "prob", 0.5, (), "asset_id").first().asset_id == 12


def test_a_track_outside_the_grid_is_an_error(spark):
    clips = spark.createDataFrame([(1, 0, 21, 0, 5, 1.0)], "video_id int, ord int, track int, start_frame bigint, end_frame bigint, scale double")
    totals = spark.createDataFrame([(1, 16)], "video_id int, steps int")
    with pytest.raises(Exception, match="track outside the grid: 21"):
        align.clips_to_frames(clips, totals, "steps", ["scale"], "ord", tracks=20).collect()
    assert align.clips_to_frames(clips, totals, "steps", ["scale"], "ord", tracks=22).where("active = 1").count() == 5


def test_alignment_on_seconds(spark):
    """Six targets, four audio rows, as in a feature table of 0.1 s."""
    targets = spark.createDataFrame([("a", t / 10) for t in range(6)], "video_id string, time double")
    audio = spark.createDataFrame([("a", 0.0, 1.0, 0), ("a", 0.2, 3.0, 1), ("a", 0.2, 5.0, 2), ("a", 0.4, 7.0, 3)], "video_id string, time double, v double, place int")
    done = align.interp_linear(targets, audio, ["v"], 0.05, 0.25, tie="place")
    assert column(done, "v_interp", "time") == pytest.approx([1.0, 2.0, 5.0, 6.0, 7.0, 7.0])
    for parts in (1, 4):
        assert column(align.asof_ffill(targets, audio.repartition(parts), ["v"], 0.25, tie="place"), "v_asof", "time") == [1.0, 1.0, 5.0, 5.0, 7.0, 7.0]


def test_rows_of_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (1, 0, 3.0)], "video_id int, frame_idx bigint, x double")
    got = blocks.two_phase(blocks.with_block(df, "frame_idx"), "video_id", "frame_idx", running={"s": ("sum", F.col("x"))})
    assert sorted(r.s for r in got.collect()) == [1.0, 3.0, 3.0]

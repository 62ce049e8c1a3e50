"""Issue lists and status of the validation reports."""

from framewise.operators import quality


def features(spark, rows):
    return spark.createDataFrame(rows, "video_id int, frame_idx bigint, time double, energy double")


def test_issues_of_a_modality(spark):
    df = features(spark, [
        (1, 0, 0.0, 1.0), (1, 1, 0.1, 1.0), (2, 0, 0.0, float("nan")), (2, 1, 5.0, 1.0), (3, 0, 1.0, None), (3, 1, 0.5, 1.0),
    ])
    got = {(r.video_id, r.issue) for r in quality.find_issues(df, "audio", ["time", "energy"]).collect()}
    assert got == {
        (2, "audio gaps in time"), (2, "audio values missing"), (3, "audio timestamps out of order"), (3, "audio values missing"),
    }
    missing = quality.find_issues(df, "audio", ["time", "pitch"]).collect()
    assert {(r.video_id, r.issue) for r in missing} == {(v, "audio columns missing: pitch") for v in (1, 2, 3)}


def test_status(spark):
    videos = spark.createDataFrame([(1,), (2,), (3,), (4,)], "video_id int")
    stats = spark.createDataFrame(
        [(v, m, 60.0 if v == 2 else 1.0, 0.5) for v in (1, 2, 3, 4) for m in ("audio", "visual")],
        "video_id int, modality string, interpolated_pct double, max_gap double",
    )
    findings = spark.createDataFrame([(4, "audio gaps in time")], "video_id int, issue string")
    report = quality.validate_videos(videos, videos, videos.where("video_id <> 3"), stats, findings)
    got = {r.video_id: (r.status, list(r.issues)) for r in report.collect()}
    assert got[1] == ("success", [])
    assert got[2] == ("issues_found", ["audio high interpolation", "visual high interpolation"])
    assert got[3] == ("missing_features", ["visual features not found"])
    assert got[4] == ("issues_found", ["audio gaps in time"])
    summary = quality.validation_summary(report).first()
    assert (summary.videos, summary.successful, summary.videos_with_issues, summary.videos_with_high_interpolation) == (4, 1, 3, 1)


def test_missing_label_columns_are_an_error(spark):
    f = spark.createDataFrame([(1, 0.0), (1, 0.1)], "video_id int, time double")
    labels = spark.createDataFrame([(1, 0.0, 0)], "video_id int, time double, track int")
    assert quality.integrity(f, labels).first().status == "ERROR"

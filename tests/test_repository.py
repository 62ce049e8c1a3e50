"""Rules of the code base that a reader would otherwise have to check by eye."""

import pathlib
import re

from tests.conftest import SF

ROOT = pathlib.Path(__file__).resolve().parent.parent
SOURCES = [p for d in ("framewise", "catalog") for p in (ROOT / d).rglob("*.py") if "llm" not in p.parts]


def test_no_collect_to_the_driver_in_the_library():
    for path in SOURCES:
        text = path.read_text()
        assert not re.search(r"\.(collect|toPandas|toLocalIterator)\(\)", text), path
        assert "localCheckpoint" not in text and "crossJoin" not in text and ".rdd" not in text, path


def test_no_broadcast_hints():
    assert not [p.name for p in SOURCES if "F.broadcast(" in p.read_text()]


def test_no_row_at_a_time_udfs():
    for path in SOURCES:
        assert not re.search(r"@?F?\.?\budf\(", path.read_text()), path


def test_filters_and_columns_reach_the_scan(spark):
    from catalog.adapters import frames

    df = frames(spark, SF).groupBy("video_id").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for scan in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "value" not in scan and "event_type" not in scan
    narrow = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey > 100").select("l_quantity")
    assert "GreaterThan(l_orderkey,100)" in narrow._jdf.queryExecution().executedPlan().toString()


def test_no_unkeyed_joins_in_registered_plans(spark):
    import __spark_entry__ as entry

    names = ["overlap_report", "interval_concat", "clips_to_frames", "threshold_grid", "threshold_bisect", "nearest_centroid",
             "strategy_compare", "standard_scale", "clip_stat_params", "duration_kl", "asset_balance"]
    for name in names:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

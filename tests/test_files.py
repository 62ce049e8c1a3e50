"""Reading and writing files: names, missing numbers, XML corner cases, incremental runs."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framewise.sources import projects, tables
from framewise.streaming import incremental

SCHEMA = StructType([StructField(c, DoubleType()) for c in ("time", "energy")])


def test_features_are_keyed_by_file_stem(spark, tmp_path):
    (tmp_path / "my video+1_features.csv").write_text("time,energy\n0.0,1.5\n0.1,NaN\n0.2,nan\n0.3,\n")
    (tmp_path / "other_features.csv").write_text("time,energy\n0.0,2\n")
    (tmp_path / "notes.csv").write_text("time,energy\n9,9\n")
    got = tables.read_features(spark, str(tmp_path), SCHEMA)
    assert sorted({r.video_id for r in got.collect()}) == ["my video+1", "other"]
    mine = [r.energy for r in got.where("video_id like 'my%'").orderBy("time").collect()]
    assert mine == [1.5, None, None, None]


def test_manifest_and_incremental_listing(spark, tmp_path):
    for name in ("a", "b", "c d"):
        (tmp_path / f"{name}_tracks.csv").write_text("x\n")
    listed = tables.list_inputs(spark, str(tmp_path), "_tracks.csv")
    done = spark.createDataFrame([("a",)], "video_id string")
    assert sorted(r.video_id for r in tables.skip_processed(listed, done).collect()) == ["b", "c d"]


def test_partitioned_csv_round_trip(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 3).alias("video_id"), F.col("id").alias("frame_idx"), (F.col("id") / 2).alias("time"))
    tables.write_partitioned_csv(df, str(tmp_path / "t"))
    back = tables.read_features(spark, str(tmp_path / "t"), StructType([StructField("frame_idx", DoubleType()), StructField("time", DoubleType())]))
    assert back.count() == 50 and back.agg(F.sum("time")).first()[0] == 612.5


XMEML = """<?xml version="1.0"?>
<!DOCTYPE xmeml>
<xmeml version="4"><project><children><sequence id="a"><duration>300</duration><rate><timebase>30</timebase></rate><media><video>
<track><clipitem id="1"><name>x.png</name><start>0</start><end>30</end><in>5</in><out>35</out>
<filter><effect><name>Basic Motion</name>
<parameter><parameterid>scale</parameterid><name>Scale</name><value>150</value></parameter>
<parameter><parameterid>scale</parameterid><name>Scale</name><value>oops</value></parameter>
<parameter><parameterid>rotation</parameterid><name>Rotation</name><value>12.5</value></parameter>
<parameter><parameterid>centerOffset</parameterid><name>Anchor Point</name><value><horiz>0.1</horiz><vert>0.2</vert></value></parameter>
<parameter><parameterid>left</parameterid><name>Left</name><keyframe><when>0</when><value>1</value></keyframe><keyframe><when>bad</when><value>2</value></keyframe></parameter>
</effect></filter></clipitem></track>
<track><clipitem id="2"><enabled>FALSE</enabled><end>60</end>
<filter><effect><name>Hello</name><effectcategory>graphic</effectcategory></effect></filter></clipitem></track>
</video></media></sequence></children></project></xmeml>"""


def test_xmeml_defaults_and_last_parsable_value(spark):
    df = spark.createDataFrame([("p", XMEML)], "xml_id string, xml string")
    a, b = projects.clip_params(projects.parse_xmeml(df)).orderBy("track_index").collect()
    assert (a.scale, a.rotation, a.anchor_x, a.anchor_y, a.pos_x, a.crop_l) == (1.5, 12.5, 0.1, 0.2, 0.0, 0.0)
    assert (a.start_time, a.end_time, a.source_start, a.source_duration, a.enabled) == (0.0, 1.0, 5 / 30, 1.0, True)
    assert (b.clip_name, b.start_frame, b.end_frame, b.enabled, b.media_type, b.scale) == ("clip_1", 0, 60, False, "graphic", 1.0)
    assert a.has_keyframes and not b.has_keyframes
    keys = projects.clip_keyframes(projects.parse_xmeml(df), ["clip_id"]).collect()
    assert [(k.clip_id, k.param, k.when, k.value) for k in keys] == [("1", "left", 0, 1.0)]


def test_nothing_is_lost_in_projects(spark):
    nested = XMEML.replace("</clipitem></track>\n<track>", "<sequence id='in'><rate><timebase>0</timebase></rate><media><video><track><clipitem id='9'><start>0</start><end>30</end></clipitem></track></video></media></sequence></clipitem></track>\n<track>", 1)
    tracks = "".join(f"<track><clipitem id='{i}'/></track>" for i in range(30))
    wide = f"<xmeml><sequence><media><video>{tracks}</video></media></sequence></xmeml>"
    df = spark.createDataFrame([("nested", nested), ("wide", wide), ("broken", nested[:-9]), ("text", "not xml"), ("none", None)], "xml_id string, xml string")
    got = projects.parse_xmeml(df).collect()
    assert sorted(r.clip_id for r in got if r.xml_id == "nested") == ["1", "2", "9", "9"]
    assert sorted((r.sequence, r.end_time) for r in got if r.clip_id == "9" and r.xml_id == "nested") == [(0, 1.0), (1, 1.0)]
    assert len([r for r in got if r.xml_id == "wide"]) == 30 and {r.xml_id for r in got} == {"nested", "wide"}
    errors = {r.xml_id: r.error for r in projects.project_errors(df).collect()}
    assert {k for k, v in errors.items() if v} == {"broken", "text", "none"}


def test_connected_clips_and_long_spines(spark):
    spine = "".join(f'<clip name="c{i}"/>' for i in range(50)) + '<clip name="a"><clip name="b"><clip name="c"/></clip></clip>'
    df = spark.createDataFrame([("p", f"<fcpxml><project><sequence><gap><spine>{spine}</spine></gap></sequence></project></fcpxml>")], "xml_id string, xml string")
    got = projects.parse_fcpxml(df).orderBy("track_index").collect()
    assert [r.clip_name for r in got] == [*(f"c{i}" for i in range(50)), "a", "b", "c"]


def test_captions_need_both_times(spark):
    df = spark.createDataFrame([("p", XMEML), ("q", XMEML.replace("<end>60</end>", "<start>30</start><end>60</end>"))], "xml_id string, xml string")
    got = projects.extract_captions(df).collect()
    assert [(r.xml_id, r.text, r.start, r.end) for r in got] == [("q", "Hello", 1.0, 2.0)]


def test_lane_clips_follow_again_and_tracks_are_capped(spark):
    clip = '<clip name="{}" offset="1/2s" duration="3s"/>'
    spine = "".join(clip.format(i) for i in range(3)) + "<lane>" + clip.format("l") + "</lane>"
    xml = f"<fcpxml><project><sequence><spine>{spine}</spine></sequence></project></fcpxml>"
    df = spark.createDataFrame([("p", xml)], "xml_id string, xml string")
    got = projects.parse_fcpxml(df).orderBy("track_index").collect()
    assert [r.clip_name for r in got] == ["0", "1", "2", "l", "l"]
    assert (got[0].start_time, got[0].end_time) == (0.5, 3.5)
    assert projects.parse_fcpxml(df, max_tracks=2).count() == 2


def test_dispatch_by_root(spark):
    fcpx = '<fcpxml><sequence><spine><clip name="c" offset="0s" duration="1s"/></spine></sequence></fcpxml>'
    df = spark.createDataFrame([("a", XMEML), ("b", fcpx), ("c", fcpx.replace("fcpxml", "other"))], "xml_id string, xml string")
    got = {(r.xml_id, r.format) for r in projects.parse_project(df).collect()}
    assert got == {("a", "xmeml"), ("b", "fcpxml"), ("c", "fcpxml")}


def test_written_timeline_reads_back(spark, tmp_path):
    clips = spark.createDataFrame([(1, 30, 60), (1, 0, 10), (2, 5, 6)], "video_id int, start_frame bigint, end_frame bigint")
    projects.write_timeline(projects.export_timeline(clips, 30.0), str(tmp_path / "x"))
    lines = spark.read.text(str(tmp_path / "x"))
    docs = {}
    for part in sorted((tmp_path / "x" / "video_id=1").glob("part-*.txt")):
        docs.setdefault(1, []).append(part.read_text())
    df = spark.createDataFrame([("1", "".join(docs[1]))], "xml_id string, xml string")
    got = projects.parse_xmeml(df).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame, r.in_frame, r.out_frame) for r in got] == [(0, 30, 0, 30), (30, 120, 90, 180)]
    assert lines.count() == 3 + 4


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "video_id int, x double"

    def run():
        incremental.process_new_files(
            spark, src, spark.createDataFrame([], schema).schema, lambda d: d.withColumn("y", F.col("x") * 2), out, ckpt
        )

    spark.createDataFrame([(1, 1.0)], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(2, 2.0)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.video_id, r.y) for r in spark.read.parquet(out).collect()) == [(1, 2.0), (2, 4.0)]


def test_stream_batches_reach_table_operators(spark, tmp_path):
    from framewise.operators import intervals

    src, ckpt, seen = str(tmp_path / "in"), str(tmp_path / "ckpt"), []
    schema = "video_id int, frame_idx bigint, on_ int"
    spark.createDataFrame([(1, i, int(i % 4 < 2)) for i in range(12)], schema).write.parquet(src)

    def handle(batch, _):
        seen.extend((r.start_frame, r.end_frame) for r in intervals.extract_clips(batch, "on_").collect())

    incremental.process_new_batches(spark, src, spark.createDataFrame([], schema).schema, handle, ckpt)
    assert sorted(seen) == [(0, 2), (4, 6), (8, 10)]



def test_a_task_holds_few_texts_at_once(spark, monkeypatch):
    """The memory of a worker while it parses, given as the id of a clip."""

    def megabytes(sequence) -> str:
        with open("/proc/self/statm") as held:
            used = int(held.read().split()[1]) // 256
        return f"<sequence><name>{sequence.findtext('name')}</name><media><video><track><clipitem id='{used}'/></track></video></media></sequence>"

    monkeypatch.setattr(projects, "_flat_xmeml", megabytes)

    def most(texts: int) -> int:
        filler = F.concat(F.repeat(F.lit("-. "), 33_000), F.col("id").cast("string"))
        docs = spark.range(0, texts, 1, 1).select(F.col("id").alias("xml_id"), F.concat(F.lit("<xmeml><sequence><name>"), filler, F.lit("</name></sequence></xmeml>")).alias("xml"))
        return projects.parse_xmeml(docs).agg(F.count(F.lit(1)), F.max(F.col("clip_id").cast("int"))).first()

    (few, small), (many, large) = most(20), most(2500)
    assert (few, many) == (20, 2500) and large - small < 150


def test_results_of_many_lots_keep_their_keys(spark, monkeypatch):
    monkeypatch.setattr(projects, "LOT", 300)
    two = "".join(f"<sequence><media><video><track><clipitem id='{{0}}-{i}'/></track></video></media></sequence>" for i in range(2))
    rows = [(None if i == 7 else i, None if i % 5 == 0 else "bad" if i % 5 == 1 else f"<xmeml>{two.format(i)}</xmeml>") for i in range(40)]
    df = spark.createDataFrame(rows, "xml_id int, xml string").coalesce(1)
    got = sorted((r.clip_id, r.xml_id, r.sequence) for r in projects.parse_xmeml(df).collect())
    assert got == sorted((f"{i}-{n}", None if i == 7 else i, n) for i in range(40) if i % 5 > 1 for n in range(2))
    errors = projects.project_errors(df).collect()
    assert len(errors) == 40 and sum(r.error is None for r in errors) == 24

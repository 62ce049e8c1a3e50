"""Sources and sinks: CSV tables, manifests, XML projects, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from catalog.adapters import CLIPS, FRAMES, LONG, clips, frames, long_frames
from catalog.datasets import PAD_STARTS
from catalog.intervals import TRACKS, merge_sql, runs_sql, tracks
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import KEYS
from framewise.functions import vectors as V
from framewise.operators import align as A
from framewise.operators import datasets as D
from framewise.operators import intervals as I
from framewise.operators import quality as Q
from framewise.session import scratch_path
from framewise.sources import projects as P
from framewise.sources import tables as T

FEATURE_SCHEMA = StructType([StructField(c, DoubleType()) for c in ("time", "energy", "motion")])


@query(
    "scan_features",
    f"WITH {LONG} SELECT video_id, {q6('frame_idx/10.0::double', 'time')}, {q6('energy')}, {q6('CASE WHEN k % 13 = 0 THEN NULL ELSE motion END', 'motion')} FROM frames",
)
def scan_features(spark, sf):
    k = F.col("k")
    gaps = F.when(k % 26 == 0, None).when(k % 13 == 0, float("nan")).otherwise(F.col("motion"))
    f = long_frames(spark, sf).select(*KEYS.split(), (F.col("frame_idx") / 10.0).alias("time"), "energy", gaps.alias("motion"))
    path = scratch_path(spark, "features")
    # Files keep the columns of the schema; the position only orders the writing.
    T.write_partitioned_csv(f.select("video_id", "time", "energy", "motion", "frame_idx"), path)
    read = T.read_features(spark, path, StructType([*FEATURE_SCHEMA.fields, StructField("frame_idx", IntegerType())]))
    return out(read, "", "video_id", "time energy motion")


TRACK_SCHEMA = StructType(
    [StructField("time", DoubleType()), StructField("track", IntegerType()), StructField("active", IntegerType()), StructField("scale", DoubleType())]
)


@query("scan_tracks", f"WITH {LONG}, {TRACKS} SELECT video_id, {q6('frame_idx/10.0::double', 'time')}, {big('track')}, {big('active')}, {q6('scale')} FROM tracks")
def scan_tracks(spark, sf):
    t = tracks(long_frames(spark, sf)).select("video_id", "frame_idx", (F.col("frame_idx") / 10.0).alias("time"), "track", "active", "scale")
    path = scratch_path(spark, "tracks")
    T.write_partitioned_csv(t.select("video_id", "time", "track", "active", "scale", "frame_idx"), path)
    read = T.read_tracks(spark, path, StructType([*TRACK_SCHEMA.fields, StructField("frame_idx", IntegerType())]))
    return out(read, "", "video_id track active", "time scale")


@query(
    "sink_csv_tracks",
    f"""WITH {CLIPS}, cells AS (SELECT f.video_id, f.frame_idx, t.track FROM frames f, range(5) t(track))
    SELECT f.video_id, {big('f.frame_idx', 'frame_idx')}, {big('f.track', 'track')}, arg_min(c.name, c.ord) AS clip_name FROM cells f
    LEFT JOIN clips c ON c.video_id = f.video_id AND c.track = f.track AND c.start_frame <= f.frame_idx AND f.frame_idx < c.end_frame GROUP BY f.video_id, f.frame_idx, f.track""",
)
def sink_csv_tracks(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_idx", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("track"))
    named = A.frame_clip_attrs(f, clips(spark, sf), ["name"], "ord").withColumnRenamed("name", "clip_name")
    path = scratch_path(spark, "tracks")
    T.write_partitioned_csv(named.withColumn("block", F.pmod("video_id", F.lit(10))), path, key="block")
    read = spark.read.schema("video_id bigint, frame_idx bigint, track int, clip_name string, block int").option("header", "true").csv(path)
    return out(read, "clip_name", "video_id frame_idx track")


@query(
    "sink_sequences",
    f"""WITH {LONG}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), st AS ({PAD_STARTS.format(length=100, step=70)}),
    r AS (SELECT video_id, row_number() OVER (ORDER BY md5('7:' || video_id)) - 1 AS i, count(*) OVER () AS n FROM v)
    SELECT st.video_id, {big('window_index')}, CASE WHEN i < floor(r.n * 0.8::double) THEN 'train' ELSE 'val' END AS split, {q6('sum(f.k)', 'total')}
    FROM st JOIN r USING (video_id) JOIN frames f ON f.video_id = st.video_id AND f.frame_idx >= window_start AND f.frame_idx < window_start + 100 GROUP BY ALL""",
)
def sink_sequences(spark, sf):
    cut = D.windows(long_frames(spark, sf), ["k"], 100, 30, "pad")
    marked = D.group_split(cut, seed=7, spread="window_index")
    path = scratch_path(spark, "sequences")
    T.write_dataset(marked, path)
    read = spark.read.parquet(path)
    total = V.total(F.transform("values", lambda r: r[0]))
    return out(read.select("video_id", "window_index", "split", total.alias("total")), "video_id split", "window_index", "total")


MANIFESTS = f"{FRAMES}, a AS (SELECT DISTINCT video_id, 'tracks/' || video_id AS tracks_path FROM frames WHERE video_id % 7 <> 0), b AS (SELECT DISTINCT video_id, 'features/' || video_id AS features_path FROM frames WHERE video_id % 5 <> 0)"


def manifests(spark, sf):
    v = frames(spark, sf).select("video_id").distinct()
    text = F.col("video_id").cast("string")
    a = v.where(F.pmod("video_id", F.lit(7)) != 0).withColumn("tracks_path", F.concat(F.lit("tracks/"), text))
    b = v.where(F.pmod("video_id", F.lit(5)) != 0).withColumn("features_path", F.concat(F.lit("features/"), text))
    return a, b


@query("manifest_join", f"WITH {MANIFESTS} SELECT a.video_id, tracks_path, features_path FROM a LEFT JOIN b USING (video_id)")
def manifest_join(spark, sf):
    pairs, missing = T.manifest_join(*manifests(spark, sf))
    return pairs.unionByName(missing, allowMissingColumns=True).select("video_id", "tracks_path", "features_path")


@query("skip_processed", f"WITH {MANIFESTS} SELECT video_id, tracks_path FROM a WHERE video_id NOT IN (SELECT video_id FROM b)")
def skip_processed(spark, sf):
    source, done = manifests(spark, sf)
    return T.skip_processed(source, done).select("video_id", "tracks_path")


# --- XML projects: one document per video and stretch of 64 frames, five tracks ----------------

STRETCH = 64


def _tag(name: str, value):
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


def xml_id():
    return F.concat_ws("_", F.col("video_id"), F.floor(F.col("start_frame") / STRETCH))


def projects(spark, sf):
    """The clips of ``clips`` written as XMEML documents."""
    c = clips(spark, sf).withColumn("xml_id", xml_id())

    def parameter(ident: str, name: str, value):
        return F.concat(F.lit(f"<parameter><parameterid>{ident}</parameterid><name>{name}</name>"), value, F.lit("</parameter>"))

    def key_at(when, value):
        return F.concat(F.lit("<keyframe>"), _tag("when", when), _tag("value", value), F.lit("</keyframe>"))

    pair = F.concat(F.lit("<value>"), _tag("horiz", F.col("score")), _tag("vert", F.lit("bad")), F.lit("</value>"))
    caption = F.when(
        F.pmod("ord", F.lit(4)) == 0,
        F.concat(F.lit("<filter><effect>"), _tag("name", F.concat(F.lit(" cap "), F.col("ord").cast("string"), F.lit(" "))), F.lit("<effectcategory>graphic</effectcategory></effect></filter>")),
    ).otherwise("")
    url = F.concat(F.lit("file://localhost/C%3A/raw%20video/a+b%26&amp;/"), F.col("name"))
    item = F.concat(
        F.lit('<clipitem id="'), F.col("ord").cast("string"), F.lit('">'), _tag("name", F.col("name")),
        _tag("enabled", F.when(F.col("enabled"), "TRUE").otherwise("FALSE")),
        _tag("start", F.col("start_frame")), _tag("end", F.col("end_frame")), _tag("in", F.col("in_frame")), _tag("out", F.col("out_frame")),
        F.lit("<file>"), _tag("pathurl", url), F.lit("</file><filter><effect><name>Basic Motion</name><effectcategory>motion</effectcategory>"),
        parameter("scale", "Scale", _tag("value", F.lit("7"))), parameter("scale", "Scale", _tag("value", F.col("scale"))),
        parameter("center", "Center", pair), parameter("leftcrop", "Crop", _tag("value", F.col("track"))),
        parameter("opacity", "Opacity", F.concat(key_at(F.lit(0), F.col("scale")), key_at(F.col("end_frame") - F.col("start_frame"), F.col("score")))),
        F.lit("</effect></filter>"), caption, F.lit("</clipitem>"),
    )
    packed = c.groupBy("xml_id").agg(F.array_sort(F.collect_list(F.struct("track", "ord", item.alias("x")))).alias("items"))
    per_track = [
        F.concat(F.lit("<track>"), F.array_join(F.transform(F.filter("items", lambda i: i["track"] == n), lambda i: i["x"]), ""), F.lit("</track>"))
        for n in range(5)
    ]
    doc = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE xmeml><xmeml version="4"><project><sequence id="s"><name>s</name><duration>100</duration><rate><timebase>25</timebase></rate><media><video>'),
        *per_track, F.lit("</video></media></sequence></project></xmeml>"),
    )
    return packed.select("xml_id", doc.alias("xml"))


XML_CLIPS = f"{CLIPS}, x AS (SELECT *, video_id || '_' || (start_frame // {STRETCH}) AS xml_id FROM clips)"


@query(
    "xml_clips",
    f"""WITH {XML_CLIPS} SELECT xml_id, {big('ord')}, {big('track', 'track_index')}, name AS clip_name, enabled, {q6('start_frame/25.0::double', 'start_time')}, {q6('end_frame/25.0::double', 'end_time')},
    {q6('in_frame/25.0::double', 'source_start')}, {q6('(out_frame - in_frame)/25.0::double', 'source_duration')}, CASE WHEN ord % 4 = 0 THEN 'graphic' ELSE 'video' END AS media_type FROM x""",
)
def xml_clips(spark, sf):
    parsed = P.parse_xmeml(projects(spark, sf)).withColumn("ord", F.col("clip_id"))
    return out(parsed, "xml_id clip_name enabled media_type", "ord track_index", "start_time end_time source_start source_duration")


@query(
    "xml_effect_params",
    f"WITH {XML_CLIPS} SELECT xml_id, {big('ord')}, {q6('scale/100', 'scale')}, {q6('score', 'pos_x')}, {q6('0', 'pos_y')}, {q6('track', 'crop_l')}, {q6('0', 'crop_r')}, {q6('0', 'rotation')} FROM x",
)
def xml_effect_params(spark, sf):
    parsed = P.clip_params(P.parse_xmeml(projects(spark, sf))).withColumn("ord", F.col("clip_id"))
    return out(parsed, "xml_id", "ord", "scale pos_x pos_y crop_l crop_r rotation")


@query(
    "xml_keyframe_values",
    f"""WITH {XML_CLIPS}, f AS (SELECT *, unnest(range(0, end_frame - start_frame)) AS w FROM x)
    SELECT xml_id, {big('ord')}, {big('w', 'frame')}, {q6('scale + (score - scale) * (w / (end_frame - start_frame))', 'value')} FROM f""",
)
def xml_keyframe_values(spark, sf):
    """Keyframes of project files as a value per frame of their clip."""
    parsed, keys = P.parse_xmeml(projects(spark, sf)), ["xml_id", "clip_id"]
    spans = parsed.select(*keys, (F.col("end_frame") - F.col("start_frame")).alias("length"), F.lit(None).cast("double").alias("fixed"))
    keyed = P.clip_keyframes(parsed, keys).where("param = 'opacity'")
    done = A.keyframe_values(spans, keyed, "length", "fixed", 100.0, keys)
    return out(done.withColumnsRenamed({"clip_id": "ord", "when": "frame"}), "xml_id", "ord frame", "value")


@query(
    "xml_telops",
    f"WITH {XML_CLIPS} SELECT xml_id, 'cap ' || ord AS text, {q6('start_frame/25.0::double', 'start')}, {q6('end_frame/25.0::double', 'end')}, {q6('(end_frame - start_frame)/25.0::double', 'duration')} FROM x WHERE ord % 4 = 0".replace("AS end,", 'AS "end",'),
)
def xml_telops(spark, sf):
    return out(P.extract_captions(projects(spark, sf)), "xml_id text", floats="start end duration")


@query(
    "source_paths",
    f"""WITH {XML_CLIPS} SELECT DISTINCT xml_id, 'C:\\raw video\\a+b&&\\' || name AS source_video_path, replace(name, '.mp4', '') AS source_video_name,
    'features/' || replace(name, '.mp4', '') || '_features.csv' AS features_path FROM x""",
)
def source_paths(spark, sf):
    return P.source_mapping(projects(spark, sf)).select("xml_id", "source_video_path", "source_video_name", "features_path")


# Frames per spine: enough for more than twenty clips.
SPINE = 256


def modern_projects(spark, sf):
    """The same clips as FCPXML documents, one spine per video and stretch; every third clip hangs on the one before."""
    c = clips(spark, sf)
    group = F.concat_ws("_", "video_id", F.floor(F.col("start_frame") / SPINE))
    clip = F.concat(
        F.lit('<clip name="'), F.col("name"), F.lit('" ref="r'), F.col("track").cast("string"), F.lit('" offset="'), F.col("start_frame").cast("string"), F.lit('/25s" duration="'),
        (F.col("end_frame") - F.col("start_frame")).cast("string"), F.lit('/25s" start="'), F.col("in_frame").cast("string"),
        F.lit('/25s" enabled="'), F.col("enabled").cast("int").cast("string"), F.lit('"><video><param name="Scale" value="'), F.col("scale").cast("string"), F.lit('"/></video><title name="t"><text>'), F.col("ord").cast("string"),
        F.lit('</text></title><param name="crop left" value="0.5"/>'),
    )
    packed = c.select(group.alias("xml_id"), "ord", clip.alias("x")).groupBy("xml_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x"))).alias("items"))
    inner = lambda i: F.pmod(i, F.lit(3)) == 2
    holds = lambda i: (F.pmod(i, F.lit(3)) == 1) & (i < F.size("items") - 1)
    body = F.array_join(F.transform("items", lambda c, i: F.concat(c["x"], F.when(holds(i), "").when(inner(i), "</clip></clip>").otherwise("</clip>"))), "")
    return packed.select("xml_id", F.concat(F.lit('<fcpxml version="1.9"><library><event><project><sequence><spine>'), body, F.lit("</spine></sequence></project></event></library></fcpxml>")).alias("xml"))


FCPX_SQL = f"""{CLIPS}, x AS (SELECT *, video_id || '_' || (start_frame // {SPINE}) AS xml_id FROM clips),
  m AS (SELECT *, row_number() OVER (PARTITION BY xml_id ORDER BY ord) - 1 AS track_index FROM x)"""
FCPX_COLUMNS = f"""xml_id, {big('track_index')}, enabled, name AS clip_name, 'r' || track AS clip_ref, {q6('start_frame/25.0::double', 'start_time')}, {q6('end_frame/25.0::double', 'end_time')},
    {q6('in_frame/25.0::double', 'source_start')}, 't | ' || ord AS graphics_text, {q6('scale')}, {q6('0.5', 'crop_l')}"""
FCPX_FLOATS = "start_time end_time source_start scale crop_l"


@query("xml_clips_fcpx", f"WITH {FCPX_SQL} SELECT {FCPX_COLUMNS} FROM m")
def xml_clips_fcpx(spark, sf):
    return out(P.parse_fcpxml(modern_projects(spark, sf)), "xml_id enabled clip_name clip_ref graphics_text", "track_index", FCPX_FLOATS)


@query(
    "xml_dispatch",
    f"""WITH {FCPX_SQL}, y AS (SELECT *, video_id || '_' || (start_frame // {STRETCH}) AS xid FROM clips)
    SELECT 'fcpxml' AS format, {FCPX_COLUMNS} FROM m
    UNION ALL SELECT 'xmeml', xid, track, enabled, name, '', {q6('start_frame/25.0::double', 'start_time')}, {q6('end_frame/25.0::double', 'end_time')}, {q6('in_frame/25.0::double', 'source_start')}, '', {q6('scale/100', 'scale')}, {q6('track', 'crop_l')} FROM y""",
)
def xml_dispatch(spark, sf):
    both = projects(spark, sf).unionByName(modern_projects(spark, sf))
    return out(P.parse_project(both), "format xml_id enabled clip_name clip_ref graphics_text", "track_index", FCPX_FLOATS)


RATE = "<rate><timebase>29</timebase><ntsc>TRUE</ntsc></rate>"


@query(
    "timeline_export",
    f"""WITH {LONG}, {runs_sql('active')}, {merge_sql('runs', 'merged', 1)}, c AS (SELECT video_id, start_frame, CAST(floor(start_frame * (29.97::double / 10.0::double)) AS BIGINT) AS i, CAST(floor(end_frame * (29.97::double / 10.0::double)) AS BIGINT) AS o FROM merged),
    t AS (SELECT *, row_number() OVER w AS p, CAST(sum(o - i) OVER w AS BIGINT) AS e FROM c WINDOW w AS (PARTITION BY video_id ORDER BY start_frame))
    SELECT video_id, {big('p', 'line')}, '<clipitem id="clipitem-' || p || '"><name>' || video_id || '</name><duration>' || (o - i) || '</duration>{RATE}<start>' || (e - o + i) || '</start><end>' || e || '</end><in>' || i || '</in><out>' || o ||
      '</out><file id="file-1"><pathurl>file://localhost/' || video_id || '.mp4</pathurl></file></clipitem>' AS xml FROM t
    UNION ALL SELECT video_id, 0, '<?xml version="1.0" encoding="UTF-8"?><xmeml version="4"><sequence id="sequence-1"><name>' || video_id || '</name><duration>' || max(e) || '</duration>{RATE}<media><video><track>' FROM t GROUP BY video_id
    UNION ALL SELECT video_id, max(p) + 1, '</track></video></media></sequence></xmeml>' FROM t GROUP BY video_id""",
)
def timeline_export(spark, sf):
    merged = I.merge_gaps(I.extract_clips(long_frames(spark, sf), "active"), 1)
    return out(P.export_timeline(merged, 29.97), "video_id xml", "line")


@query(
    "parse_report",
    f"""WITH {XML_CLIPS}, v AS (SELECT DISTINCT xml_id, video_id % 3 = 0 AS broken FROM x)
    SELECT {big('count(*)', 'total')}, {big('count(*) FILTER (WHERE NOT broken)', 'succeeded')}, {big('count(*) FILTER (WHERE broken)', 'failed')}, {q6('count(*) FILTER (WHERE NOT broken)/count(*)*100', 'success_pct')} FROM v""",
)
def parse_report(spark, sf):
    # The documents of every third video lose their end.
    video = F.split("xml_id", "_")[0].cast("bigint")
    cut = F.when(F.pmod(video, F.lit(3)) == 0, F.expr("left(xml, length(xml) - 9)")).otherwise(F.col("xml"))
    docs = projects(spark, sf).withColumn("xml", cut)
    return out(Q.batch_report(P.project_errors(docs), F.col("error").isNull()), "", "total succeeded failed", "success_pct")

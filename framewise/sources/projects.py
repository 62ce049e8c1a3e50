"""Edit projects: XML to clip rows, and selected clips back to XML lines.

A project is one row of text. A project is cut into its sequences, nested ones included, by an XML parser, one
text after the other; ``from_xml`` turns each into nested columns, and everything after that is array functions
and ``posexplode``. A text that is no XML gives no clips and a message from ``project_errors``.

A task holds one Arrow batch of texts (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB), one of them as text and
parsed, and a megabyte of what was found in them.
"""

from __future__ import annotations

import copy
import sys
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from framewise.functions import naming, times
from framewise.operators.windows import KEY
from framewise.plans import blocks

# Task functions travel inside the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VALUE = "struct<_VALUE:string,horiz:string,vert:string>"
_KEYFRAME = "struct<`when`:string,value:string>"
_PARAMETER = f"struct<parameterid:string,name:string,value:{_VALUE},keyframe:array<{_KEYFRAME}>>"
_EFFECT = f"struct<name:string,effectid:string,effectcategory:string,parameter:array<{_PARAMETER}>>"
_FILE = "struct<_id:string,name:string,pathurl:string,duration:string,mediaSource:string>"
_CLIPITEM = (
    "struct<_id:string,name:string,enabled:string,start:string,end:string,`in`:string,`out`:string,"
    f"file:{_FILE},mediaSource:string,filter:array<struct<effect:array<{_EFFECT}>>>>"
)
XMEML_SEQUENCE = (
    "name string, duration string, rate struct<timebase:string,ntsc:string>, "
    f"media struct<video:struct<track:array<struct<clipitem:array<{_CLIPITEM}>>>>>"
)

_PARAM = "struct<_name:string,_value:string>"
_CLIP = (
    "struct<_name:string,_ref:string,_offset:string,_duration:string,_start:string,_enabled:string,"
    f"param:array<{_PARAM}>,video:array<struct<param:array<{_PARAM}>>>,"
    "title:array<struct<_name:string,text:array<string>>>>"
)
FCPX_SEQUENCE = f"spine array<struct<clip:array<{_CLIP}>>>"


def read_projects(spark: SparkSession, path: str, key: str = "xml_id") -> DataFrame:
    """One row per project file: its stem and text."""
    raw = spark.read.option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return raw.select(F.regexp_extract(name, r"^(.*)\.xml$", 1).alias(key), F.col("value").alias("xml"))


def _without(element: ET.Element, tag: str) -> ET.Element:
    """A copy without the elements of this name inside it."""
    kept = copy.deepcopy(element)
    for parent in list(kept.iter()):
        for child in parent.findall(tag):
            parent.remove(child)
    return kept


def _flat_xmeml(sequence: ET.Element) -> str:
    """One sequence with every clip item below a track, at any depth, directly in that track."""
    flat = ET.Element("sequence")
    for name in ("name", "duration"):
        if (found := sequence.find(name)) is not None:
            flat.append(found)
    if (base := sequence.find(".//rate/timebase")) is not None:
        ET.SubElement(flat, "rate").append(base)
    video = ET.SubElement(ET.SubElement(flat, "media"), "video")
    for track in sequence.findall("media/video/track"):
        ET.SubElement(video, "track").extend(_without(item, "sequence") for item in track.iter("clipitem"))
    return ET.tostring(flat, encoding="unicode")


def _flat_fcpxml(sequence: ET.Element) -> str:
    """One sequence with every clip below a spine, at any depth, directly in it; those of lanes follow again."""
    flat = ET.Element("sequence")
    for spine in sequence.iter("spine"):
        clips = [*spine.iter("clip"), *(clip for lane in spine.iter("lane") for clip in lane.iter("clip"))]
        ET.SubElement(flat, "spine").extend(_without(clip, "clip") for clip in clips)
    return ET.tostring(flat, encoding="unicode")


def _read(xml: str | None) -> tuple[ET.Element | None, str | None]:
    try:
        return (ET.fromstring(xml.strip().encode()) if xml is not None else None), None if xml is not None else "no text"
    except ET.ParseError as error:
        return None, str(error)


# Bytes of results that leave a task together.
LOT = 1 << 20


def _found(projects: DataFrame, key: str, read: Callable[[ET.Element | None, str | None], Iterable[str | None]], name: str) -> DataFrame:
    """``key, number, name``: the strings that ``read`` takes from the root, or the parser's message, of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, values, size = [], [], [], 0
            for row in range(batch.num_rows):
                for number, value in enumerate(read(*_read(batch.column(1)[row].as_py()))):
                    rows.append(row), numbers.append(number), values.append(value)
                    size += len(value or "")
                if rows and (size >= LOT or row == batch.num_rows - 1):
                    lot = [batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(values, pa.string())]
                    yield pa.RecordBatch.from_arrays(lot, names=[key, "number", name])
                    rows, numbers, values, size = [], [], [], 0

    schema = StructType([projects.schema[key], StructField("number", IntegerType()), StructField(name, StringType())])
    return projects.select(key, "xml").mapInArrow(find, schema)


def project_errors(projects: DataFrame, key: str = "xml_id") -> DataFrame:
    """``key, error``: why a project cannot be read; null if it can."""
    return _found(projects, key, lambda _, error: [error], "error").drop("number")


def _sequences(df: DataFrame, key: str, schema: str, flatten: Callable[[ET.Element], str]) -> DataFrame:
    """Sequences at any depth of the project, in document order."""

    def cut(root: ET.Element | None, _: str | None) -> Iterable[str]:
        return () if root is None else (flatten(s) for s in root.iter("sequence"))

    # Parsed inside the generator, so that each fragment is read once however many fields are used.
    read = F.transform(F.array("_cut"), lambda f: F.from_xml(f, schema))
    return _found(df, key, cut, "_cut").select(key, F.col("number").alias("sequence"), F.explode(read).alias("_s"))


def _or_empty(array: Column, like: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{like}>"))


def _whole(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def xmeml_clipitems(projects: DataFrame, key: str = "xml_id", max_tracks: int | None = None) -> DataFrame:
    """One row per clipitem: sequence, track ordinal, position in the track, timebase and the raw item.

    ``max_tracks`` leaves out the tracks after that many; by default none is left out.
    """
    seqs = _sequences(projects, key, XMEML_SEQUENCE, _flat_xmeml)
    read = F.trim(F.col("_s.rate.timebase")).try_cast("int")
    timebase = F.when(read > 0, read).otherwise(30)
    tracks = seqs.select(
        key, "sequence", timebase.alias("timebase"), F.col("_s.duration").alias("sequence_frames"),
        F.posexplode("_s.media.video.track").alias("track_index", "_t"),
    )
    tracks = tracks if max_tracks is None else tracks.where(F.col("track_index") < max_tracks)
    return tracks.select(
        key, "sequence", "timebase", "sequence_frames", "track_index", F.posexplode("_t.clipitem").alias("item", "clip")
    )


def parse_xmeml(projects: DataFrame, key: str = "xml_id", max_tracks: int | None = None) -> DataFrame:
    """Clips of XMEML projects with times in seconds and frames; missing numbers are 0."""
    c = F.col("clip")
    items = xmeml_clipitems(projects, key, max_tracks)
    frames = {n: _whole(c[n]) for n in ("start", "end", "in", "out")}
    base = F.col("timebase")
    effects = F.flatten(F.transform(_or_empty(c["filter"], f"struct<effect:array<{_EFFECT}>>"), lambda f: _or_empty(f["effect"], _EFFECT)))
    default_name = F.concat(F.lit("clip_"), F.col("track_index").cast("string"))
    return items.select(
        key, "sequence", "track_index", "item", c["_id"].alias("clip_id"),
        F.coalesce(F.when(c["name"] != "", c["name"]), default_name).alias("clip_name"),
        frames["start"].alias("start_frame"), frames["end"].alias("end_frame"),
        frames["in"].alias("in_frame"), frames["out"].alias("out_frame"),
        (frames["start"] / base).alias("start_time"), (frames["end"] / base).alias("end_time"),
        ((frames["end"] - frames["start"]) / base).alias("duration"),
        (frames["in"] / base).alias("source_start"), ((frames["out"] - frames["in"]) / base).alias("source_duration"),
        F.coalesce(c["enabled"] != "FALSE", F.lit(True)).alias("enabled"),
        F.lit("").alias("clip_ref"), F.lit("").alias("graphics_text"),
        naming.media_type(
            F.coalesce(c["mediaSource"], c["file"]["mediaSource"]), F.transform(effects, lambda e: e["effectcategory"]),
            c["file"]["pathurl"], F.trim(c["file"]["duration"]).try_cast("bigint"),
        ).alias("media_type"),
        effects.alias("effects"),
        F.exists(F.flatten(F.transform(effects, lambda e: _or_empty(e["parameter"], _PARAMETER))), lambda p: F.size(p["keyframe"]) > 0).alias("has_keyframes"),
    )


def _last(values: Column, default: float) -> Column:
    """The last value that parsed, else the default."""
    numbers = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(numbers) > 0, F.element_at(numbers, -1)).otherwise(default)


def clip_params(clips: DataFrame) -> DataFrame:
    """Scale, position, anchor, rotation and crop of parsed clips; the last matching parameter wins.

    A parameter is judged by its id or name, by the first rule that fits. Motion parameters count
    only inside a named effect.
    """

    def low(text: Column) -> Column:
        return F.lower(F.coalesce(text, F.lit("")))

    def reading(e: Column, p: Column) -> Column:
        ident, title = low(p["parameterid"]), low(p["name"])
        motion = (
            F.when((ident == "rotation") | (title == "rotation"), "rotation")
            .when((ident == "scale") | (title == "scale"), "scale")
            .when((ident == "center") | (title == "center"), "center")
            .when((ident == "centeroffset") | title.contains("anchor"), "anchor")
        )
        crop = F.when((ident == "leftcrop") | title.contains("left"), "left")
        for side in ("right", "top", "bottom"):
            crop = crop.when((ident == f"{side}crop") | title.contains(side), side)
        value = p["value"]
        return F.struct(
            F.when((e["name"] != "") & p["name"].isNotNull(), motion).alias("motion"),
            F.when(p["parameterid"].isNotNull(), crop).alias("crop"),
            value["_VALUE"].try_cast("double").alias("number"),
            value["horiz"].try_cast("double").alias("horiz"), value["vert"].try_cast("double").alias("vert"),
        )

    read = F.flatten(F.transform("effects", lambda e: F.transform(_or_empty(e["parameter"], _PARAMETER), lambda p: reading(e, p))))

    def pick(rule: str, kind: str, field: str) -> Column:
        return F.transform(F.filter("_read", lambda r: r[rule] == kind), lambda r: r[field])

    return clips.withColumn("_read", read).select(
        *clips.columns,
        (_last(pick("motion", "scale", "number"), 100.0) / 100).alias("scale"),
        _last(pick("motion", "center", "horiz"), 0.0).alias("pos_x"), _last(pick("motion", "center", "vert"), 0.0).alias("pos_y"),
        _last(pick("motion", "anchor", "horiz"), 0.0).alias("anchor_x"), _last(pick("motion", "anchor", "vert"), 0.0).alias("anchor_y"),
        _last(pick("motion", "rotation", "number"), 0.0).alias("rotation"),
        *[_last(pick("crop", side, "number"), 0.0).alias(f"crop_{side[0]}") for side in ("left", "right", "top", "bottom")],
    )


def clip_keyframes(clips: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per keyframe: parameter name, frame and value; unreadable ones are dropped."""
    opened = clips.select(*keep, F.explode("effects").alias("e")).select(*keep, F.explode("e.parameter").alias("p"))
    return (
        opened.select(*keep, F.lower("p.name").alias("param"), F.explode("p.keyframe").alias("k"))
        .select(*keep, "param", F.trim("k.when").try_cast("bigint").alias("when"), F.col("k.value").try_cast("double").alias("value"))
        .where(F.col("when").isNotNull() & F.col("value").isNotNull())
    )


def parse_fcpxml(projects: DataFrame, key: str = "xml_id", max_tracks: int | None = None) -> DataFrame:
    """Clips of FCPXML projects. Every clip of a spine takes the next track, clips of lanes follow again.

    ``max_tracks`` leaves out the clips of a spine after that many; by default none is left out.
    """
    spines = _sequences(projects, key, FCPX_SEQUENCE, _flat_fcpxml).select(key, "sequence", F.posexplode("_s.spine").alias("spine", "sp"))
    rows = spines.select(key, "sequence", "spine", F.posexplode("sp.clip").alias("track_index", "c"))
    rows = rows if max_tracks is None else rows.where(F.col("track_index") < max_tracks)
    c = F.col("c")
    offset, length, start = (times.parse_time(F.coalesce(c[n], F.lit("0s"))) for n in ("_offset", "_duration", "_start"))

    own = _or_empty(c["param"], _PARAM)
    video = F.flatten(F.transform(_or_empty(c["video"], f"struct<param:array<{_PARAM}>>"), lambda v: _or_empty(v["param"], _PARAM)))
    every = F.concat(own, video)
    titles = F.flatten(F.transform(
        _or_empty(c["title"], "struct<_name:string,text:array<string>>"),
        lambda t: F.concat(F.array(t["_name"]), _or_empty(t["text"], "string")),
    ))
    written = F.transform(F.filter(every, lambda p: F.lower(p["_name"]).isin("text", "title", "caption")), lambda p: p["_value"])
    texts = F.filter(F.concat(titles, written), lambda t: t.isNotNull() & (t != ""))

    def low(p: Column) -> Column:
        return F.lower(F.coalesce(p["_name"], F.lit("")))

    def has(p: Column, *words: str) -> Column:
        test = F.lit(True)
        for w in words:
            test = test & low(p).contains(w)
        return test

    def values(params: Column, test: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(params, test), lambda p: F.coalesce(p["_value"], F.lit("0")).try_cast("double"))

    def plain(p: Column) -> Column:
        return ~has(p, "scale") & ~has(p, "rotation")

    sides = ("left", "right", "top", "bottom")

    def crop(side: str) -> Callable[[Column], Column]:
        def test(p: Column) -> Column:
            hit = has(p, "crop") | has(p, "trim")
            for other in sides[: sides.index(side)]:
                hit = hit & ~has(p, other)
            return hit & has(p, side)

        return test

    return rows.select(
        key, "sequence", "spine", "track_index",
        F.coalesce(c["_name"], F.concat(F.lit("clip_"), F.col("track_index").cast("string"))).alias("clip_name"),
        F.coalesce(c["_ref"], F.lit("")).alias("clip_ref"),
        offset.alias("start_time"), (offset + length).alias("end_time"), length.alias("duration"),
        start.alias("source_start"), length.alias("source_duration"),
        (F.coalesce(c["_enabled"], F.lit("1")) == "1").alias("enabled"),
        F.array_join(texts, " | ").alias("graphics_text"),
        _last(values(video, lambda p: has(p, "scale")), 1.0).alias("scale"),
        _last(values(video, lambda p: plain(p) & ~has(p, "anchor") & has(p, "x", "position")), 0.0).alias("pos_x"),
        _last(values(video, lambda p: plain(p) & ~has(p, "anchor") & ~has(p, "x", "position") & has(p, "y", "position")), 0.0).alias("pos_y"),
        _last(values(video, lambda p: plain(p) & has(p, "anchor", "x")), 0.0).alias("anchor_x"),
        _last(values(video, lambda p: plain(p) & has(p, "anchor", "y") & ~has(p, "x")), 0.0).alias("anchor_y"),
        _last(values(video, lambda p: ~has(p, "scale") & has(p, "rotation")), 0.0).alias("rotation"),
        *[_last(values(every, crop(s)), 0.0).alias(f"crop_{s[0]}") for s in sides],
    )


def parse_project(projects: DataFrame, key: str = "xml_id", max_tracks: int | None = None) -> DataFrame:
    """Clips of mixed projects, by root tag; anything that is not XMEML is read as FCPXML."""
    root = F.regexp_extract("xml", r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z]+)", 1)
    rooted = projects.withColumn("_root", root)
    legacy = clip_params(parse_xmeml(rooted.where(F.col("_root") == "xmeml"), key, max_tracks))
    modern = parse_fcpxml(rooted.where(F.col("_root") != "xmeml"), key, max_tracks)
    common = [c for c in modern.columns if c in legacy.columns]
    return legacy.select(*common, F.lit("xmeml").alias("format")).unionByName(modern.select(*common, F.lit("fcpxml").alias("format")))


def extract_captions(projects: DataFrame, key: str = "xml_id") -> DataFrame:
    """Caption rows: effects of category ``graphic`` with a name, timed by their clipitem."""
    parsed = xmeml_clipitems(projects, key)
    c = F.col("clip")
    opened = parsed.where(c["start"].isNotNull() & c["end"].isNotNull()).select(
        key, "sequence", "track_index", "item", "timebase", _whole(c["start"]).alias("_a"), _whole(c["end"]).alias("_b"),
        F.explode("clip.filter").alias("f"),
    ).select("*", F.explode("f.effect").alias("e"))
    text = F.regexp_replace(F.col("e.name"), r"(?U)^\s+|\s+$", "")
    return opened.where((F.col("e.effectcategory") == "graphic") & (F.col("e.name") != "")).select(
        key, "sequence", "track_index", "item", text.alias("text"),
        (F.col("_a") / F.col("timebase")).alias("start"), (F.col("_b") / F.col("timebase")).alias("end"),
        ((F.col("_b") - F.col("_a")) / F.col("timebase")).alias("duration"),
    )


# Extensions of source recordings and the host part of their addresses.
SOURCE_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".m4v"]
FILE_HOST = "file://localhost/"


def source_mapping(projects: DataFrame, key: str = "xml_id", extensions: Sequence[str] = SOURCE_EXTENSIONS) -> DataFrame:
    """Distinct source videos of each project with the paths of their tracks and features."""

    def paths(root: ET.Element | None, _: str | None) -> Iterable[str]:
        return () if root is None else dict.fromkeys((p.text or "").strip() for p in root.iter("pathurl"))

    listed = _found(projects, key, paths, "url").where(F.col("url").startswith(FILE_HOST))
    bare = F.replace(F.replace("url", F.lit(FILE_HOST), F.lit("")), F.lit("+"), F.lit("%2B"))
    path = F.replace(F.try_url_decode(bare), F.lit("/"), F.lit("\\"))
    ending = F.lower(F.col("source_video_path")).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    name = F.regexp_replace(F.element_at(F.split("source_video_path", r"\\"), -1), r"\.[^.]*$", "")
    return (
        listed.select(key, path.alias("source_video_path"))
        .where(ending)
        .dropDuplicates([key, "source_video_path"])
        .withColumn("source_video_name", name)
        .withColumn("tracks_path", F.concat(F.lit("tracks/"), key, F.lit("_tracks.csv")))
        .withColumn("features_path", F.concat(F.lit("features/"), F.col("source_video_name"), F.lit("_features.csv")))
    )


def timeline(clips: DataFrame, source_fps: float, fps: float = 10.0, key=KEY, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Edit decisions: source in/out at the source rate, laid end to end on the timeline by start."""
    rate = source_fps / fps
    cut = clips.select(
        *blocks.as_list(key), start, F.floor(F.col(start) * rate).alias("in"), F.floor(F.col(end) * rate).alias("out")
    )
    placed = blocks.two_phase(
        blocks.with_block(cut, start), key, start,
        running={"start": ("sum", F.col("out") - F.col("in")), "position": ("count", F.lit(1))}, inclusive=False,
        stats={"timeline_length": ("sum", F.col("out") - F.col("in")), "clips": ("count", F.lit(1))},
    )
    return placed.select(
        *blocks.as_list(key), "position", F.col("start").cast("bigint").alias("start"),
        (F.col("start") + F.col("out") - F.col("in")).cast("bigint").alias("end"), "in", "out",
        "timeline_length", "clips",
    )


def export_timeline(clips: DataFrame, source_fps: float, fps: float = 10.0, key: str = KEY, path: Column | None = None) -> DataFrame:
    """The timeline as XML lines: ``key, line, xml``; sorting by ``line`` gives one document per video.

    Lines rather than one string per video, so that a video's length does not matter.
    """
    name = F.col(key).cast("string")
    rate = f"<rate><timebase>{int(source_fps)}</timebase><ntsc>{'TRUE' if min(abs(source_fps - 29.97), abs(source_fps - 59.94)) < 0.1 else 'FALSE'}</ntsc></rate>"
    address = F.concat(F.lit(FILE_HOST), path if path is not None else F.concat(name, F.lit(".mp4")))
    laid = timeline(clips, source_fps, fps, key)

    def tag(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{label}>"), value.cast("string"), F.lit(f"</{label}>"))

    number = (F.col("position") + 1).cast("string")
    item = F.concat(
        F.lit('<clipitem id="clipitem-'), number, F.lit('">'), tag("name", name), tag("duration", F.col("end") - F.col("start")), F.lit(rate),
        *[tag(c, F.col(c)) for c in ("start", "end", "in", "out")],
        F.lit('<file id="file-1">'), tag("pathurl", address), F.lit("</file></clipitem>"),
    )
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><xmeml version="4"><sequence id="sequence-1">'), tag("name", name),
        tag("duration", F.col("timeline_length")), F.lit(rate + "<media><video><track>"),
    )
    foot = F.lit("</track></video></media></sequence></xmeml>")

    def line(number: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("line"), text.alias("xml"))

    # The first clip brings the head of its document along, the last one the foot.
    position = F.col("position")
    lines = F.array_compact(F.array(
        F.when(position == 0, line(F.lit(0), head)), line(position + 1, item),
        F.when(position == F.col("clips") - 1, line(position + 2, foot)),
    ))
    return laid.select(key, F.explode(lines).alias("l")).select(key, "l.line", "l.xml")


def write_timeline(lines: DataFrame, path: str, key: str = KEY) -> None:
    """One folder per video whose part files, in name order, form the document."""
    lines.repartitionByRange(key, "line").sortWithinPartitions(key, "line").select(key, "xml").write.mode("overwrite").partitionBy(key).text(path)

"""Projection, cleaning, naming rules, text and vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import CLIPS, FRAMES, LONG, clips, frames, long_frames, table
from catalog.align import COVER
from catalog.intervals import TRACKS, tracks
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import KEYS, VECS, vectors
from framewise.functions import naming as N
from framewise.functions import text as T
from framewise.functions import times
from framewise.functions import vectors as V
from framewise.operators import align as A
from framewise.operators import clean as C
from framewise.operators import vectors as VO

GROUPS = {"audio": ["energy", "audio_energy_rms"], "visual": ["motion", "clip_*"], "temporal": ["pitch", "pos*"]}


@query("project_existing", f"WITH {FRAMES} SELECT video_id, frame_idx, {q6('energy')}, {q6('motion')}, {q6('pitch')} FROM frames")
def project_existing(spark, sf):
    f = C.project_existing(frames(spark, sf), GROUPS, KEYS.split())
    return out(f, KEYS, floats=" ".join(c for c in f.columns if c not in KEYS.split()))


@query(
    "coerce_numeric",
    f"""WITH {FRAMES}, raw AS (SELECT video_id, frame_idx, CASE WHEN k % 5 = 0 THEN 'n/a' WHEN k % 7 = 0 THEN NULL ELSE k || '.5' END AS reading FROM frames)
    SELECT video_id, frame_idx, {q6('coalesce(try_cast(reading AS DOUBLE), 0)', 'reading')} FROM raw""",
)
def coerce_numeric(spark, sf):
    k = F.col("k")
    raw = F.when(k % 5 == 0, "n/a").when(k % 7 == 0, None).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    f = frames(spark, sf).withColumn("reading", raw)
    return out(C.coerce_numeric(f, ["reading"]), KEYS, floats="reading")


# k with nulls, NaN and infinities mixed in.
DIRTY = f"""{FRAMES}, dirty AS (SELECT *, CASE WHEN k = 13 THEN NULL WHEN k = 17 THEN 'nan'::double WHEN k = 19 THEN 'inf'::double
   WHEN k = 23 THEN '-inf'::double ELSE k::double END AS d FROM frames)"""


def dirty(spark, sf):
    k = F.col("k")
    d = (
        F.when(k == 13, None).when(k == 17, float("nan")).when(k == 19, float("inf"))
        .when(k == 23, float("-inf")).otherwise(k.cast("double"))
    )
    return frames(spark, sf).withColumn("d", d)


@query(
    "clean_nonfinite",
    f"WITH {DIRTY} SELECT video_id, frame_idx, {q6('CASE WHEN d IS NULL OR isnan(d) OR isinf(d) THEN 0 ELSE d END', 'd')} FROM dirty",
)
def clean_nonfinite(spark, sf):
    return out(C.clean_nonfinite(dirty(spark, sf).select(*KEYS.split(), "d")), KEYS, floats="d")


DOMAINS = f"""{FRAMES}, dom AS (SELECT k % 3 AS text_is_active, active, k / 2.0::double AS asset_id FROM frames)"""


@query(
    "validate_domains",
    f"""WITH {DOMAINS} SELECT 'text_is_active' AS "column", {big('count(*) FILTER (text_is_active NOT IN (0, 1))', 'violations')} FROM dom
    UNION ALL SELECT 'active', {big('count(*) FILTER (active NOT IN (0, 1))', 'violations')} FROM dom
    UNION ALL SELECT 'asset_id', {big('count(*) FILTER (asset_id <> floor(asset_id))', 'violations')} FROM dom""",
)
def validate_domains(spark, sf):
    k = F.col("k")
    f = frames(spark, sf).select(F.pmod(k, F.lit(3)).alias("text_is_active"), "active", (k / 2.0).alias("asset_id"))
    return out(C.validate_domains(f), "column", "violations")


@query(
    "fit_width",
    f"""WITH {VECS}, c AS (SELECT vec_id, v[1:20 + vec_id % 60] AS w FROM frames),
    p AS (SELECT vec_id, (w || list_transform(range(48), lambda x: 0.0::double))[1:48] AS f FROM c)
    SELECT vec_id, {big('len(f)', 'width')}, {q6('list_sum(f)', 'total')}, {q6('f[48]', 'last')} FROM p""",
)
def fit_width(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), (20 + F.pmod("vec_id", F.lit(60))).cast("int")).alias("v")
    )
    done = C.fit_width(e, "v", 48)
    v = F.col("v")
    return out(done.select("vec_id", F.size(v).alias("width"), V.total(v).alias("total"), v[47].alias("last")), "vec_id", "width", "total last")


@query(
    "mask_missing_face",
    f"WITH {FRAMES} SELECT video_id, frame_idx, {q6('CASE WHEN k % 4 = 0 THEN 0 ELSE x END', 'face_center_x')}, {q6('CASE WHEN k % 4 = 0 THEN 0 ELSE y END', 'face_center_y')} FROM frames",
)
def mask_missing_face(spark, sf):
    f = frames(spark, sf).select(
        *KEYS.split(), F.pmod("k", F.lit(4)).alias("face_count"), F.col("x").alias("face_center_x"), F.col("y").alias("face_center_y")
    )
    face = [c for c in f.columns if c.startswith("face_") and c != "face_count"]
    return out(C.mask_when(f, face, F.col("face_count") == 0), KEYS, floats=" ".join(face))


# File names assembled from the event payload.
NAMED = f"""{FRAMES}, named AS (SELECT *, ['Alice','bob','Title_bg','ID-12 carol','Class_7','Cl'][1 + k % 6] ||
   ['_happy','-sad','','_笑顔','_left','-neutral_smile','字幕'][1 + k % 7] || ['_01','','-2'][1 + k % 3] || ['.png','.mp4','.JPG','','.mov'][1 + k % 5] AS clip_name FROM frames)"""


def named(f):
    k = F.col("k")

    def choose(*words: str):
        return F.array(*[F.lit(w) for w in words])[F.pmod(k, F.lit(len(words)))]

    return f.withColumn(
        "clip_name",
        F.concat(
            choose("Alice", "bob", "Title_bg", "ID-12 carol", "Class_7", "Cl"),
            choose("_happy", "-sad", "", "_笑顔", "_left", "-neutral_smile", "字幕"),
            choose("_01", "", "-2"), choose(".png", ".mp4", ".JPG", "", ".mov"),
        ),
    )


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


ASSET_SQL = f"""CASE track WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE
  CASE WHEN {any_sql('lower(clip_name)', N.ASSET_IMAGE_EXTENSIONS)} THEN 3 WHEN {any_sql('lower(clip_name)', N.TEXT_WORDS)} THEN 2
  WHEN regexp_matches(clip_name, '(?i)(class|id)[-_]?([0-9]+)') THEN greatest(2, regexp_extract(clip_name, '(?i)(class|id)[-_]?([0-9]+)', 2)::int) ELSE 2 END END"""


@query("asset_classify_rules", f"WITH {NAMED}, t AS (SELECT *, k % 6 AS track FROM named) SELECT video_id, frame_idx, {big(ASSET_SQL, 'asset_id')} FROM t")
def asset_classify_rules(spark, sf):
    f = named(frames(spark, sf))
    done = f.withColumn("asset_id", N.classify_asset(F.col("clip_name"), F.pmod("k", F.lit(6))))
    return out(done, KEYS, "asset_id")


MEDIA_SQL = f"""CASE WHEN k % 10 = 9 THEN 'graphic' WHEN k % 8 = 0 THEN 'graphic' WHEN {any_sql('lower(clip_name)', N.VIDEO_EXTENSIONS)} THEN 'video'
  WHEN {any_sql('lower(clip_name)', N.IMAGE_EXTENSIONS)} THEN 'image' WHEN k * 2000 > 108000 THEN 'image' ELSE 'video' END"""


def media(f):
    k = F.col("k")
    return N.media_type(
        F.when(k % 10 == 9, "GraphicAndType").otherwise("clip"),
        F.when(k % 8 == 0, F.array(F.lit("motion"), F.lit("graphic"))).otherwise(F.array(F.lit("motion"))),
        F.col("clip_name"), k * 2000,
    )


@query("media_type", f"WITH {NAMED} SELECT video_id, frame_idx, {MEDIA_SQL} AS media_type FROM named")
def media_type(spark, sf):
    f = named(frames(spark, sf))
    return out(f.withColumn("media_type", media(f)), KEYS + " media_type")


def base_sql(c: str) -> str:
    s = f"regexp_replace(lower({c}), '\\.(png|jpg|jpeg|bmp|tif|tiff|psd)$', '')"
    for w in N.EXPRESSIONS:
        s = f"regexp_replace({s}, '[_-]{w}', '', 'g')"
    return f"trim(regexp_replace({s}, '[_-]\\d+$', ''), '_- ')"


@query("speaker_base_name", f"WITH {NAMED} SELECT video_id, frame_idx, {base_sql('clip_name')} AS base_name FROM named")
def speaker_base_name(spark, sf):
    f = named(frames(spark, sf))
    return out(f.withColumn("base_name", N.speaker_base_name(F.col("clip_name"))), KEYS + " base_name")


def zeroed(c: str) -> str:
    return q6(f"CASE WHEN {MEDIA_SQL} = 'graphic' THEN 0 ELSE {c} END", c)


@query("media_constraints", f"WITH {NAMED} SELECT video_id, frame_idx, {zeroed('x')}, {zeroed('y')}, {q6('pitch')} FROM named")
def media_constraints(spark, sf):
    f = named(frames(spark, sf))
    done = C.mask_when(f.withColumn("media_type", media(f)), ["x", "y"], F.col("media_type") == "graphic")
    return out(done, KEYS, floats="x y pitch")


@query(
    "filter_clip_source",
    f"""WITH {CLIPS} SELECT video_id, ord, {big('in_frame')}, {big('out_frame')} FROM clips
    WHERE contains(name, 'asset_' || (video_id % 7)) AND name LIKE '%.mp4' AND out_frame > in_frame""",
)
def filter_clip_source(spark, sf):
    stem = F.concat(F.lit("asset_"), F.pmod("video_id", F.lit(7)).cast("string"))
    c = clips(spark, sf)
    return out(c.where(N.is_source_clip(F.col("name"), stem, F.col("in_frame"), F.col("out_frame"))), "video_id ord", "in_frame out_frame")


CAPTION_CASES = ["hello there", " ", "！", "x", "…", " 字 ", "字幕です", "", "・", "ok\n"]


@query(
    "filter_captions",
    f"""WITH {FRAMES}, c AS (SELECT video_id, frame_idx, [{', '.join("'" + c + "'" for c in CAPTION_CASES)}][1 + k % {len(CAPTION_CASES)}] AS caption FROM frames)
    SELECT video_id, frame_idx, caption FROM c WHERE length(regexp_replace(caption, '^\\s+|\\s+$', '', 'g')) > 1""",
)
def filter_captions(spark, sf):
    words = F.array(*[F.lit(c) for c in CAPTION_CASES])
    f = frames(spark, sf).withColumn("caption", words[F.pmod("k", F.lit(len(CAPTION_CASES)))])
    return out(f.where(N.is_real_caption(F.col("caption"))), KEYS + " caption")


@query(
    "binarize",
    f"""WITH {FRAMES}, thr AS (SELECT video_id, (video_id % 10)/10.0::double AS threshold FROM frames GROUP BY video_id)
    SELECT video_id, frame_idx, {big('score >= 0.5', 'at_least')}, {big('score > 0.5', 'above')}, {big('score >= threshold', 'per_video')} FROM frames JOIN thr USING (video_id)""",
)
def binarize(spark, sf):
    f = frames(spark, sf)
    thr = f.select("video_id").distinct().withColumn("threshold", F.pmod("video_id", F.lit(10)) / 10.0)
    both = C.binarize(C.binarize(f, "score", 0.5, "at_least"), "score", 0.5, "above", strict=True)
    return out(C.apply_thresholds(both, thr, "score", out="per_video"), KEYS, "at_least above per_video")


@query(
    "confidence",
    f"WITH {FRAMES} SELECT video_id, frame_idx, {q6('2/(1+exp(y*10 - x*10)) - 1', 'confidence')}, {q6('1/(1+exp(y*10 - x*10))', 'probability')} FROM frames",
)
def confidence(spark, sf):
    l0, l1 = F.col("y") * 10, F.col("x") * 10
    f = frames(spark, sf).select(*KEYS.split(), C.confidence(l0, l1).alias("confidence"), C.active_probability(l0, l1).alias("probability"))
    return out(f, KEYS, floats="confidence probability")


@query(
    "unpack_vector",
    f"WITH {VECS} SELECT vec_id, {big('t.track', 'track')}, {big('p.param', 'param')}, {q6('v[1 + t.track * 16 + p.param]', 'value')} FROM frames, range(4) t(track), range(16) p(param)",
)
def unpack_vector(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    unpacked = C.vector_to_tracks(e, "v", 16, ["vec_id"])
    # Pack and unpack again: the round trip must keep every value in place.
    again = C.vector_to_tracks(C.tracks_to_vector(unpacked, ["vec_id"]), "vector", 16, ["vec_id"])
    return out(again.select("vec_id", "track", F.posexplode("values").alias("param", "value")), "vec_id", "track param", "value")


TIMES = """t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '/30s' WHEN 1 THEN o_orderkey || '.5s' WHEN 2 THEN o_orderkey::varchar
   WHEN 3 THEN 'bad' WHEN 4 THEN NULL ELSE o_orderkey || '/0s' END AS raw FROM orders)"""


@query(
    "time_parse",
    f"""WITH {TIMES} SELECT o_orderkey, {q6("CASE o_orderkey % 6 WHEN 0 THEN o_orderkey/30.0::double WHEN 1 THEN o_orderkey + 0.5::double WHEN 2 THEN o_orderkey/25.0::double ELSE 0 END", 'seconds')},
    {q6("CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 60 WHEN 59 THEN 59.94::double WHEN 29 THEN 29.97::double WHEN 23 THEN 23.976::double ELSE o_orderkey % 60 END ELSE o_orderkey % 60 END", 'fps')} FROM t""",
)
def time_parse(spark, sf):
    key = F.col("o_orderkey")
    text = key.cast("string")
    raw = (
        F.when(key % 6 == 0, F.concat(text, F.lit("/30s"))).when(key % 6 == 1, F.concat(text, F.lit(".5s")))
        .when(key % 6 == 2, text).when(key % 6 == 3, "bad").when(key % 6 == 4, None).otherwise(F.concat(text, F.lit("/0s")))
    )
    o = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    done = o.select("o_orderkey", times.parse_time(F.col("raw"), 25).alias("seconds"), times.real_fps(key % 60, key % 2 == 0).alias("fps"))
    return out(done, "o_orderkey", floats="seconds fps")


# --- text -------------------------------------------------------------------------------------

WIDE_CLASSES = {**T.CLASSES, "accented": "[À-ÿ]"}
FEATURE_NAMES = ["length", *WIDE_CLASSES, "relative_length"]


def feature_columns(c):
    return [c[i].alias(n) for i, n in enumerate(FEATURE_NAMES)]


def feature_sql(c: str) -> list[str]:
    flags = [q6(f"coalesce(regexp_matches({c}, '{p}'), false)::int", n) for n, p in WIDE_CLASSES.items()]
    return [q6(f"coalesce(length({c}), 0)", "length"), *flags, q6(f"least(coalesce(length({c}), 0)/50.0::double, 1)", "relative_length")]


@query("text_features", f"SELECT doc_id, {', '.join(feature_sql('text'))} FROM documents")
def text_features(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.embed(F.col("text"), "simple", classes=WIDE_CLASSES).alias("v"))
    return out(d.select("doc_id", *feature_columns(F.col("v"))), "doc_id", floats=" ".join(FEATURE_NAMES))


@query(
    "caption_enrich",
    f"""WITH {CLIPS}, cap AS (SELECT f.video_id, f.frame_idx, string_agg(c.name, ' | ' ORDER BY c.ord) AS txt FROM frames f {COVER} AND c.enabled GROUP BY f.video_id, f.frame_idx)
    SELECT video_id, frame_idx, txt AS caption_text, {big('txt IS NOT NULL', 'caption_active')}, {', '.join(feature_sql('txt'))} FROM cap""",
)
def caption_enrich(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_idx")
    shown = A.frame_concat(f, clips(spark, sf).where("enabled"), "ord", "name")
    done = shown.withColumn("v", T.text_features(F.col("caption_text"), WIDE_CLASSES))
    return out(done.select("*", *feature_columns(F.col("v"))), KEYS + " caption_text", "caption_active", " ".join(FEATURE_NAMES))


# --- vectors ----------------------------------------------------------------------------------


@query(
    "collect_valid_vectors",
    f"""WITH {VECS}, d AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(v, lambda x: 0.0::double)
       WHEN vec_id % 7 = 0 THEN list_append(v[1:63], 'nan'::double) ELSE v END AS v FROM frames)
    SELECT vec_id, {q6('list_sum(v)', 'total')} FROM d WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0""",
)
def collect_valid_vectors(spark, sf):
    v, i = V.as_double(F.col("embedding")), F.col("vec_id")
    broken = F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))
    mixed = F.when(i % 5 == 0, F.transform(v, lambda x: F.lit(0.0))).when(i % 7 == 0, broken).otherwise(v)
    e = table(spark, sf, "embeddings").select("vec_id", mixed.alias("v"))
    return out(VO.valid_vectors(e, "v").select("vec_id", V.total(F.col("v")).alias("total")), "vec_id", floats="total")


@query(
    "nearest_centroid",
    f"""WITH {VECS}, src AS (SELECT video_id, vec_id, v FROM frames), part AS (SELECT video_id AS cluster, i, avg(v[i]) AS m FROM src, range(1, 65) r(i) GROUP BY ALL),
    cen AS (SELECT cluster, list(m ORDER BY i) AS c FROM part GROUP BY cluster),
    s AS (SELECT vec_id, cluster, list_cosine_similarity(v, c) AS sim FROM src, cen)
    SELECT vec_id, {big('arg_max(cluster, sim)', 'cluster')}, {q6('max(sim)', 'similarity')} FROM s GROUP BY vec_id""",
)
def nearest_centroid(spark, sf):
    e = table(spark, sf, "embeddings")
    cen = VO.centroids(e, "embedding", "label")
    return out(VO.assign_centroid(e, "embedding", cen, "label"), "vec_id", "cluster", "similarity")


@query("leader_cluster")
def leader_cluster(spark, sf):
    done = VO.leader_cluster(vectors(spark, sf), "embedding", 0.15)
    return out(done, "video_id vec_id", "frame_idx cluster")


@query("global_identity")
def global_identity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return out(VO.global_identity(e, "embedding"), "vec_id", "cluster", "similarity")


@query(
    "global_identity_summary",
    f"SELECT {big('count(*)', 'vectors')}, {big('count(DISTINCT vec_id)', 'distinct_vectors')}, {big('count(*)', 'inside')}, {big('count(*)', 'similar')} FROM embeddings",
)
def global_identity_summary(spark, sf):
    """Every vector once, in one of the identities, at a cosine."""
    found = global_identity(spark, sf)
    done = found.agg(
        F.count(F.lit(1)).alias("vectors"), F.count_distinct("vec_id").alias("distinct_vectors"), F.count_if(F.col("cluster") >= 0).alias("inside"),
        F.count_if(F.col("similarity").cast("double").between(-1.00001, 1.00001)).alias("similar"),
    )
    return out(done, "", "vectors distinct_vectors inside similar")


def planted(f):
    """A direction per speaker, and a little of two other features: the clusters are known."""
    parts = [(F.col("speaker_id") == n).cast("double") for n in range(5)]
    return f.withColumn("emb", F.array(*parts, F.col("x") / 5, F.col("y") / 5))


@query(
    "leader_cluster_planted",
    f"""WITH {LONG}, s AS (SELECT video_id, speaker_id, min(frame_idx) AS f FROM frames GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) - 1 AS cluster FROM s)
    SELECT video_id, {big('frame_idx')}, {big('cluster')} FROM frames JOIN n USING (video_id, speaker_id)""",
)
def leader_cluster_planted(spark, sf):
    """Speakers keep their number through stretches of 256 positions."""
    done = VO.leader_cluster(planted(long_frames(spark, sf)), "emb", 0.55, block=256)
    return out(done, "video_id", "frame_idx cluster")


@query(
    "global_identity_planted",
    f"""WITH {FRAMES}, s AS (SELECT speaker_id, row_number() OVER (ORDER BY count(*) DESC) - 1 AS cluster FROM frames GROUP BY speaker_id)
    SELECT event_id, {big('cluster')} FROM frames JOIN s USING (speaker_id)""",
)
def global_identity_planted(spark, sf):
    return out(VO.global_identity(planted(frames(spark, sf)), "emb"), "event_id", "cluster")


VOTES = f"{FRAMES}, {TRACKS}"


@query(
    "vote_mode",
    f"""WITH {VOTES}, c AS (SELECT video_id, asset_id, count(*) AS n, min(frame_idx * 5 + track) AS f FROM tracks WHERE active = 1 GROUP BY ALL)
    SELECT video_id, {big('asset_id')}, {big('n', 'votes')} FROM c QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f) = 1""",
)
def vote_mode(spark, sf):
    from framewise.operators import ensemble as E

    t = tracks(frames(spark, sf)).where(F.col("active") == 1).withColumn("seq", F.col("frame_idx") * 5 + F.col("track"))
    return out(E.mode_first(t, ["video_id"], "asset_id", "seq"), "video_id", "asset_id votes")


@query(
    "speaker_map",
    f"""WITH {FRAMES}, c AS (SELECT video_id, speaker_id, k % 4 AS global_id, count(*) AS n, min(frame_idx) AS f FROM frames GROUP BY ALL)
    SELECT video_id, {big('speaker_id')}, {big('global_id')}, {big('n', 'votes')} FROM c QUALIFY row_number() OVER (PARTITION BY video_id, speaker_id ORDER BY n DESC, f) = 1""",
)
def speaker_map(spark, sf):
    f = frames(spark, sf).withColumn("global_id", F.pmod("k", F.lit(4)))
    return out(VO.speaker_map(f), "video_id", "speaker_id global_id votes")


FIRST_SEEN = f"""WITH {NAMED}, s AS (SELECT video_id, {{name}} AS name, min({{ord}}) AS f FROM named {{where}} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) - 1 AS i FROM s)"""


@query(
    "first_seen_id",
    FIRST_SEEN.format(name="clip_name", ord="frame_idx", where="") + f" SELECT video_id, name AS clip_name, {big('i % 10', 'asset_id')} FROM r",
)
def first_seen_id(spark, sf):
    from framewise.operators import ensemble as E

    return out(E.first_seen_id(named(frames(spark, sf)), "video_id", "clip_name", "frame_idx", modulo=10), "video_id clip_name", "asset_id")


@query(
    "first_seen_id_global",
    f"""WITH {NAMED}, s AS (SELECT clip_name, min(event_id) AS f FROM named GROUP BY ALL)
    SELECT clip_name, {big('(row_number() OVER (ORDER BY f) - 1) % 10', 'asset_id')} FROM s""",
)
def first_seen_id_global(spark, sf):
    from framewise.operators import ensemble as E

    return out(E.first_seen_id(named(frames(spark, sf)), (), "clip_name", "event_id", modulo=10), "clip_name", "asset_id")


@query(
    "speaker_asset_id",
    FIRST_SEEN.format(name=base_sql("clip_name"), ord="frame_idx", where=f"WHERE {MEDIA_SQL} = 'image' AND NOT contains(lower(clip_name), 'bg')")
    + f""" SELECT n.video_id, n.frame_idx, {big(f"CASE WHEN {MEDIA_SQL} = 'graphic' THEN 0 WHEN {MEDIA_SQL} = 'video' THEN 9 WHEN contains(lower(clip_name), 'bg') THEN 8 ELSE least(i + 1, 7) END", 'asset_id')}
    FROM named n LEFT JOIN r ON r.video_id = n.video_id AND r.name = {base_sql('clip_name')}""",
)
def speaker_asset_id(spark, sf):
    f = named(frames(spark, sf))
    return out(VO.speaker_asset_ids(f.withColumn("media_type", media(f)), "clip_name", "media_type", last_speaker=N.MAX_SPEAKER_ID), KEYS, "asset_id")

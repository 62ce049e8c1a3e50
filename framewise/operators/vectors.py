"""Embedding vectors: validity, centroids, online and global clustering, identities."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from framewise.functions import naming
from framewise.functions import vectors as V
from framewise.operators import ensemble
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks
from framewise.session import materialise


# Task functions travel inside the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def valid_vectors(df: DataFrame, vec: str, tiny: float = 1e-8) -> DataFrame:
    """Drop vectors that are null, hold a NaN, or are all (nearly) zero."""
    broken = F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    zero = F.forall(vec, lambda x: F.abs(x) <= tiny)
    return df.where(F.col(vec).isNotNull() & ~broken & ~zero)


def centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean vector per cluster, averaged per dimension with map-side combine."""
    return (
        df.select(F.col(cluster).alias("cluster"), F.posexplode(V.as_double(F.col(vec))).alias("i", "x"))
        .groupBy("cluster", "i")
        .agg(F.avg("x").alias("m"))
        .groupBy("cluster")
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_p"))
        .select("cluster", F.transform("_p", lambda p: p["m"]).alias("centroid"))
    )


#: Bytes of centroids that a task holds at a time.
TILE_BYTES = 16 << 20
# Products of rows and centroids are made in strips of about this many cells.
STRIP_CELLS = 1 << 22


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this width without null or non-finite values as rows, and which of the column they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    values = pc.fill_null(pc.list_flatten(column.take(pa.array(good))), float("nan")).to_numpy(zero_copy_only=False)
    matrix = values.astype(float).reshape(len(good), width)
    finite = np.isfinite(matrix).all(axis=1)
    return matrix[finite], good[finite]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and cosine of the first best centre of every vector; both sides have unit length."""
    places, best = np.zeros(len(vectors), np.int64), np.full(len(vectors), -2.0)
    strip = max(1, STRIP_CELLS // max(1, len(centres)))
    for at in range(0, len(vectors) if len(centres) else 0, strip):
        sims = np.nan_to_num(vectors[at : at + strip] @ centres.T, nan=-2.0)
        places[at : at + strip] = sims.argmax(axis=1)
        best[at : at + strip] = sims.max(axis=1)
    return places, best


def assign_centroid(df: DataFrame, vec: str, centres: DataFrame, drop: str | None = None) -> DataFrame:
    """Nearest centroid by cosine; the lowest cluster wins ties, up to rounding. A row without a finite vector
    of the centroids' length has no cluster, and -2 as its similarity.

    Centroids lie in tiles of up to ``TILE_BYTES``. One tile goes to all tasks; several are dealt out by tile, the
    vectors (not the rows) meet each, and the best of a row's answers is joined back.
    """
    kept = [c for c in df.columns if c not in (drop, "cluster")]
    unit = materialise(centres.select("cluster", V.unit(V.as_double(F.col("centroid"))).alias("c")))
    count, width = unit.agg(F.count(F.lit(1)), F.max(F.size("c"))).first()
    tiles = max(1, -(-count * (width or 0) * 8 // TILE_BYTES))
    kind = centres.schema["cluster"].dataType
    found = StructType([StructField("cluster", kind), StructField("similarity", DoubleType())])
    if tiles == 1:
        # One value of a checked size.
        rows = unit.agg(F.collect_list(F.struct("cluster", "c"))).first()[0]
        rows = sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0]))
        labels, held = [r[0] for r in rows], _unit(np.array([r[1] for r in rows], float).reshape(len(rows), width or 0))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, good = _matrix(batch.column("_v"), held.shape[1])
                places, best = _nearest(_unit(vectors), held)
                names, sims = [None] * batch.num_rows, np.full(batch.num_rows, -2.0)
                for n, p, x in zip(good.tolist(), places.tolist(), best.tolist(), strict=True):
                    if x > -2.0:
                        names[n], sims[n] = labels[p], x
                columns = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, to_arrow_type(kind)), pa.array(sims)], names=[*kept, "cluster", "similarity"])

        given = df.withColumn("_v", V.as_double(F.col(vec))).select(*kept, "_v")
        return given.mapInArrow(one, StructType([*[df.schema[c] for c in kept], *found.fields]))

    slots = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // tiles)
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod(F.xxhash64("_row"), F.lit(slots)).cast("int").alias("slot"),
                        F.col("_row"), F.lit(None).cast(kind).alias("cluster"), V.as_double(F.col(vec)).alias("v"))
    tile = F.pmod(F.xxhash64("cluster"), F.lit(tiles)).cast("int").alias("tile")
    dealt = unit.select(tile, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(None).cast("long").alias("_row"), "cluster", F.col("c").alias("v"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Centroids of a tile come before the vectors that meet it."""
        current, labels, parts, held = None, [], [], np.zeros((0, width))
        for batch in batches:
            where = np.stack([batch.column("tile").to_numpy(), batch.column("slot").to_numpy()], axis=1)
            cuts = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(where)]]), strict=True):
                if current != tuple(where[a]):
                    current, labels, parts, held = tuple(where[a]), [], [], np.zeros((0, width))
                part = batch.slice(a, b - a)
                asks = part.filter(pc.is_valid(part.column("_row")))
                gives = part.filter(pc.is_null(part.column("_row")))
                if gives.num_rows:
                    vectors, good = _matrix(gives.column("v"), width)
                    labels += [gives.column("cluster")[int(n)].as_py() for n in good]
                    parts.append(vectors)
                    held = np.zeros((0, width))
                if asks.num_rows and labels:
                    if not len(held):
                        held = np.concatenate(parts)
                    vectors, good = _matrix(asks.column("v"), width)
                    places, best = _nearest(_unit(vectors), held)
                    yield pa.RecordBatch.from_arrays(
                        [asks.column("_row").take(pa.array(good)), pa.array([labels[p] for p in places], to_arrow_type(kind)), pa.array(best)],
                        names=["_row", "cluster", "similarity"],
                    )

    meet = asked.unionByName(dealt).repartition(tiles * slots, "tile", "slot").sortWithinPartitions("tile", "slot", F.col("_row").asc_nulls_first(), "cluster")
    answers = meet.mapInArrow(stream, StructType([StructField("_row", LongType()), *found.fields])).where("similarity > -2")
    lowest = F.struct((-F.col("similarity")).alias("s"), F.col("cluster"))
    best = answers.groupBy("_row").agg(F.min(lowest).alias("_best"))
    joined = rows.join(best, "_row", "left")
    return joined.select(*kept, F.col("_best.cluster").alias("cluster"), F.coalesce(-F.col("_best.s"), F.lit(-2.0)).alias("similarity"))


# Positions of one video that are followed in sequence, and stretches merged at a time.
LEADER_BLOCK = 4096
LEADER_FAN = 16


def _follow(vectors: np.ndarray, threshold: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Give each vector, in order, the closest running mean above ``threshold`` or a new one; the means and sizes at the end."""
    means, sizes, norms = np.zeros_like(vectors), np.zeros(len(vectors)), np.zeros(len(vectors))
    labels: list[int] = []
    used = 0
    for v in vectors:
        scale = norms[:used] * np.linalg.norm(v)
        sims = np.divide(means[:used] @ v, scale, out=np.zeros(used), where=scale > 0)
        best = int(np.argmax(sims)) if used else -1
        if best < 0 or sims[best] < threshold:
            best, used = used, used + 1
        sizes[best] += 1
        means[best] += (v - means[best]) / sizes[best]
        norms[best] = np.linalg.norm(means[best])
        labels.append(best)
    return labels, means[:used], sizes[:used]


def _continue(means: np.ndarray, sizes: np.ndarray, more: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Clusters that come later continue earlier ones: the closest pairs first, each side once, from ``threshold`` up. Others are new."""
    labels = [-1] * len(more)
    if len(means):
        sims = _unit(means) @ _unit(more).T
        earlier, later = np.nonzero(sims >= threshold)
        taken = set()
        for n in np.lexsort((later, earlier, -sims[earlier, later])):
            p, c = int(earlier[n]), int(later[n])
            if labels[c] < 0 and p not in taken:
                labels[c] = p
                taken.add(p)
    fresh = [c for c, x in enumerate(labels) if x < 0]
    for n, c in enumerate(fresh):
        labels[c] = len(means) + n
    width = more.shape[1]
    means = np.concatenate([means.reshape(len(means), width), np.zeros((len(fresh), width))])
    sizes = np.concatenate([sizes, np.zeros(len(fresh))])
    for c, x in enumerate(labels):
        sizes[x] += weights[c]
        means[x] += (more[c] - means[x]) * (weights[c] / sizes[x])
    return labels, means, sizes


def leader_cluster(df: DataFrame, vec: str, threshold: float = 0.55, key=KEY, order=ORDER, block: int = LEADER_BLOCK) -> DataFrame:
    """Online clustering per video in time order, by one rule for videos of every length.

    A video is followed in sequence within each stretch of ``block`` positions. The clusters of a stretch are then
    known by their means and sizes alone, and 16 neighbouring stretches at a time are merged, level by level: in time
    order, a cluster continues the nearest of all earlier ones whose mean reaches ``threshold``, however long ago it was
    heard, and two clusters of one stretch stay two. Numbers follow the first appearance.

    A task holds one stretch, or the clusters (not the rows) of the stretches it merges.
    """
    keys = blocks.as_list(key)
    own = [df.schema[k] for k in keys]
    summary = [StructField("_mean", ArrayType(DoubleType())), StructField("_w", DoubleType())]
    longs = lambda *names: [StructField(n, LongType()) for n in names]

    def with_summaries(rows: pd.DataFrame, label: str, labels: list[int], means: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        """The mean and size of a cluster stand in its first row."""
        rows = rows.assign(**{label: labels}, _mean=None, _w=np.nan).reset_index(drop=True)
        first = ~rows[label].duplicated()
        rows["_mean"] = [means[x].tolist() if f else None for x, f in zip(labels, first, strict=True)]
        rows.loc[first, "_w"] = [sizes[x] for x, f in zip(labels, first, strict=True) if f]
        return rows

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sub")
        labels, means, sizes = _follow(np.array([np.asarray(v, dtype=float) for v in pdf["_v"]]), threshold)
        return with_summaries(pdf[[*keys, "_grp", "_sub"]], "_label", labels, means, sizes)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_grp", "_label"])
        means, sizes, labels = np.zeros((0, 0)), np.zeros(0), []
        for _, part in pdf.groupby("_grp", sort=True):
            more = np.array([np.asarray(v, dtype=float) for v in part["_mean"]])
            found, means, sizes = _continue(means, sizes, more, part["_w"].to_numpy(), threshold)
            labels += found
        return with_summaries(pdf[[*keys, "_up_grp", "_grp", "_label"]], "_up", labels, means, sizes)

    items = df.select(*keys, blocks.int_div(order, block).alias("_grp"), F.col(order).cast("bigint").alias("_sub"), V.as_double(F.col(vec)).alias("_v"))
    step = materialise(items.groupBy(*keys, "_grp").applyInPandas(follow, StructType([*own, *longs("_grp", "_sub", "_label"), *summary])))
    clusters = step.where("_w is not null").select(*keys, "_grp", "_label", "_mean", "_w")
    first, last = clusters.agg(F.min("_grp"), F.max("_grp")).first()
    names = clusters.select(*keys, F.col("_grp").alias("_stretch"), F.col("_label").alias("_local"), "_grp", "_label")
    base, last = min(first or 0, 0), (last or 0) - min(first or 0, 0)
    clusters, names = (d.withColumn("_grp", F.col("_grp") - base) for d in (clusters, names))
    up = blocks.int_div("_grp", LEADER_FAN)
    while last > 0:
        merged = materialise(
            clusters.withColumn("_up_grp", up).groupBy(*keys, "_up_grp").applyInPandas(merge, StructType([*own, *longs("_up_grp", "_grp", "_label", "_up"), *summary]))
        )
        onward = merged.select(*keys, "_grp", "_label", "_up_grp", "_up")
        names = blocks.join_null_safe(names, onward, [*keys, "_grp", "_label"]).select(*keys, "_stretch", "_local", F.col("_up_grp").alias("_grp"), F.col("_up").alias("_label"))
        clusters = merged.where("_w is not null").select(*keys, F.col("_up_grp").alias("_grp"), F.col("_up").alias("_label"), "_mean", "_w")
        last //= LEADER_FAN
    named = names.select(*keys, F.col("_stretch").alias("_grp"), F.col("_local").alias("_label"), F.col("_label").alias("cluster"))
    placed = blocks.join_null_safe(step.select(*keys, "_grp", "_sub", "_label"), named, [*keys, "_grp", "_label"])
    return blocks.join_null_safe(df, placed.select(*keys, F.col("_sub").alias(order), "cluster"), [*keys, order])


# Micro-clusters that average linkage works on, and those merged in one task.
MICRO_CLUSTERS = 2000


def _absorb(sums: np.ndarray, sizes: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Clustering features (sums of unit vectors, sizes), in order, absorbed by the nearest within a cosine distance."""
    out, counts, units, used = np.zeros_like(sums), np.zeros(len(sums)), np.zeros_like(sums), 0
    for s, n in zip(sums, sizes, strict=True):
        norm = np.linalg.norm(s)
        sims = units[:used] @ (s / norm if norm else s)
        best = int(np.argmax(sims)) if used else -1
        if best < 0 or 1 - sims[best] > radius:
            best, used = used, used + 1
        out[best] += s
        counts[best] += n
        length = np.linalg.norm(out[best])
        units[best] = out[best] / length if length else out[best]
    return out[:used], counts[:used]


def _condense(sums: np.ndarray, sizes: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Absorbs within ``radius``, and within a larger one as long as more than ``most`` are left."""
    sums, sizes = _absorb(sums, sizes, radius)
    while len(sums) > most:
        radius *= 1.5
        sums, sizes = _absorb(sums, sizes, radius)
    return sums, sizes


def average_linkage(sums: np.ndarray, sizes: np.ndarray, distance: float) -> list[int]:
    """Merges the two clusters of the least mean cosine distance between members until it exceeds ``distance``.

    The mean over all pairs of members follows from sums of unit vectors, so that micro-clusters count by their sizes.
    """
    sums, sizes, owner = sums.copy(), sizes.copy(), np.arange(len(sums))
    far = 1 - (sums @ sums.T) / np.outer(sizes, sizes)
    np.fill_diagonal(far, np.inf)
    nearest = far.min(axis=1) if len(far) else np.zeros(0)
    while len(far) and nearest.min() <= distance:
        a = int(nearest.argmin())
        b = int(far[a].argmin())
        a, b = min(a, b), max(a, b)
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        owner[owner == b] = a
        far[b, :] = far[:, b] = np.inf
        row = 1 - (sums @ sums[a]) / (sizes * sizes[a])
        row[np.isinf(nearest)] = row[[a, b]] = np.inf
        nearest[b] = np.inf
        far[a, :] = far[:, a] = row
        stale = np.flatnonzero(~np.isinf(nearest))
        nearest[stale] = far[stale].min(axis=1)
        if len(stale) == 1:
            break
    return owner.tolist()


def identity_centroids(df: DataFrame, vec: str, distance: float = 0.3, most: int = MICRO_CLUSTERS) -> DataFrame:
    """(cluster, centroid) of the identities in all vectors, found by distance rather than by number.

    Every task condenses its vectors to clustering features within a fifth of ``distance`` of each other, tasks' features are
    condensed again 16 at a time, and average linkage joins what is left. A task holds at most ``most`` features of each
    input; where vectors are too spread for that, features grow wider, and identities closer than these may join.
    Numbers descend by size.
    """
    radius = distance / 5
    schema = "part long, sums array<double>, size double"

    def rows(part: int, sums: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "sums": list(sums), "size": sizes}).astype({"part": "int64", "size": "float64"})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sizes = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                column = batch.column("_v").slice(at, 2048)
                vectors, _ = _matrix(column, len(column[0].as_py()))
                sums, sizes = (vectors, np.ones(len(vectors))) if sums is None else (np.concatenate([sums, vectors]), np.concatenate([sizes, np.ones(len(vectors))]))
                sums, sizes = _condense(sums, sizes, radius, most)
        if sums is not None:
            yield from pa.Table.from_pandas(rows(TaskContext.get().partitionId(), sums, sizes), preserve_index=False).to_batches()

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["from", "place"])
        return rows(key[0], *_condense(np.array([np.asarray(s, float) for s in pdf["sums"]]), pdf["size"].to_numpy(), radius, most))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, sizes = np.array([np.asarray(s, float) for s in pdf["sums"]]), pdf["size"].to_numpy()
        order = np.lexsort((*sums.T[::-1], -sizes))
        sums, sizes = sums[order], sizes[order]
        owner = np.array(average_linkage(sums, sizes, distance))
        found = [(sums[owner == x].sum(axis=0), sizes[owner == x].sum()) for x in np.unique(owner)]
        found.sort(key=lambda f: (-f[1], tuple(f[0])))
        return pd.DataFrame({"cluster": range(len(found)), "centroid": [s / n for s, n in found]})

    ready = valid_vectors(df.select(V.as_double(F.col(vec)).alias("_v")), "_v").select(V.unit(F.col("_v")).alias("_v"))
    features = materialise(ready.mapInArrow(first, schema))
    last = features.agg(F.max("part")).first()[0] or 0
    while last > 0:
        # A stable order inside a part: by size and sums, as rows have no place of their own.
        given = features.select(F.floor(F.col("part") / LEADER_FAN).cast("long").alias("up"), F.col("part").alias("from"), "sums", "size")
        given = given.withColumn("place", F.xxhash64("sums", "size"))
        features = materialise(given.groupBy("up").applyInPandas(again, schema))
        last //= LEADER_FAN
    # At most ``most`` rows.
    return features.groupBy("part").applyInPandas(link, "cluster long, centroid array<double>")


def global_identity(df: DataFrame, vec: str, distance: float = 0.3, most: int = MICRO_CLUSTERS) -> DataFrame:
    """Identities across videos, as many as lie further apart than ``distance``, and the nearest one of each row."""
    return assign_centroid(df, vec, materialise(identity_centroids(df, vec, distance, most)))


def speaker_map(df: DataFrame, key: Sequence[str] = (KEY, "speaker_id"), value: str = "global_id", order=ORDER) -> DataFrame:
    """Modal global identity of each video's local speaker."""
    return ensemble.mode_first(df, key, value, order)


def speaker_asset_ids(df: DataFrame, name: str, media: str, key=KEY, order=ORDER, last_speaker: int | None = None) -> DataFrame:
    """Asset class: graphics 0, backgrounds 8, overlays and videos 9, speakers by first appearance.

    Speakers have the numbers 1, 2, ... up to ``last_speaker``, which later ones share, and skip the fixed classes
    if there is no such limit.
    """
    low, image = F.lower(F.col(name)), F.col(media) == "image"
    background = naming.contains_any(low, naming.BACKGROUND_WORDS)
    overlay = naming.contains_any(low, naming.OVERLAY_WORDS)
    base = df.withColumn("_base", naming.speaker_base_name(F.col(name)))
    speakers = base.where(image & ~background & ~overlay)
    number = F.col("asset_id")
    free = F.when(number >= naming.BACKGROUND_ID, number + 2).otherwise(number)
    ids = ensemble.first_seen_id(speakers, key, "_base", order, first=1).select(
        *blocks.as_list(key), "_base", (F.least("asset_id", F.lit(last_speaker)) if last_speaker else free).alias("_speaker")
    )
    known = blocks.join_per_key(base, ids, [*blocks.as_list(key), "_base"], order, "left")
    return known.select(
        *df.columns,
        F.when(F.col(media) == "graphic", naming.GRAPHIC_ID)
        .when(~image, naming.VIDEO_ID)
        .when(background, naming.BACKGROUND_ID)
        .when(overlay, naming.OVERLAY_ID)
        .otherwise(F.col("_speaker"))
        .alias("asset_id"),
    )

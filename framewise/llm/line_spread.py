"""Removal of cross-site boilerplate lines by the spread of a line over distinct sites.

Every line hash carries a HyperLogLog sketch of the sites it was seen on. Sketches are built per task and
merged by aggregation, so a line on a third of all documents costs one small sketch per task. The
sketch decides lines whose estimate is clearly above or below the threshold; lines within ``margin``
of it get an exact distinct count. Only hashes move for this; texts are read twice and joined once by
their document to the numbers of the lines to drop.

Defined results
    null or empty text has no lines removed and stays as it is; lines that are blank are never boilerplate;
    a null site counts as one site of its own; rows repeating a ``doc_id`` are treated alike line by line;
    lines are compared after trimming spaces, tabs and carriage returns, by a 128-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.shared import Scratch

LG_K = 12
MARGIN = 0.1


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line) -> F.Column:
    return F.md5(F.regexp_replace(line, "^[ \\t\\r]+|[ \\t\\r]+$", ""))


def line_sites(docs: DataFrame, site: str) -> DataFrame:
    """(line_key, site) of every non-blank line."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
        F.explode(_lines(F.col("text"))).alias("line"),
    )
    return rows.where(F.col("line").rlike("[^ \\t\\r]")).select(_key(F.col("line")).alias("line_key"), "site")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 5, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """line_key, sites: the lines on at least ``min_sites`` distinct sites.

    ``margin`` is the relative band around the threshold that is counted exactly; at ``lg_k`` = 12 the
    sketch's relative standard error is 1.6 %, so the default band is six of them.
    """
    seen = line_sites(docs, site)
    spread = seen.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = spread.select("line_key", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = spread.where(F.col("estimate") >= (1 - margin) * min_sites)
    sure = spread.where(F.col("estimate") > (1 + margin) * min_sites).select("line_key", F.col("estimate").alias("sites"))
    near = spread.where(F.col("estimate") <= (1 + margin) * min_sites).select("line_key")
    pairs = seen.join(near, "line_key", "left_semi").distinct()
    exact = pairs.groupBy("line_key").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact)


def remove_lines(docs: DataFrame, scratch: Scratch, site: str = "source", min_sites: int = 5, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """All columns, ``text`` without boilerplate lines, and n_lines, n_removed.

    A document is named by its own hash for the way back, so that repeated ids do not mix.
    """
    # Written first: a table of known size, joined on its own, lets Spark choose a broadcast or split a hot line.
    flagged = scratch.keep(boilerplate(docs, site, min_sites, margin, lg_k).select("line_key"), "boilerplate")
    named = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"),
        F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("h")).alias("doc"),
    )
    places = named.select("doc", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    places = places.where(F.col("line").rlike("[^ \\t\\r]")).select("doc", "at", _key(F.col("line")).alias("line_key"))
    hits = places.join(flagged, "line_key", "left_semi")
    drops = hits.groupBy("doc").agg(F.collect_set("at").alias("dropped")).withColumnRenamed("doc", "hit")
    joined = named.join(drops, F.col("doc").eqNullSafe(F.col("hit")), "left")
    left = F.filter(_lines(F.col("text")), lambda _, at: ~F.array_contains(F.col("dropped"), at))
    clean = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    added = {
        "n_lines": F.when(F.length("text") > 0, F.size(_lines(F.col("text")))).otherwise(0).cast("long"),
        "n_removed": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
    }
    passed = [clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return joined.select(*passed, *(value.alias(name) for name, value in added.items()))

"""Connected components of an edge table, by contraction.

In a round every node points to its smallest neighbour if that is smaller, pointers are doubled until they reach the
roots, and the edges are rewritten to roots; those within a root go, equal ones fall together. Stars and
other shallow shapes are gone after one round, so the rows handled in all rounds stay near the number of
edges. What a round keeps is written to the shared folder: neither lineage nor driver memory grows, and a hub
is one row per edge, which adaptive skew splitting deals out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.shared import Scratch


def _nonempty(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """(u, v) -> (node, label): every node of an edge to another one, with the smallest node it is connected to."""
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    call = f"components{sum(part.startswith('components') for part in scratch.paths)}"
    edges = scratch.keep(edges, f"{call}-edges-0")
    labels = None
    for turn in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
        roots = scratch.keep(roots.select("node", F.least("node", "to").alias("to")), f"{call}-roots")
        while True:
            onward = roots.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            doubled = scratch.keep(roots.join(onward, "to"), f"{call}-roots")
            roots = doubled.select("node", F.col("beyond").alias("to"))
            if not _nonempty(doubled.where("beyond < to")):
                break
        if labels is None:
            labels = roots.withColumnRenamed("to", "label")
        else:
            onward = roots.select(F.col("node").alias("label"), F.col("to").alias("beyond"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("beyond", "label").alias("label"))
        labels = scratch.keep(labels, f"{call}-labels-{turn}")
        scratch.drop(f"{call}-labels-{turn - 1}")
        left, right = roots.select(F.col("node").alias("u"), F.col("to").alias("a")), roots.select(F.col("node").alias("v"), F.col("to").alias("b"))
        edges = edges.join(left, "u").join(right, "v").where("a <> b")
        edges = scratch.keep(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{call}-edges-{turn}")
        scratch.drop(f"{call}-roots", f"{call}-edges-{turn - 1}")
        if not _nonempty(edges):
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Near-duplicate documents by b-bit MinHash (see ``neargroups``).

Words are runs of bytes outside white space after lower-casing A-Z; a document is the set of its distinct
``k``-word shingles. Documents with ``100 * intersection >= percent * union`` are linked, and linked
documents form components.

Defined results
    fewer than ``k`` words: the whole sequence is one shingle; null text or no words: the empty set, linked with
    nothing, a component of its own and kept; rows repeating a ``doc_id`` are linked like any others, and of
    rows with the smallest ``doc_id`` of a component each is kept; a null ``doc_id`` never names a component
    that has another; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.neargroups import DOCUMENTS, fingerprints, near_groups, sets_of
from framewise.llm.shared import Scratch, columns


def document_components(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = columns(docs, doc_id="long", text="string")
    texts = rows.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("ident"), "text")
    prints = scratch.keep(fingerprints(texts, k), "prints")

    def sets_for(wanted: DataFrame) -> DataFrame:
        owners = wanted.withColumnRenamed("ident", "owner")
        return sets_of(texts.join(owners, F.col("ident").eqNullSafe(F.col("owner"))).dropDuplicates(["node"]), k)

    grouped = near_groups(prints, sets_for, scratch, percent, DOCUMENTS)
    smallest = grouped.where("n > 0").groupBy("label").agg(F.min("ident.doc_id").alias("component_id"))
    # Written first, so that the join below has no aggregate on its side and a hot component can be split.
    smallest = scratch.keep(smallest.withColumnRenamed("label", "of"), "smallest")
    rows = grouped.join(smallest, F.col("label") == F.col("of"), "left")
    doc, part = F.col("ident.doc_id"), F.col("component_id")
    named = F.when(F.col("n") > 0, part).otherwise(doc)
    return rows.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), named.alias("component_id"), doc.eqNullSafe(named).alias("kept"))


def survivors(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents kept, all columns. Rows repeating a kept ``doc_id`` stay together."""
    kept = document_components(docs, scratch, k, percent).where("kept").select(F.col("doc_id").alias("stays")).distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(kept, F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")

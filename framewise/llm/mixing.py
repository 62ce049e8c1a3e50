"""Mixing sources to target weights.

Every source is a stream of words, packed into blocks of a fixed number of words. The mix is a sequence of
output shards; each shard draws how many of its slots go to which source from the multinomial
distribution of the targets. The slots of a source are numbered across shards and mapped through a
pseudorandom permutation of the source's block numbers, one permutation per pass over the source;
joining blocks by number gives the words. Everything is DataFrame code: the draw, the numbering and the
permutation are expressions of row numbers and a seed, so reruns and retried tasks agree.

Targets: sources ordered by code point (null last) get the weights in turn and share ``share`` times all
words by weight; a target stops at ``repeat`` times its source's words and the excess goes to the others
by weight until none is above. The fixed point has a closed form, ``min(cap, level * weight)``, found by one
pass over the sources ordered by ``cap / weight``.

Shards draw independently, so a source's draws miss its number of slots by about their square root. Slots
drawn beyond a source's number are given, in order, to the sources that drew too few. The last slot of a
source is cut so that its words are its target to the word.

Positions of documents in their stream are running sums inside buckets of a source (``chunk_rows`` documents
each) plus the sums of the buckets before, so no task sees a whole source.

Defined results
    null text has no words, takes no part and has ``taken`` 0; a null source is a source of its own;
    a source without words has target 0; an empty table gives an empty mix;
    rows repeating a ``doc_id`` are documents of their own, in the order of their size;
    further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.shared import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
ROUNDS = 24
CELLS = 4096
LEVELS = 1 << 52  # uniform draws have 52 bits


@dataclass
class Mix:
    """docs: doc_id, source, size, start; sources: one row per source; slots: one row per output slot;
    documents: one row per document and number of the passes that took words of it."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _hash(seed: int, *cols) -> F.Column:
    return F.xxhash64(F.lit(seed), *cols)


def _ceil_div(a, b) -> F.Column:
    return F.floor((a + b - 1) / b).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, repeat: float) -> DataFrame:
    """source, source_size -> source, source_size, weight, target. One row per source throughout."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    whole = Window.partitionBy(F.lit(0))
    here = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        (F.sum("source_size").over(whole) * float(share)).alias("wanted"),
    )
    # The level if this source and all after it stay below their caps; the first such source sets it.
    here = here.withColumn("level", F.greatest(F.lit(0.0), F.col("wanted") - F.col("capped")) / F.col("left"))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)
    here = here.withColumn("level", F.coalesce(fits["level"], F.max("ratio").over(whole)))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return here.select("source", "source_size", "rank", "weight", target.alias("target"))


def positions(docs: DataFrame, scratch: Scratch, chunk_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, start, and the words of each source."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = scratch.keep(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    chunks = by_source.select(F.col("source").alias("s"), _ceil_div(F.col("rows"), F.lit(chunk_rows)).alias("chunks"))
    rows = sized.join(chunks, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("chunk", F.pmod(_hash(seed, "doc_id", "size"), F.col("chunks"))).drop("chunks")
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(along), F.lit(0)).alias("offset"))
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return placed.select("doc_id", "source", "size", (F.col("before") + F.col("offset")).alias("start")), by_source


def _locate(rows: DataFrame, key: str, ranges: DataFrame, low: str, high: str, span) -> DataFrame:
    """Joins each row with the range [low, high) of ``ranges`` that holds its key, by cells of equal width.

    A cell meets few ranges, and a range lies in as many cells as it is wide: an equality join, no product.
    """
    width = F.greatest(F.lit(1), _ceil_div(span, F.lit(CELLS)))
    cut = ranges.where(F.col(high) > F.col(low)).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    )
    inside = (F.col(key) >= F.col(low)) & (F.col(key) < F.col(high))
    return rows.withColumn("cell", F.floor(F.col(key) / width)).join(cut, "cell").where(inside).drop("cell")


def permuted(index, size, *keys) -> F.Column:
    """A pseudorandom permutation of [0, size): the swap-or-not shuffle, which needs no power of two."""

    def step(x, r):
        mirror = F.pmod(F.pmod(_hash(1, r, *keys), size) - x, size)
        swap = F.pmod(_hash(2, r, F.greatest(x, mirror), *keys), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index.cast("long"), step)


def mix(
    docs: DataFrame, scratch: Scratch, weights=(5.0, 2.0, 1.0), share: float = 1.5, repeat: int = 2,
    block_words: int = 1024, shard_slots: int = 4096, chunk_rows: int = 4096, seed: int = 17,
) -> Mix:
    """Draws the mix of ``docs`` (doc_id, text, source)."""
    placed, by_source = positions(docs, scratch, chunk_rows, seed)
    placed = scratch.keep(placed, "placed")
    sources = source_targets(by_source.select("source", "source_size"), list(weights), share, repeat)
    goal = F.round("target").cast("long")
    blocks = _ceil_div(F.col("source_size"), F.lit(block_words))
    sources = sources.withColumn("blocks", blocks).withColumn("goal", F.least(goal, F.col("source_size") * repeat))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    # One slot more than the rest fills, since the short last block may lie among them.
    last = F.when(F.col("rest") > 0, F.least(F.col("blocks"), _ceil_div(F.col("rest"), F.lit(block_words)) + 1)).otherwise(0)
    sources = sources.withColumn("slots", F.col("passes") * F.col("blocks") + last)
    along = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumn("upto", F.sum("slots").over(along)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))
    sources = scratch.keep(sources, "sources")

    slots = _draw(sources, scratch, shard_slots, seed)
    number, size = F.col("nth") % F.col("blocks"), F.col("blocks")
    slots = slots.withColumn("pass", F.floor(F.col("nth") / size)).withColumn("block", permuted(number, size, F.lit(seed), F.col("rank"), F.col("pass")))
    full, short = F.lit(block_words), F.col("source_size") - (size - 1) * block_words
    slots = slots.withColumn("length", F.when(F.col("block") == size - 1, short).otherwise(full).cast("long"))
    slots = scratch.keep(slots, "slots")
    # Where the short block lies in the last, cut pass: at most one row per source.
    tail = slots.where((F.col("pass") == F.col("passes")) & (F.col("block") == size - 1))
    tail = tail.select(F.col("rank").alias("short_rank"), number.alias("short_at"))
    slots = slots.join(tail, F.col("rank") == F.col("short_rank"), "left").drop("short_rank")
    before = number * block_words - F.when(F.col("short_at") < number, block_words - short).otherwise(0)
    cut = F.least(F.col("length"), F.greatest(F.lit(0).cast("long"), F.col("rest") - before))
    slots = slots.withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(cut))
    slots = slots.where("words > 0").select("shard", "slot", "source", "rank", "nth", "pass", "block", "words")

    ranks = sources.select(F.col("source").alias("s"), "rank")
    spans = placed.where("size > 0").join(ranks, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, final = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spans = spans.withColumn("block", F.explode(F.sequence(first, final)))
    used = slots.select("rank", "block", "pass", "shard", "slot", "words")
    pieces = spans.join(used, ["rank", "block"])
    base = F.col("block") * block_words
    begin = F.greatest(F.col("start"), base)
    end = F.least(F.col("start") + F.col("size"), base + F.col("words"))
    pieces = pieces.withColumn("from_word", begin - F.col("start")).withColumn("words", end - begin).where("words > 0")
    pieces = pieces.select("doc_id", "source", "size", "start", "pass", "shard", "slot", "from_word", "words")
    return Mix(placed, sources, slots, pieces)


def _draw(sources: DataFrame, scratch: Scratch, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: shard, slot, the source's columns, and the slot's number ``nth`` within its source."""
    spark = sources.sparkSession
    span = F.lit(LEVELS).cast("long")
    total = F.greatest(F.col("all_slots"), F.lit(1))
    bound = lambda x: F.floor(x.cast("decimal(38,0)") * LEVELS / total).cast("long")
    lines = sources.select("rank", bound(F.col("upto") - F.col("slots")).alias("low"), bound(F.col("upto")).alias("high"))
    # The number of slots comes as a row, not as a value of the driver; slots are made shard by shard.
    count = sources.agg(F.coalesce(F.max("all_slots"), F.lit(0)).alias("n"))
    shards = count.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), _ceil_div(F.col("n"), F.lit(shard_slots)) - 1)).alias("shard"))
    shards = shards.repartition(F.col("shard"))
    drawn = shards.select("shard", F.explode(F.sequence(F.col("shard") * shard_slots, F.least(F.col("n"), (F.col("shard") + 1) * shard_slots) - 1)).alias("slot"))
    drawn = drawn.withColumn("u", F.shiftrightunsigned(_hash(seed + 1, "slot"), 12))
    drawn = _locate(drawn, "u", lines, "low", "high", span).select("shard", "slot", "rank")
    drawn = scratch.keep(drawn, "draws")

    counts = drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("draws"))
    along = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("offset", F.coalesce(F.sum("draws").over(along), F.lit(0))).drop("draws")
    inside = Window.partitionBy("shard", "rank").orderBy("slot")
    rows = drawn.withColumn("within", F.row_number().over(inside) - 1).join(starts, ["shard", "rank"])
    rows = rows.select("shard", "slot", "rank", (F.col("within") + F.col("offset")).alias("nth"))

    have = counts.groupBy("rank").agg(F.sum("draws").alias("drawn"))
    ledger = sources.select("rank", "slots").join(have, "rank", "left").fillna(0, ["drawn"])
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ledger = ledger.withColumn("over_upto", F.sum(over).over(before)).withColumn("under_upto", F.sum(under).over(before))
    ledger = ledger.withColumn("over_from", F.col("over_upto") - over).withColumn("under_from", F.col("under_upto") - under)
    rows = rows.join(ledger.select("rank", "slots", "over_from"), "rank")
    right = rows.where("nth < slots").select("shard", "slot", "rank", "nth")
    spare = rows.where("nth >= slots").select("shard", "slot", (F.col("nth") - F.col("slots") + F.col("over_from")).alias("x"))
    needs = ledger.where("under_upto > under_from").select("rank", "under_from", "under_upto", "drawn")
    # Spare numbers are below the number of slots; cells of that width keep the lookup an equality join.
    moved = _locate(spare, "x", needs, "under_from", "under_upto", F.lit(CELLS * 1024))
    moved = moved.select("shard", "slot", "rank", (F.col("drawn") + F.col("x") - F.col("under_from")).alias("nth"))
    everything = right.unionByName(moved)
    return everything.join(sources.drop("upto", "all_slots"), "rank")


def taken_words(mixed: Mix) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document."""
    key = ["source", "start", "size", "doc_id"]
    taken = mixed.pieces.groupBy(*key).agg(F.sum("words").alias("taken"))
    taken = taken.select(*(F.col(c).alias(f"t_{c}") for c in key), "taken")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    rows = mixed.docs.join(taken, same, "left")
    per_source = mixed.sources.select(F.col("source").alias("s"), "source_size", "target")
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("s")))
    # Documents without words share a start with the next one, but take nothing.
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The rows of ``docs``, all columns, once for every pass that takes words of them; ``text`` is cut to these words.

    White space between words that are taken stays. Rows alike in doc_id, source and size are told apart by their order.
    """
    kind = ["doc_id", "source", "size"]
    nth = lambda *order: (F.row_number().over(Window.partitionBy(*kind).orderBy(*order))).alias("nth")
    ranges = mixed.pieces.groupBy(*kind, "start", "pass").agg(
        F.collect_list(F.struct("from_word", "words")).alias("ranges"), F.sum("words").alias("taken")
    )
    spots = mixed.docs.where("size > 0").select(*kind, "start", nth("start"))
    same = F.lit(True)
    for c in (*kind, "start"):
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    spots = spots.alias("p").join(ranges.alias("q"), same).select(*(F.col(f"p.{c}").alias(f"p_{c}") for c in kind), F.col("nth").alias("p_nth"), "ranges", "taken")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.where("size > 0").select("*", nth("text"))
    same = F.lit(True)
    for c in (*kind, "nth"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    rows = rows.join(spots, same)
    words = F.regexp_extract_all(F.col("text"), F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    chosen = F.transform(F.sort_array("ranges"), lambda r: F.array_join(F.slice(words, r["from_word"].cast("int") + 1, r["words"].cast("int")), ""))
    cut = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(F.array_join(chosen, ""))
    return rows.select(*(cut.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))

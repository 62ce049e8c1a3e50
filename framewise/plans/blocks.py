"""Plan shapes for ordered work that keep one hot key out of any single task.

``Window.partitionBy(key)`` sends every row of a key to one task, which fails when one recording
holds a third of the data. Every ordered operator here partitions by ``(key, block)`` instead,
where a block is a bounded stretch of the key's axis:

* ``neighbourhood`` - frames that look a bounded number of rows back and ahead. Rows near a block
  edge are copied into the neighbouring block, so one shuffle is enough.
* ``two_phase`` - running and whole-key aggregates. Blocks are aggregated with map-side combine,
  block totals are scanned per key (one row per block), and the carry is joined back per block.
* ``runs`` / ``merge_intervals`` - partial groups per block; only the at most two groups that touch
  a block edge meet in the per-key stitch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.session import materialise

BLOCK = "_blk"
_LANE = "_lane"
_PLACE, _ROW = "_key_blk", "_row"

# Rows per block on a dense position axis. Bounds the rows one window task sorts per key.
ROWS_PER_BLOCK = 16384

Spec = tuple[str, Column]


def as_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def int_div(column: Column | str, width) -> Column:
    """Floor division on the integer axis (``div`` truncates, so negative input is shifted)."""
    c = F.col(column) if isinstance(column, str) else column
    w = width if isinstance(width, Column) else F.lit(width)
    return F.call_function("div", c - F.pmod(c, w), w)


def axis_block(axis: Column | str, width) -> Column:
    """The block of a value on a numeric axis of any kind; integers stay exact."""
    c = F.col(axis) if isinstance(axis, str) else axis
    return F.floor((c - F.pmod(c, F.lit(width))) / F.lit(width) + F.lit(0.5)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` in which null keys meet; the columns are those of ``join(right, keys, how)``."""
    if not keys:
        raise ValueError("join_null_safe needs keys")
    renamed = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def range_blocks(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """``df`` with blocks of about equal size, whatever the order's type and however its values crowd.

    Blocks are ranges of (key, order) as Spark sampled them, and written, so that every later use sees the same ones.
    """
    # A number of partitions that is given is not lowered again for few bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *as_list(key), *as_list(order)).withColumn(BLOCK, F.spark_partition_id()))


def expand(df: DataFrame, first: Column, stop: Column, out: str, spread: bool = True) -> DataFrame:
    """A row for every integer ``out`` of ``[first, stop)``, in two steps: its blocks, then the integers inside a block.

    No array is longer than a block or the number of blocks. ``spread`` deals the blocks of a row to different tasks,
    which pays where few rows yield very many.
    """
    own = df.columns
    width = F.lit(ROWS_PER_BLOCK)
    bounds = df.withColumns({"_from": first.cast("bigint"), "_stop": stop.cast("bigint")}).where("_from < _stop")
    steps = bounds.select("*", F.explode(F.sequence(int_div("_from", width), int_div(F.col("_stop") - 1, width))).alias("_part"))
    if spread:
        steps = steps.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part", "_from", "_stop")
    lo, hi = F.greatest(F.col("_from"), F.col("_part") * width), F.least(F.col("_stop"), (F.col("_part") + 1) * width)
    return steps.select(*own, F.explode(F.sequence(lo, hi - 1)).alias(out))


def with_block(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    return df.withColumn(BLOCK, int_div(order, width or ROWS_PER_BLOCK))


def neighbourhood(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    width: int | None = None,
) -> DataFrame:
    """Apply window expressions that reach ``before`` rows back and ``after`` rows ahead.

    ``order`` is the dense integer position of the row within its key (or, for range frames, the
    integer axis itself, with ``before``/``after`` in axis units). ``build(df, w)`` receives the
    rows plus their edge copies and the window ``(key, block)`` ordered by ``order``.
    """
    keys = as_list(key)
    width = width or ROWS_PER_BLOCK
    position = F.col(order)
    first = int_div(F.greatest(position - F.lit(after), F.lit(0)), width)
    last = int_div(position + F.lit(before), width)
    spread = df.select("*", F.explode(F.sequence(first, last)).alias(BLOCK))
    window = Window.partitionBy(*keys, BLOCK).orderBy(order)
    built = build(spread, window)
    return built.where(F.col(BLOCK) == int_div(position, width)).drop(BLOCK)


_TOTALS: Mapping[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def _running_local(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _TOTALS[kind](value).over(window)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def two_phase(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    running: Mapping[str, Spec] | None = None,
    backward: Mapping[str, Spec] | None = None,
    stats: Mapping[str, Spec] | None = None,
    inclusive: bool = True,
    block: str = BLOCK,
    once: bool = True,
) -> DataFrame:
    """Add running, reverse-running and whole-key aggregates.

    ``df`` carries a ``block`` column that is monotone in ``order``. Each spec is
    ``output -> (kind, expression)`` with kind ``sum``, ``count``, ``max``, ``min`` or ``last``
    (last non-null in scan direction; not for ``stats``). An exclusive scan leaves out the row
    itself. ``key`` may be empty for one global axis.

    ``df`` is read once, with all its columns. For a plain table, of which later steps use few columns, ``once=False``
    reads it twice, each time only what is used.
    """
    keys, orders = as_list(key), as_list(order)
    running, backward, stats = dict(running or {}), dict(backward or {}), dict(stats or {})
    position = F.col(orders[0]) if len(orders) == 1 else F.struct(*orders)

    def total(kind: str, value: Column, reverse: bool) -> Column:
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(value, F.when(value.isNotNull(), position))
        return _TOTALS[kind](value)

    values = {f"_v{n}": v for n, (_, v) in enumerate([*running.values(), *backward.values(), *stats.values()])}
    names = iter(values)
    running, backward, stats = ({o: (k, F.col(next(names))) for o, (k, _) in specs.items()} for specs in (running, backward, stats))
    aggregates = (
        [total(k, v, False).alias(f"_f_{o}") for o, (k, v) in running.items()]
        + [total(k, v, True).alias(f"_b_{o}") for o, (k, v) in backward.items()]
        + [total(k, v, False).alias(f"_s_{o}") for o, (k, v) in stats.items()]
    )
    place = F.struct(*keys, F.col(block).alias(BLOCK)).alias(_PLACE)
    carried = [*df.columns, *[v.alias(n) for n, v in values.items()]]
    if once:
        # Both uses of the rows read one shuffle. That takes equal plans below it: rows travel as one value that no
        # use of them narrows, and the key is never null, so that joining on it filters nothing.
        packed = df.select(place, F.array(F.struct(*carried)).alias(_ROW)).repartition(_PLACE)
        rows = packed.select(_PLACE, F.element_at(_ROW, 1).alias(_ROW)).select(_PLACE, f"{_ROW}.*")
    else:
        rows = df.select(place, *carried)
    totals = rows.groupBy(_PLACE).agg(*aggregates).select("*", f"{_PLACE}.*")
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    axis = F.col(BLOCK)
    earlier = per_key.orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    later = per_key.orderBy(axis.desc()).rowsBetween(Window.unboundedPreceding, -1)

    def merged(kind: str, name: str, window: WindowSpec) -> Column:
        # Counts of blocks add up.
        return _running_local("sum" if kind == "count" else kind, F.col(name), window)

    carries = totals.select(
        _PLACE,
        *[merged(k, f"_f_{o}", earlier).alias(f"_c_{o}") for o, (k, _) in running.items()],
        *[merged(k, f"_b_{o}", later).alias(f"_d_{o}") for o, (k, _) in backward.items()],
        *[merged(k, f"_s_{o}", per_key).alias(o) for o, (k, _) in stats.items()],
    )

    in_block = Window.partitionBy(_PLACE)
    upto = 0 if inclusive else -1
    forward_w = in_block.orderBy(*orders).rowsBetween(Window.unboundedPreceding, upto)
    reverse_w = in_block.orderBy(*[F.col(o).desc() for o in orders]).rowsBetween(
        Window.unboundedPreceding, upto
    )
    local = rows.select(
        "*",
        *[_running_local(k, v, forward_w).alias(f"_l_{o}") for o, (k, v) in running.items()],
        *[_running_local(k, v, reverse_w).alias(f"_m_{o}") for o, (k, v) in backward.items()],
    )
    return local.join(carries, _PLACE).select(
        *df.columns,
        *[_combine(k, F.col(f"_l_{o}"), F.col(f"_c_{o}")).alias(o) for o, (k, _) in running.items()],
        *[_combine(k, F.col(f"_m_{o}"), F.col(f"_d_{o}")).alias(o) for o, (k, _) in backward.items()],
        *stats,
    )


def positions(
    df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], block: str, out: str
) -> DataFrame:
    """Dense 0-based position of each row within its key, without a per-key sort."""
    ranked = two_phase(df, key, order, running={out: ("count", F.lit(1))}, inclusive=False, block=block)
    return ranked.withColumn(out, F.col(out).cast("bigint")).drop(block)


def _folds(specs: Mapping[str, Spec], order: Column) -> list[Column]:
    folds = []
    for out, (kind, value) in specs.items():
        if kind == "first":
            folds.append(F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))).alias(out))
        else:
            folds.append(_TOTALS[kind](value).alias(out))
    return folds


def _refolds(specs: Mapping[str, Spec]) -> list[Column]:
    folds = []
    for out, (kind, _) in specs.items():
        if kind == "first":
            folds.append(F.min(out).alias(out))
        else:
            folds.append((F.sum if kind in ("sum", "count") else _TOTALS[kind])(out).alias(out))
    return folds


def _unwrap(specs: Mapping[str, Spec]) -> list[Column]:
    return [
        F.col(f"{out}.v").alias(out) if kind == "first" else F.col(out)
        for out, (kind, _) in specs.items()
    ]


def runs(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    value: str,
    specs: Mapping[str, Spec] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Maximal runs of equal ``value`` over consecutive positions.

    Returns ``key, value, first_pos, last_pos`` (inclusive) and the folded ``specs``
    (``sum``/``count``/``min``/``max``/``first``).
    """
    keys, width, specs = as_list(key), width or ROWS_PER_BLOCK, dict(specs or {})
    blocked = with_block(df, order, width)
    same = Window.partitionBy(*keys, BLOCK, value).orderBy(order)
    partial = (
        blocked.withColumn("_grp", F.col(order) - F.row_number().over(same))
        .groupBy(*keys, BLOCK, value, "_grp")
        .agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), *_folds(specs, F.col(order)))
    )
    touches = (F.col("first_pos") == F.col(BLOCK) * width) | (
        F.col("last_pos") == (F.col(BLOCK) + 1) * width - 1
    )
    lane = Window.partitionBy(*keys, value, _LANE).orderBy("first_pos")
    return (
        partial.withColumn(_LANE, F.when(touches, F.lit(-1)).otherwise(F.col(BLOCK)))
        .withColumn("_new", F.coalesce((F.col("first_pos") - F.lag("last_pos").over(lane) != 1).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(lane))
        .groupBy(*keys, value, _LANE, "_run")
        .agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), *_refolds(specs))
        .select(*keys, value, "first_pos", "last_pos", *_unwrap(specs))
    )


def merge_intervals(
    df: DataFrame,
    key: str | Sequence[str],
    start: str,
    end: str,
    max_gap: int = 0,
    specs: Mapping[str, Spec] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Union of half-open integer intervals whose gap is at most ``max_gap``.

    Intervals are cut at block borders, equal starts are pre-aggregated, groups are built per
    block, and only groups within ``max_gap`` of a border are stitched per key. ``specs`` fold the
    original intervals of a group, each counted once.
    """
    keys, specs = as_list(key), dict(specs or {})
    width = max(width or ROWS_PER_BLOCK, max_gap + 1)
    s, e, b = F.col(start), F.col(end), F.col(BLOCK)
    head = b == int_div(s, width)
    pieces = df.select(
        "*",
        F.explode(F.sequence(int_div(s, width), int_div(F.greatest(s, e - 1), width))).alias(BLOCK),
    ).withColumns({"_ps": F.greatest(s, b * width), "_pe": F.least(e, (b + 1) * width)})
    once = {o: (k, F.when(head, v)) for o, (k, v) in specs.items()}
    starts = pieces.groupBy(*keys, BLOCK, "_ps").agg(
        F.max("_pe").alias("_pe"), *_folds(once, F.struct(s, e))
    )

    def grouped(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_ps")
        reach = F.max("_pe").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return (
            frame.withColumn("_new", F.coalesce((F.col("_ps") - reach > max_gap).cast("int"), F.lit(1)))
            .withColumn("_grp", F.sum("_new").over(w))
            .groupBy(*by, "_grp")
            .agg(F.min("_ps").alias("_ps"), F.max("_pe").alias("_pe"), *_refolds(specs))
            .drop("_grp")
        )

    near = (F.col("_ps") - b * width <= max_gap) | ((b + 1) * width - F.col("_pe") <= max_gap)
    partial = grouped(starts, [*keys, BLOCK]).withColumn(_LANE, F.when(near, F.lit(-1)).otherwise(b))
    return grouped(partial, [*keys, _LANE]).select(
        *keys, F.col("_ps").alias(start), F.col("_pe").alias(end), *_unwrap(specs)
    )


SALTS = 16


def join_per_key(
    rows: DataFrame, small: DataFrame, key: str | Sequence[str], spread: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join rows to a one-row-per-key table without sending a hot key to one task.

    The per-key table is repeated once per salt and rows carry the salt of their ``spread`` column.
    Spark still turns this into a broadcast join when the measured size allows it.
    """
    keys, salts = as_list(key), salts or SALTS
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    spread_rows = rows.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    return join_null_safe(spread_rows, salted, [*keys, "_salt"], how).drop("_salt")

"""Serial rules as set operations: running counts, first-wins and serial ids.

The reference handles one request at a time, so "is there stock left",
"is this the first such link" and "which id comes next" depend on the
requests accepted before. All three reduce to one primitive: for each row,
how many flagged rows of the same key group come earlier in ``req_seq``
order (``prefix_count``).

A plain ``Window.partitionBy(key).orderBy(req_seq)`` would put a whole key
group in one task, so a popular lot holding a third of the requests would be
one task. ``prefix_count`` splits every group into blocks of at most
``block`` consecutive sequence numbers:

1. count flagged rows per (key, block) — a grouped aggregate with map-side
   partial aggregation;
2. running sums of those counts, in two levels: blocks inside a superblock of
   ``block`` blocks, and superblocks inside the key;
3. running count inside each (key, block) — a window whose partitions hold
   at most ``block`` rows;
4. add 2. and 3. with a join on (key, block).

No window partition holds more than ``block`` rows (the last level: 2**63 /
``block``**2), however the keys and however far apart the sequence numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 20


def prefix_count(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column | str,
                 out_col: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out_col``: number of rows of the same ``keys`` group with a smaller
    ``order_col`` whose ``flag`` is true. ``order_col`` must be unique and
    non-negative (``req_seq``)."""
    keys = list(keys)
    cols = df.columns
    f = F.col(flag) if isinstance(flag, str) else flag
    # Keys as plain non-null columns (typed default + is-null flag): NULL keys
    # still form their own group, and the window and the join below share
    # one hash partitioning, so the joined side is not shuffled again.
    norm = []
    for i, k in enumerate(keys):
        norm += [F.coalesce(F.col(k), _zero(df.schema[k].dataType)).alias(f"_pc_v{i}"),
                 F.col(k).isNull().alias(f"_pc_z{i}")]
    nk = [c for i in range(len(keys)) for c in (f"_pc_v{i}", f"_pc_z{i}")]
    d = df.select("*", *norm, F.expr(f"`{order_col}` div {int(block)}").cast("bigint").alias("_pc_blk"),
                  F.when(f, F.lit(1)).otherwise(F.lit(0)).alias("_pc_f"))
    per_block = d.groupBy(*nk, "_pc_blk").agg(F.sum("_pc_f").alias("_pc_n"))
    per_block = per_block.withColumn("_pc_sup", F.expr(f"_pc_blk div {int(block)}").cast("bigint"))
    before = (Window.unboundedPreceding, -1)
    w_blk = Window.partitionBy(*nk, "_pc_sup").orderBy("_pc_blk").rowsBetween(*before)
    w_sup = Window.partitionBy(*nk).orderBy("_pc_sup").rowsBetween(*before)
    supers = per_block.groupBy(*nk, "_pc_sup").agg(F.sum("_pc_n").alias("_pc_m")).select(
        *nk, "_pc_sup", F.coalesce(F.sum("_pc_m").over(w_sup), F.lit(0)).alias("_pc_far"))
    offsets = per_block.withColumn("_pc_near", F.coalesce(F.sum("_pc_n").over(w_blk), F.lit(0))) \
        .join(supers, [*nk, "_pc_sup"]).select(*nk, "_pc_blk", (F.col("_pc_near") + F.col("_pc_far")).alias("_pc_off"))
    w_in = Window.partitionBy(*nk, "_pc_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", F.coalesce(F.sum("_pc_f").over(w_in), F.lit(0)).alias("_pc_in"))
    return d.join(offsets, [*nk, "_pc_blk"], "left").select(
        *cols, (F.coalesce(F.col("_pc_off"), F.lit(0)) + F.col("_pc_in")).cast("bigint").alias(out_col))


def _zero(dtype) -> Column:
    """A non-null stand-in of the key's type (paired with an is-null flag)."""
    name = dtype.typeName()
    if name == "string":
        return F.lit("")
    if name == "boolean":
        return F.lit(False)
    if name in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("1970-01-01").cast(dtype)
    return F.lit(0).cast(dtype)


def first_in_group(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column | str,
                   out_col: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``out_col`` is true when no earlier flagged row shares the keys."""
    tmp = "_fig_n"
    return prefix_count(df, keys, order_col, flag, tmp, block) \
        .withColumn(out_col, F.col(tmp) == 0).drop(tmp)


def max_id(table: DataFrame, id_col: str) -> Column:
    """Largest existing id as a scalar subquery (0 for an empty table)."""
    return table.select(F.coalesce(F.max(id_col).cast("bigint"), F.lit(0).cast("bigint"))).scalar()


def allocate_ids(df: DataFrame, accepted: Column | str, order_col: str, table: DataFrame | None,
                 id_col: str, out_col: str = "new_id", block: int = DEFAULT_BLOCK,
                 base: int | None = None) -> DataFrame:
    """K5: dense serial ids for accepted rows, in ``order_col`` order, after the
    table's largest id (or after ``base`` when the caller tracks the last id,
    which saves a scan of the table); NULL for rejected rows. Only accepted
    rows are moved to be counted; ``df`` is read twice."""
    a = F.coalesce(F.col(accepted) if isinstance(accepted, str) else accepted, F.lit(False))
    ranked = prefix_count(df.where(a), [], order_col, F.lit(True), "_ai_rank", block)
    start = F.lit(base).cast("bigint") if base is not None else max_id(table, id_col)
    return ranked.withColumn(out_col, start + F.col("_ai_rank") + 1).drop("_ai_rank") \
        .unionAll(df.where(~a).withColumn(out_col, F.lit(None).cast("bigint")))


def last_per_key(df: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """Keep, per key, the row with the largest ``order_col`` (arg-max
    aggregate, map-side combined: a hot key costs one row per task)."""
    key = list(key)
    payload = [c for c in df.columns if c not in key]
    packed = F.max(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in payload if c != order_col]))
    g = df.groupBy(*key).agg(packed.alias("_last"))
    return g.select(*key, F.col("_last._o").alias(order_col),
                    *[F.col(f"_last.{c}").alias(c) for c in payload if c != order_col])



# ----------------------------------------------------------------- ordered scans in blocks

def _blocked(df: DataFrame, keys: Sequence[str], order_col: str, block: int) -> tuple[DataFrame, list[str]]:
    """``df`` with non-null key columns and the block ``_b`` of each row; and the key columns' names."""
    norm, names = [], []
    for i, k in enumerate(keys):
        norm += [F.coalesce(F.col(k), _zero(df.schema[k].dataType)).alias(f"_k{i}"), F.col(k).isNull().alias(f"_z{i}")]
        names += [f"_k{i}", f"_z{i}"]
    return df.select("*", *norm, F.expr(f"`{order_col}` div {int(block)}").cast("bigint").alias("_b")), names


def last_before(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column | str, value: Column | str,
                out_col: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out_col``: ``value`` (not null) of the latest earlier row of the same ``keys`` group whose ``flag`` is true.

    In blocks like ``prefix_count``: the latest flagged row of each block, the
    latest of the blocks before, and the latest before a row inside its block.
    """
    cols = df.columns
    f = F.col(flag) if isinstance(flag, str) else flag
    v = F.col(value) if isinstance(value, str) else value
    d, nk = _blocked(df, keys, order_col, block)
    d = d.withColumn("_v", F.when(f, v))
    per = d.where(F.col("_v").isNotNull()).groupBy(*nk, "_b").agg(F.max(F.struct(F.col(order_col).alias("o"), "_v")).alias("_m"))
    # Blocks without a flagged row are not in ``per``; each row looks up the latest block before its own.
    every = d.select(*nk, "_b").distinct().join(per, [*nk, "_b"], "left").withColumn("_s", F.expr(f"_b div {int(block)}").cast("bigint"))
    before = (Window.unboundedPreceding, -1)
    near = F.max("_m").over(Window.partitionBy(*nk, "_s").orderBy("_b").rowsBetween(*before))
    sup = every.groupBy(*nk, "_s").agg(F.max("_m").alias("_ms"))
    sup = sup.select(*nk, "_s", F.max("_ms").over(Window.partitionBy(*nk).orderBy("_s").rowsBetween(*before)).alias("_far"))
    blocks = every.withColumn("_near", near).join(sup, [*nk, "_s"]).select(*nk, "_b", F.coalesce(F.col("_near._v"), F.col("_far._v")).alias("_early"))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*nk, "_b").orderBy(order_col).rowsBetween(*before))
    return d.withColumn("_in", inside).join(blocks, [*nk, "_b"], "left").select(
        *cols, F.coalesce("_in", "_early").alias(out_col))


def stock_before(events: DataFrame, key: str | Sequence[str], order_col: str, delta: str, start: str, out_col: str,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out_col``: the stock that an event finds, when takes from an empty stock are refused.

    Events of a ``key`` in order: ``delta`` +1 a return, -1 an attempt to take,
    0 a look. A refused take leaves the stock as it is, so the stock is a walk
    held at 0: W + max(0, -min W) for the walk W of all deltas from ``start``
    (0 or more), the minimum over the events before. Sums and minima of a walk
    combine block by block: (s, m) and (s', m') make (s + s', min(m, s + m')).
    """
    cols = events.columns
    d, nk = _blocked(events, [key] if isinstance(key, str) else key, order_col, block)
    w_in = Window.partitionBy(*nk, "_b").orderBy(order_col)
    d = d.withColumn("_run", F.sum(delta).over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    before = (Window.unboundedPreceding, -1)
    d = d.withColumn("_low", F.min("_run").over(w_in.rowsBetween(*before)))

    def put_behind(parts: DataFrame, at: str, within: list[str], tag: str) -> DataFrame:
        """Sum of the parts before each part (_at_tag), and the walk's minimum in them (_min_tag)."""
        w = Window.partitionBy(*within).orderBy(at).rowsBetween(*before)
        parts = parts.withColumn(f"_at_{tag}", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
        return parts.withColumn(f"_min_{tag}", F.min(F.col(f"_at_{tag}") + F.col("_least")).over(w))

    blocks = d.groupBy(*nk, "_b").agg(F.sum(delta).alias("_sum"), F.min("_run").alias("_least")) \
        .withColumn("_s", F.expr(f"_b div {int(block)}").cast("bigint"))
    blocks = put_behind(blocks, "_b", [*nk, "_s"], "near")
    supers = blocks.groupBy(*nk, "_s").agg(F.min(F.col("_at_near") + F.col("_least")).alias("_least"), F.sum("_sum").alias("_sum"))
    supers = put_behind(supers, "_s", nk, "far").select(*nk, "_s", "_at_far", "_min_far")
    blocks = blocks.join(supers, [*nk, "_s"]).select(
        *nk, "_b", (F.col("_at_far") + F.col("_at_near")).alias("_at"),
        F.least("_min_far", F.col("_at_far") + F.col("_min_near")).alias("_min"))
    walk = F.col(start) + F.col("_at") + F.col("_run") - F.col(delta)
    low = F.least(F.lit(0), F.col(start) + F.col("_min"), F.col(start) + F.col("_at") + F.col("_low"))
    return d.join(blocks, [*nk, "_b"]).select(*cols, (walk - low).cast("bigint").alias(out_col))


#: Steps of one key that one task composes at a time.
STEP_BLOCK = 1 << 9


def scan_states(df: DataFrame, key: str, order_col: str, step: str, start: str, n_states: int, out_col: str,
                block: int = STEP_BLOCK) -> DataFrame:
    """Add ``out_col``: the state (0 to n_states - 1) that each row of a ``key`` finds.

    ``step`` is the row's transition as an array (next state for each state),
    ``start`` the key's opening state. Transitions compose to transitions, so
    blocks of rows are composed first, blocks of blocks next, and so on; the
    states then come down the same levels. No task holds more than ``block``
    steps of a key at once.
    """
    cols = df.columns
    identity = F.array(*[F.lit(i) for i in range(n_states)])
    top = df.agg(F.max(order_col)).first()[0]
    levels = [df.select(F.col(key).alias("_k"), F.col(order_col).cast("bigint").alias("_o"), F.col(step).alias("_f"), F.col(start).alias("_start"))]
    sizes = 1
    while top is not None and top >= block ** sizes:
        rows = levels[-1].withColumn("_p", F.expr(f"_o div {int(block)}"))
        steps = F.sort_array(F.collect_list(F.struct("_o", "_f")))
        levels.append(rows.groupBy("_k", "_p").agg(steps.alias("_steps"), F.first("_start").alias("_start")).select(
            "_k", F.col("_p").alias("_o"),
            F.aggregate("_steps", identity, lambda a, x: F.transform(a, lambda s: F.element_at(x["_f"], s + 1))).alias("_f"), "_start"))
        sizes += 1

    def down(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """(_k, _o, _state) of ``rows`` from the states that their blocks (_k, _p) find."""
        grouped = rows.groupBy("_k", F.expr(f"_o div {int(block)}").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("_o", "_f"))).alias("_steps"))
        seen = F.aggregate("_steps", F.array(F.col("_head")), lambda a, x: F.concat(a, F.array(F.element_at(x["_f"], F.element_at(a, -1) + 1))))
        return grouped.join(heads, ["_k", "_p"]).withColumn("_seen", seen).select(
            "_k", F.explode(F.arrays_zip(F.transform("_steps", lambda x: x["_o"]).alias("_o"), F.slice("_seen", F.lit(1), F.size("_steps")).alias("_state"))).alias("_x")) \
            .select("_k", "_x._o", "_x._state")

    heads = levels[-1].groupBy("_k", F.expr(f"_o div {int(block)}").alias("_p")).agg(F.first("_start").alias("_head"))
    for rows in reversed(levels):
        found = down(rows, heads)
        heads = found.select("_k", F.col("_o").alias("_p"), F.col("_state").alias("_head"))
    return df.join(found.select(F.col("_k").alias(key), F.col("_o").alias(order_col), F.col("_state").alias(out_col)), [key, order_col], "left") \
        .select(*cols, out_col)

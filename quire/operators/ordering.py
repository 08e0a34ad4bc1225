"""Per-key ordered numbering and previous-row lookup that stay parallel when
one key holds a large share of the rows.

A plain ``row_number() over (partition by key order by seq)`` sends every row
of a key to one task. Here the order column is cut into fixed-width chunks;
the window runs per (key, chunk), whose size is bounded by the chunk width,
and a per-(key, chunk) summary carries counts / last rows across chunk borders.
The carry is cut in the same way: chunks belong to blocks of ``FAN`` chunks, and
summaries are carried within a block, then from block to block. So no window has
more rows than the chunk width or ``FAN``, also where the order values of a key
are far apart (microseconds, ids of a whole cluster) and a chunk holds few rows.
Chunks come from the value of the order column (not from partition ids), so a
recomputed task yields the same numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

CHUNK = "_q_chunk"
# Rows of one key per chunk at most (order values per chunk, the order being
# unique per key): large enough that few keys need more than one chunk,
# small enough that one chunk is an ordinary task (and, in V5, an ordinary
# pandas group).
DEFAULT_CHUNK = 1 << 20
# Chunks of a block. Order values are below 2^63, so a key has 2^43 chunks of the
# default width at most and 2^21 blocks.
FAN = 1 << 22


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _floor_div(name: str, width: int) -> Column:
    """floor(name / width) in exact integer arithmetic (``div`` truncates toward
    zero, so negatives are shifted)."""
    w = int(width)
    return F.when(F.col(name) >= 0, F.expr(f"`{name}` div {w}")) \
            .otherwise(F.expr(f"-((-`{name}` - 1) div {w}) - 1")).cast("bigint")


def with_chunk(df: DataFrame, order: str, chunk_width: int) -> DataFrame:
    """Adds the chunk number floor(order / chunk_width)."""
    return df.withColumn(CHUNK, _floor_div(order, chunk_width))


def _carry(per: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """From one row per (key, chunk) with ``_q_n`` (a count) and ``_q_last`` (a row
    or NULL): ``_q_off``, the sum of the counts of the key's earlier chunks, and
    ``_q_prev``, their last row that is not NULL."""
    def earlier(df, part, at):
        before = Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return F.last("_q_last", ignorenulls=True).over(before), F.coalesce(F.sum("_q_n").over(before), F.lit(0))
    per = per.withColumn("_q_block", _floor_div(CHUNK, fan))
    prev, off = earlier(per, [*keys, "_q_block"], CHUNK)
    inside = per.select(*keys, CHUNK, "_q_block", prev.alias("_q_prev"), off.alias("_q_off")).alias("_i")
    blocks = per.groupBy(*keys, "_q_block").agg(
        F.max_by("_q_last", F.when(F.col("_q_last").isNotNull(), F.col(CHUNK))).alias("_q_last"), F.sum("_q_n").alias("_q_n"))
    prev, off = earlier(blocks, keys, "_q_block")
    blocks = blocks.select(*keys, "_q_block", prev.alias("_q_bprev"), off.alias("_q_boff")).alias("_b")
    j = inside.join(blocks, _join_on(inside, blocks, [*keys, "_q_block"]), "inner")
    return j.select(*[F.col(f"_i.{k}").alias(k) for k in keys], F.col(f"_i.{CHUNK}").alias(CHUNK),
                    F.coalesce("_i._q_prev", "_b._q_bprev").alias("_q_prev"), (F.col("_i._q_off") + F.col("_b._q_boff")).alias("_q_off"))


def even_chunks(df: DataFrame, key: str, order: str, rows: int) -> tuple[DataFrame, int | None]:
    """Adds a chunk number per key, counted from 0 in ``order``, with ``rows`` rows
    of a key in a chunk at most, whatever the values of ``order`` are; returns the
    largest number too (None for no rows). Rows are sorted by (key, order) across
    partitions and numbered where they lie; the numbers are written, so a
    recomputed task reads the same ones. ``df`` should be a written table."""
    n = df.count()
    if n <= rows:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint")), 0 if n else None
    # a partition's number is above 2^33 times its index, plus the row's place
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn(
        "_q_raw", F.shiftright(at, 33) * F.lit((1 << 33) // rows + 1) + F.floor(place / F.lit(rows)))
    dealt = cut_lineage(dealt, "chunks")
    # a chunk ends where its place range, its partition or its key ends
    numbers = dealt.select(key, "_q_raw").distinct().withColumn(
        CHUNK, (F.row_number().over(Window.partitionBy(key).orderBy("_q_raw")) - 1).cast("bigint"))
    numbers = cut_lineage(numbers, "chunk-numbers")
    top = numbers.agg(F.max(CHUNK)).first()[0]
    return dealt.join(numbers, [key, "_q_raw"]).drop("_q_raw"), int(top)


def _join_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def ordered_rank(df: DataFrame, key, order: str, out: str, chunk_width: int = DEFAULT_CHUNK, fan: int = FAN) -> DataFrame:
    """Adds ``out`` = row_number() over (partition by key order by order).

    ``order`` must be unique within a key (ties would make numbers arbitrary).
    """
    keys = _keys(key)
    d = with_chunk(df, order, chunk_width)
    counts = d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_q_n")).withColumn("_q_last", F.lit(None).cast("boolean"))
    o = _carry(counts, keys, fan).alias("_o")
    d = d.alias("_d")
    joined = d.join(o, _join_on(d, o, keys + [CHUNK]), "inner").select("_d.*", "_o._q_off")
    w = Window.partitionBy(*keys, CHUNK).orderBy(order)
    return joined.withColumn(out, (F.col("_q_off") + F.row_number().over(w)).cast("bigint")).drop(CHUNK, "_q_off")


def ordered_lag(df: DataFrame, key, order: str, cols: list[str], prefix: str = "prev_",
                chunk_width: int = DEFAULT_CHUNK, fan: int = FAN) -> DataFrame:
    """Adds ``prefix+c`` = lag(c) over (partition by key order by order) for each c."""
    keys = _keys(key)
    d = with_chunk(df, order, chunk_width)
    packed = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*keys, CHUNK).orderBy(order)
    d = d.withColumn("_q_in", F.lag(packed).over(w))
    last = d.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.col(order)).alias("_q_last")).withColumn("_q_n", F.lit(0).cast("bigint"))
    p = _carry(last, keys, fan).alias("_p")
    d = d.alias("_d")
    joined = d.join(p, _join_on(d, p, keys + [CHUNK]), "inner").select("_d.*", "_p._q_prev")
    joined = joined.withColumn("_q_lag", F.coalesce(F.col("_q_in"), F.col("_q_prev")))
    for c in cols:
        joined = joined.withColumn(prefix + c, F.col("_q_lag")[c])
    return joined.drop(CHUNK, "_q_in", "_q_prev", "_q_lag")


def last_wins_by_key(df: DataFrame, key, seq: str) -> DataFrame:
    """A4: a key -> row map where a later row replaces an earlier one.

    ``max_by`` is a partial aggregate: each task keeps one row per key before
    the shuffle, so a hot key ships one row per task, not all of its rows.
    """
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.max_by(packed, F.col(seq)).alias("_q_row"))
    return out.select(*keys, *[F.col("_q_row")[c].alias(c) for c in rest])


def ordered_last(df: DataFrame, key, order: str, cols: list[str], flag: str, prefix: str = "last_",
                 chunk_width: int = DEFAULT_CHUNK, fan: int = FAN) -> DataFrame:
    """Adds ``prefix+c``: value of ``c`` on the latest row at or before this
    one (same key, by ``order``) whose ``flag`` is true, plus
    ``prefix+'count'``: how many flagged rows that is (an as-of lookup and a
    running count, both chunked like ``ordered_rank``)."""
    keys = _keys(key)
    d = with_chunk(df, order, chunk_width)
    packed = F.when(F.col(flag), F.struct(*[F.col(c) for c in cols]))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_q_in", F.last(packed, ignorenulls=True).over(inside)) \
         .withColumn("_q_cnt", F.count_if(F.col(flag)).over(inside))
    # one summary row per (key, chunk), flagged or not, so a chunk without
    # flagged rows still inherits from the chunks before it
    per = d.groupBy(*keys, CHUNK).agg(
        F.max_by(packed, F.when(F.col(flag), F.col(order))).alias("_q_last"),
        F.count_if(F.col(flag)).alias("_q_n"))
    carry = _carry(per, keys, fan)
    c = carry.alias("_c")
    d = d.alias("_d")
    j = d.join(c, _join_on(d, c, keys + [CHUNK]), "inner").select("_d.*", "_c._q_prev", "_c._q_off")
    j = j.withColumn("_q_val", F.coalesce(F.col("_q_in"), F.col("_q_prev")))
    out = j
    for cname in cols:
        out = out.withColumn(prefix + cname, F.col("_q_val")[cname])
    out = out.withColumn(prefix + "count", (F.col("_q_cnt") + F.coalesce(F.col("_q_off"), F.lit(0))).cast("bigint"))
    return out.drop(CHUNK, "_q_in", "_q_cnt", "_q_prev", "_q_off", "_q_val")

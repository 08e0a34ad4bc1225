"""Sharding by minimax contiguous partition (operator 9).

Documents with equal texts form an atomic group. Groups are put in the order of
a digest of their text and cut into ``shards`` contiguous runs so that the
largest run is as small as any such cut can make it. The smallest feasible
capacity is found by binary search; a capacity is checked greedily: fill a
shard up to the capacity, cut, go on.

The driver never holds the groups. The digest's first two bytes name one of
65,536 chunks; the driver keeps the totals of the chunks (three numbers each,
whatever the size of the corpus) and asks for the groups of those few chunks in
which a cut of the capacity under test falls, and only when the totals leave
the answer open. With the capacity found, each shard is filled to the mean of
what is left, where the rest still fits, so shards are near equal and none
stays empty needlessly; no shard exceeds the smallest feasible capacity.

Slots are places in (shard, digest, doc_id) order, computed from running sums
per chunk and, inside a group, per salted part, so a group with a third of all
rows is dealt out.

Defined results: a null text counts as empty (its group is the empty text);
repeated rows get a slot each; null ids are allowed and sort first; an empty
table gives an empty result; with fewer groups than shards some shards are
empty; other columns pass through ``assign`` by joining on doc_id if wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, text_or_empty

CHUNKS = 1 << 16
#: Parts that a group's rows are dealt into for ranking.
SALTS = 128
#: Bytes that a document takes besides its text.
OVERHEAD = 16


class _Order:
    """The ordered groups as the driver sees them: exact totals of chunks, and
    the groups of those chunks that were asked for."""

    def __init__(self, totals: pd.DataFrame, fetch):
        size, rows = np.zeros(CHUNKS, np.int64), np.zeros(CHUNKS, np.int64)
        size[totals.chunk], rows[totals.chunk] = totals.bytes, totals.rows
        self.end, self.row_end = size.cumsum(), rows.cumsum()
        self.start, self.row_start = self.end - size, self.row_end - rows
        self.total, self.largest = int(self.end[-1]), int(totals.largest.max()) if len(totals) else 0
        self.fetch, self.known = fetch, {}

    def learn(self, chunks) -> None:
        chunks = sorted(set(chunks) - self.known.keys())
        got = self.fetch([int(c) for c in chunks])
        for c, g in got.groupby("chunk"):
            g = g.sort_values("c_bytes")
            self.known[int(c)] = (g.c_bytes.to_numpy(), g.c_rows.to_numpy())

    def reach(self, target: int) -> tuple[int, int, int | None]:
        """Bounds on the last group end at or before ``target``, and the chunk
        that would have to be known for both to be equal."""
        c = int(np.searchsorted(self.end, target, "right"))
        if c >= CHUNKS:
            return self.total, self.total, None
        base = int(self.start[c])
        if c not in self.known:
            return base, min(target, int(self.end[c])), c if target > base else None
        ends = self.known[c][0]
        i = int(np.searchsorted(ends, target - base, "right"))
        at = base + (int(ends[i - 1]) if i else 0)
        return at, at, None

    def row_of(self, at: int) -> int:
        """Rows before the group end ``at``."""
        c = int(np.searchsorted(self.end, at, "right"))
        if c >= CHUNKS:
            return int(self.row_end[-1])
        if at == self.start[c]:
            return int(self.row_start[c])
        ends, rows = self.known[c]
        return int(self.row_start[c] + rows[np.searchsorted(ends, at - self.start[c])])

    def fits(self, at: int, capacity: int, shards: int) -> bool:
        """Can all from ``at`` on go into ``shards`` shards of ``capacity``?"""
        while True:
            low = high = at
            asked: list[int] = []
            for _ in range(shards):
                low = max(low, self.reach(low + capacity)[0])
                upper = self.reach(high + capacity)
                high = max(high, upper[1])
                if upper[2] is not None:
                    asked.append(upper[2])
                c = self.reach(low + capacity)[2]
                if c is not None:
                    asked.append(c)
            if low >= self.total:
                return True
            if high < self.total:
                return False
            self.learn(asked)

    def exact(self, target: int) -> int:
        low, _, c = self.reach(target)
        if c is not None:
            self.learn([c])
            low = self.reach(target)[0]
        return low


def smallest_capacity(order: _Order, shards: int) -> int:
    low = max(order.largest, -(-order.total // shards))
    high = max(low, min(order.total, -(-order.total // shards) + order.largest))
    while low < high:
        mid = (low + high) // 2
        if order.fits(0, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(order: _Order, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and where each shard after the first begins."""
    capacity = smallest_capacity(order, shards)
    at, found = 0, []
    for left in range(shards, 1, -1):
        mean = -(-(order.total - at) // left)
        near = order.exact(at + min(capacity, mean))
        if not (near > at and order.fits(near, capacity, left - 1)):
            near = order.exact(at + capacity)
        at = near
        found.append(at)
    return capacity, found


def assign(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    t = text_or_empty(text)
    rows = cut_lineage(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 16).alias("digest"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int").alias("salt")), "shard-rows")
    salted = rows.groupBy("digest", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    by_group = Window.partitionBy("digest").orderBy("salt")
    salted = salted.withColumn("offset", F.sum("rows").over(by_group) - F.col("rows"))
    groups = salted.groupBy("digest").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("salt", "offset"))).alias("offsets"))
    groups = groups.withColumn("chunk", F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"))
    in_chunk = Window.partitionBy("chunk").orderBy("digest")
    groups = cut_lineage(groups.select("*", F.sum("bytes").over(in_chunk).alias("c_bytes"),
                                       F.sum("rows").over(in_chunk).alias("c_rows")), "shard-groups")

    totals = groups.groupBy("chunk").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
                                         F.max("bytes").alias("largest")).toPandas()
    order = _Order(totals, lambda chunks: groups.where(F.col("chunk").isin(chunks)).select(
        "chunk", "c_bytes", "c_rows").toPandas())
    found = cuts(order, shards)[1]
    first_rows = [0] + [order.row_of(at) for at in found]

    # 65,536 rows of two numbers each, for any corpus
    starts = spark.createDataFrame(pd.DataFrame({"chunk": np.arange(CHUNKS, dtype=np.int32),
                                                 "b0": order.start, "r0": order.row_start}))
    placed = groups.join(F.broadcast(starts), "chunk")
    begins = F.col("b0") + F.col("c_bytes") - F.col("bytes")
    shard = F.size(F.filter(F.array(*[F.lit(int(x)) for x in found]).cast("array<bigint>"), lambda x: x <= begins)) \
        if found else F.lit(0)
    placed = placed.select("digest", shard.cast("int").alias("shard"), (F.col("r0") + F.col("c_rows") - F.col("rows")).alias("row"),
                           F.explode("offsets").alias("salt", "offset"))
    placed = placed.select("digest", "salt", "shard", (F.col("row") + F.col("offset") - F.get(
        F.array(*[F.lit(int(x)) for x in first_rows]).cast("array<bigint>"), F.col("shard"))).alias("first"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id")) - 1)
    return ranked.join(placed, ["digest", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: int, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` below ``path``, one folder a shard (shard=0, shard=1, ...),
    and return the assignment. Keys must be unique here."""
    found = cut_lineage(assign(docs, shards, text, key), "shard-plan")
    where = found.select(F.col("doc_id").alias("k_"), "shard", "slot")
    docs.join(where, F.col(key) == F.col("k_")).drop("k_").write.partitionBy("shard").parquet(path)
    return found

"""Hard-negative mining (operator 12), by slot-decomposed selection.

A row's score is its integer inner product with an anchor. An anchor's
positives are its best rows of the same label. Each positive's score is the
upper limit of a window, and the windows of one anchor overlap. So the limits,
highest first, split the scores into disjoint slots: slot j holds the scores at
or below limit j and above limit j + 1 (the last one has no lower end). Every
task keeps the first ``k`` rows of each (anchor, slot) only; the tasks' lists
are ranked once more per (anchor, slot). The first ``k`` rows at or below limit
j are then the first ``k`` of slot j followed by those at or below limit j + 1:
one descending suffix merge of short lists answers all windows, and the lower
limit cuts the tail of each list.

Anchors are taken in blocks of about ``BLOCK`` (their vectors, and later their
limits, are sent to all tasks, and that is all that is ever broadcast); for each
block the table is read twice, once for positives and once for negatives.

Defined results: rows without an id, a label or a vector, or with a null or
non-finite component, take no part. Rows whose vectors differ in length have no
score. Rows that repeat an id are rows of their own, but a row is no positive of
an anchor with its own id; a repeated anchor row has its own rows of result.
Scores past 64 bits are an error. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, shared_path

#: Anchors of one block (about).
BLOCK = 16_384
#: Anchors and rows whose scores are in memory at a time.
TILE = (1_024, 4_096)
#: Below this, sums of products of whole float64 numbers are exact.
EXACT = float(1 << 53)
LEAST = np.iinfo(np.int64).min


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a) @ whole(b).T
    if max(out.max(), -out.min()) >= 1 << 63:
        raise ValueError("an inner product does not fit into 64 bits")
    return out.astype(np.int64)


class Best:
    """The first ``k`` (score descending, id ascending) of each group."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), LEAST, np.int64)
        self.id = np.full((groups, k), np.iinfo(np.int64).max, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.score[group, -1], self.id[group, -1]
        better = (score > last) | ((score == last) & (ids < last_id))
        group, score, ids = group[better], score[better], ids[better]
        if not len(group):
            return
        touched = np.unique(group)
        g = np.concatenate([group, np.repeat(touched, self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((i, ~s, g))
        g, s, i = g[order], s[order], i[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        keep = rank < self.k
        self.score[g[keep], rank[keep]] = s[keep]
        self.id[g[keep], rank[keep]] = i[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, r = np.nonzero(self.score > LEAST)
        return g, self.score[g, r], self.id[g, r]


def _vectors(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each vector length, and their whole components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def _anchors(table: pa.Table, scale: int) -> dict:
    """One block: ids, labels, and vectors by length (plain arrays: what is
    broadcast must not need this package on the executors)."""
    ids = table.column("id").to_numpy()
    return {"id": ids, "label": table.column("label").to_numpy(),
            "by_size": {m.shape[1]: (at, m) for at, m in _vectors(table.column("vector"), scale)} if len(ids) else {}}


def _tiles(anchors: dict, batches: Iterator[pa.RecordBatch], scale: int):
    """(anchor places, row ids, row labels, scores), a bounded tile at a time."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for at, rows in _vectors(batch.column(2), scale):
            if rows.shape[1] not in anchors["by_size"]:
                continue
            places, own = anchors["by_size"][rows.shape[1]]
            for r in range(0, len(at), TILE[1]):
                part, some = rows[r:r + TILE[1]], at[r:r + TILE[1]]
                for a in range(0, len(places), TILE[0]):
                    yield places[a:a + TILE[0]], ids[some], labels[some], scores(own[a:a + TILE[0]], part)


def _found(best: Best, names: list[str]) -> Iterator[pa.RecordBatch]:
    group, score, ids = best.rows()
    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(score), pa.array(ids)], names=names)


def _positives(block, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = Best(len(anchors["id"]), k)
        for places, ids, labels, s in _tiles(anchors, batches, scale):
            fits = (labels[None] == anchors["label"][places][:, None]) & (ids[None] != anchors["id"][places][:, None])
            # only what may enter a list leaves the tile
            a, r = np.nonzero(fits & (s >= best.score[places, -1][:, None]))
            best.add(places[a], s[a, r], ids[r])
        yield from _found(best, ["anchor", "score", "id"])
    return run


def _slots(block, k: int, scale: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        limits = anchors["limits"]                   # anchor x slot, highest first; LEAST: none
        n = limits.shape[1]
        top = limits[:, 0]
        floor = np.where(limits >= 0, limits, np.iinfo(np.int64).max).min(axis=1)
        floor = -((-floor * low) // high) if floor.size and floor.max() < LEAST // -high else floor // high * low
        best = Best(len(anchors["id"]) * n, k)
        for places, ids, labels, s in _tiles(anchors, batches, scale):
            fits = (labels[None] != anchors["label"][places][:, None]) & (s <= top[places][:, None]) & (s >= floor[places][:, None])
            a, r = np.nonzero(fits)
            if len(a):
                value = s[a, r]
                slot = (limits[places[a]] >= value[:, None]).sum(axis=1) - 1
                best.add(places[a] * n + slot, value, ids[r])
        yield from _found(best, ["slot", "score", "id"])
    return run


def _first(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group of the tasks' lists, numbered from 1."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mine_block(rows: DataFrame, block: pa.Table, scale: int, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    anchors = _anchors(block, scale)
    sent = spark.sparkContext.broadcast(anchors)
    found = rows.mapInArrow(_positives(sent, n_positives, scale), "anchor int, score bigint, id bigint")
    positives = cut_lineage(_first(found, "anchor", n_positives), "hard-positives")
    # at most n_positives rows for each anchor of the block
    held = positives.where("score >= 0").select("anchor", "score").distinct().toArrow()
    limits = np.full((len(anchors["id"]), n_positives), LEAST, np.int64)
    at, value = held.column("anchor").to_numpy(), held.column("score").to_numpy()
    order = np.lexsort((~value, at))
    at, value = at[order], value[order]
    limits[at, np.arange(len(at)) - np.searchsorted(at, at)] = value
    sent = spark.sparkContext.broadcast(anchors | {"limits": limits})
    slots = rows.mapInArrow(_slots(sent, n_negatives, scale, low, high), "slot int, score bigint, id bigint")
    best = _first(slots, "slot", n_negatives).groupBy("slot").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank"), "id", "score"))).alias("rows"))
    # slots of an anchor in order, the empty ones too, then suffix merges from the last
    lists = best.groupBy(F.expr(f"slot div {n_positives}").cast("int").alias("anchor")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("slot") % n_positives).alias("j"), "rows"))).alias("by_slot"))
    empty = F.array().cast("array<struct<rank:int,id:bigint,score:bigint>>")
    merged = F.aggregate(
        F.sequence(F.lit(n_positives - 1), F.lit(0), F.lit(-1)), F.array().cast("array<array<struct<rank:int,id:bigint,score:bigint>>>"),
        lambda acc, j: F.concat(F.array(F.slice(F.concat(
            F.coalesce(F.try_element_at("by_slot", j), empty), F.coalesce(F.get(acc, 0), empty)), 1, n_negatives)), acc))
    lists = lists.select("anchor", merged.alias("merged"))
    # a positive's slot: the number of distinct higher limits of its anchor
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(anchors["id"]), dtype=np.int32)), "anchor_id": pa.array(anchors["id"])}))
    own = positives.where("score >= 0").withColumn("j", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("score"))) - 1)
    chosen = own.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).drop("rank").join(lists, "anchor").join(names, "anchor")
    within = F.filter(F.get("merged", F.col("j")), lambda x: low * F.col("positive_score").cast("decimal(20,0)") <= high * x["score"].cast("decimal(20,0)"))
    return chosen.select("anchor_id", "positive_id", "positive_score", F.posexplode(within).alias("at", "row")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"),
        "positive_score", F.col("row.score").alias("negative_score"))


def mine(rows: DataFrame, anchors: DataFrame | None = None, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
         block: int = BLOCK) -> DataFrame:
    """For each anchor (a row of ``anchors``, which has the columns of ``rows``;
    all rows unless given) and each of its first ``n_positives`` rows of the same
    label, the first ``n_negatives`` rows of another label whose score lies
    between ``low`` / ``high`` of the positive's score and that score: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Components
    are floor(``scale`` * x)."""
    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        # x - x is not 0 for infinities and not a number
        whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & whole).select(
            F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("vector"))

    rows, own = valid(rows), valid(rows if anchors is None else anchors)
    spark = rows.sparkSession
    blocks = max(1, -(-own.count() // block))
    path = shared_path(spark, "anchors")
    own.repartition(blocks).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(path)
    dealt = spark.read.schema("id bigint, label bigint, vector " + dict(own.dtypes)["vector"] + ", block int").parquet(path)
    found = []
    for b in range(blocks):
        part = dealt.where(F.col("block") == b).drop("block").toArrow()
        one = _mine_block(rows, part, scale, n_positives, n_negatives, low, high)
        # of several blocks each one's result is written before the next begins
        found.append(one if blocks == 1 else cut_lineage(one, "hard-negatives"))
    return reduce(DataFrame.unionByName, found)

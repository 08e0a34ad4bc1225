"""Benchmark decontamination by size-partitioned MinHash containment search
(operator 4).

An item is contained in a document if 0.8 or more of its distinct five-word
shingles occur there. Items are short and documents long, so the similarity of
whole sets says nothing: items are put into partitions by size (up to 1, 2, 4,
8, ... shingles) and for each partition that is in use, documents are cut into
windows of twice its size, each starting half a window after the last, so that
a passage as long as an item lies whole in one window. With sets of like size
the containment bound turns into a Jaccard bound: at least
0.8 q / (q + 2u - 0.8 q) >= 0.19 for an item of q in (u/2, u] shingles. With
``FUNCTIONS`` MinHash values, of which one must agree, a contained item is missed
with probability below 0.81**64 = 1.4e-6. That needs more than u/2 distinct
shingles. Items that repeat themselves more are looked for by shingles of their
own instead: a document that holds 0.8 of q distinct ones holds at least one of
any q - ceil(0.8 q) + 1 of them, so none is missed.

Minima are computed once for blocks of the smallest size in use; larger blocks
and windows take minima of those. A window's values are tried against a bitmap
of fixed size that holds the items' values (it spares work and decides nothing);
those it lets through meet the items in an equi-join, and each candidate pair is
verified by counting the item's shingles that the document holds, wherever they
stand. The benchmark may be of any size: it is joined, never collected.

Defined results: items or documents of one to four words have one shingle of
all their words; null, empty or blank ones contain nothing and are contained in
nothing; repeated rows (equal id and text) give one row for each item; a null
id is kept as null; empty tables give an empty result; other columns are
ignored by ``search`` and pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, free_name, text_or_empty
from quire.llm.graph import bitmap, has
from quire.llm.shingles import Words, minhash, mix, multipliers, slices

WIDTH = 5
THRESHOLD = 0.8
FUNCTIONS = 64
#: Shingles of the runs that long texts are cut into; runs overlap by a window.
RUN = 1 << 18
#: Size class of items whose shingles are looked for themselves, and what tells their keys from MinHash keys.
EXACT = -1
SALT = np.uint64(0x5851F42D4C957F2D)


def _keys(values: np.ndarray, size_class: int) -> np.ndarray:
    """int64 keys of MinHash values: value, function and size class."""
    j = np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix((values.astype(np.uint64) | j) + (np.uint64(size_class) << np.uint64(48))).view(np.int64)


def _own_keys(shingles: np.ndarray) -> np.ndarray:
    """int64 keys of shingles that are looked for themselves."""
    return mix(shingles ^ SALT).view(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = multipliers(FUNCTIONS)
    for whole in batches:
        for batch in slices(whole, 1):
            hashes, starts = Words(batch.column(1)).shingles(WIDTH)
            sizes = np.diff(starts)
            take = np.flatnonzero(sizes > 0)
            values = minhash(hashes, starts[take], factors)
            classes = [int(n - 1).bit_length() for n in sizes[take]]
            sets = [np.unique(hashes[starts[i]:starts[i + 1]]).view(np.int64) for i in take]
            keys = [_keys(values[i:i + 1], c)[0] for i, c in enumerate(classes)]
            for i, x in enumerate(sets):
                if 2 * len(x) <= 1 << classes[i]:
                    classes[i], keys[i] = EXACT, _own_keys(x[:len(x) - -(-len(x) * 8 // 10) + 1].view(np.uint64))
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column(0).take(pa.array(take)), "size_class": pa.array(classes, pa.int32()),
                "shingles": pa.array([x.tolist() for x in sets], pa.list_(pa.int64())),
                "keys": pa.array([x.tolist() for x in keys], pa.list_(pa.int64()))})


def _grouped(starts: np.ndarray, lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``step`` elements in each run, and each block's run."""
    n = -(-lengths // step)
    owner = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[owner] + within * step, owner


def _hits(hashes, starts, lengths, classes, factors, bits):
    """(run, key) of the window values the bitmap lets through."""
    step = 1 << classes[0]
    at, owner = _grouped(starts, lengths, step)
    if not len(at):
        return
    # reduceat runs to the next start: blocks of a run are adjacent, runs may overlap, so ends are given too
    values = _minima(hashes, at, np.minimum(at + step, (starts + lengths)[owner]), factors)
    for c in classes:
        wide = (1 << c) // step
        if wide > 1:
            per = np.bincount(owner, minlength=len(lengths))
            first = np.cumsum(per) - per
            groups, owner = _grouped(first, per, wide)
            values, step = np.minimum.reduceat(values, groups, axis=0), 1 << c
        both = values.copy()
        joined = np.flatnonzero(owner[:-1] == owner[1:])
        both[joined] = np.minimum(values[joined], values[joined + 1])
        keys = _keys(both, c)
        w, j = np.nonzero(has(bits, keys.ravel()).reshape(keys.shape))
        yield owner[w], keys[w, j]


def _minima(hashes, a, b, factors):
    """Least values in [a, b) for each block."""
    if len(a) and np.array_equal(a[1:], b[:-1]) and b[-1] == len(hashes):
        return minhash(hashes, a, factors)
    n = b - a
    pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return minhash(hashes[pick], np.cumsum(n) - n, factors)


def _search(classes: list[int], items, shingles):
    """doc_id, text, text_hash -> doc_id, text_hash, hits, own (the shingles that
    items may hold), for documents with a hit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, bits, known = multipliers(FUNCTIONS), items.value, shingles.value
        by_size = [c for c in classes if c != EXACT]
        overlap = 2 << by_size[-1] if by_size else 0
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                hashes, starts = Words(batch.column(1)).shingles(WIDTH)
                sizes = np.diff(starts)
                # long texts in overlapping runs
                at, run_doc = _grouped(starts[:-1], np.maximum(sizes - overlap, np.minimum(sizes, 1)), RUN)
                lengths = np.minimum(starts[1:][run_doc] - at, RUN + overlap)
                docs, keys = [], []
                if EXACT in classes:
                    whole_keys = _own_keys(hashes)
                    hit = np.flatnonzero(has(bits, whole_keys))
                    docs.append(np.searchsorted(starts, hit, "right") - 1)
                    keys.append(whole_keys[hit])
                a = 0
                while by_size and a < len(at):
                    b = max(a + 1, int(np.searchsorted(np.cumsum(lengths[a:]), RUN << min(by_size[0], 2), "right")) + a)
                    lo, hi = int(at[a]), int((at + lengths)[a:b].max())
                    for r, k in _hits(hashes[lo:hi], at[a:b] - lo, lengths[a:b], by_size, factors, bits):
                        docs.append(run_doc[a:b][r])
                        keys.append(k)
                    a = b
                docs, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, keys))
                order = np.argsort(docs, kind="stable")
                found, first = np.unique(docs[order], return_index=True)
                if not len(found):
                    continue
                own = []
                for d in found:
                    s = hashes[starts[d]:starts[d + 1]].view(np.int64)
                    own.append(np.unique(s[has(known, s)]).tolist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array(found)), "text_hash": batch.column(2).take(pa.array(found)),
                    "hits": pa.array([np.unique(x).tolist() for x in np.split(keys[order], first[1:])], pa.list_(pa.int64())),
                    "own": pa.array(own, pa.list_(pa.int64()))})
    return run


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles (distinct ones of the item), n_common
    and containment, for every item contained in a document."""
    spark = docs.sparkSession
    bank = cut_lineage(items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
        _item_rows, "item_id bigint, size_class int, shingles array<bigint>, keys array<bigint>"), "leak-items")
    classes = sorted(r[0] for r in bank.select("size_class").distinct().collect())
    schema = "doc_id bigint, text_hash bigint, hits array<bigint>, own array<bigint>"
    if classes:
        wanted = spark.sparkContext.broadcast(bitmap(bank.select(F.explode("keys").alias("k")), "k"))
        known = spark.sparkContext.broadcast(bitmap(bank.select(F.explode("shingles").alias("k")), "k"))
        found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                            F.xxhash64(text_or_empty(text)).alias("text_hash")).mapInArrow(_search(classes, wanted, known), schema)
        found = cut_lineage(found, "leak-hits")
    else:
        found = spark.createDataFrame([], schema)
    found = found.dropDuplicates(["doc_id", "text_hash"])
    bank = bank.dropDuplicates(["item_id", "shingles"])
    values = bank.select("item_id", F.hash("shingles").alias("s"), F.explode("keys").alias("k")).distinct()
    pairs = found.select("doc_id", "text_hash", F.explode("hits").alias("k")).join(values, "k").select(
        "doc_id", "text_hash", "item_id", "s").distinct()
    p, d, b = pairs.alias("p"), found.select("doc_id", "text_hash", "own").alias("d"), bank.alias("b")
    checked = p.join(d, F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p.text_hash") == F.col("d.text_hash"))).join(
        b, F.col("p.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("p.s") == F.hash("b.shingles")))
    checked = checked.select("p.doc_id", "p.text_hash", "p.item_id", F.size("b.shingles").cast("long").alias("n_shingles"),
                             F.size(F.array_intersect("d.own", "b.shingles")).cast("long").alias("n_common"))
    return checked.withColumn("containment", F.col("n_common") / F.col("n_shingles")).where(
        F.col("n_common") * 10 >= F.col("n_shingles") * 8)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
          item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``docs`` without the documents that contain an item."""
    bad = search(docs, items, text, key, item_text, item_key).select(F.col("doc_id").alias("k_"), F.col("text_hash").alias("h_")).distinct().alias("bad")
    h = free_name(docs, "text_hash")
    d = docs.withColumn(h, F.xxhash64(text_or_empty(text))).alias("d")
    return d.join(bad, F.col(f"d.{key}").cast("long").eqNullSafe(F.col("bad.k_")) & (F.col(f"d.{h}") == F.col("bad.h_")),
                  "left_anti").select(*docs.columns)

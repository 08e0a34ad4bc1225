"""Connected components of very large graphs, and fixed-size bitmaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for every node of
    ``edges`` (u, v), by alternating large-star and small-star steps. Each step
    is a partial minimum and a join; each round is written to the shared folder.
    A node with very many neighbours sends one partial minimum per task."""
    edges = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the least of all
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: neighbours below a node, and itself, go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.where(F.col("u") != F.col("v")).distinct(), "links")
        # both are sets of links: equal if each link is in the two of them
        same = edges.unionByName(after).groupBy("u", "v").count().where("count < 2").isEmpty()
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of a bitmap: 4 MB, whatever is put in.
BITS = 1 << 25
_BUCKET = 32_768


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Packed bits (least bit first) of the int64 ``column`` of every row: two of
    each key, its low bits and the next ones, in halves of their own. A bitmap
    only ever spares work: what it lets through is joined exactly, so a full one
    costs time and loses nothing."""
    half = BITS // 2
    at = F.explode(F.array(F.pmod(F.col(column), F.lit(half)),
                           F.pmod(F.shiftright(F.col(column), 32), F.lit(half)) + half))
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("b")).agg(
        F.bitmap_construct_agg(F.pmod("at", F.lit(_BUCKET))).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.b * (_BUCKET // 8):r.b * (_BUCKET // 8) + len(piece)] = piece
    return out


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 ``keys`` the bitmap may hold."""
    half = BITS // 2
    out = _bit(bits, keys & np.int64(half - 1))
    some = np.flatnonzero(out)
    out[some] = _bit(bits, ((keys[some] >> np.int64(32)) & np.int64(half - 1)) + half)
    return out

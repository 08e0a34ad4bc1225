"""N-gram Jaccard join with Bayesian candidate pruning (operator 8).

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

1. Equal texts collapse to a class (a digest); similarity is a matter of classes.
2. Each class has ``FUNCTIONS`` MinHash values in bands of ``ROWS``; classes that
   agree in a band are candidates. A pair at the threshold is missed by all
   bands with probability (1 - 0.8**5)**25 = 5e-5, at 0.85 with 7e-7. Star links to
   the least member of each band's bucket give candidate clusters.
3. Shingles are read again for clustered classes only (a fixed-size bitmap lets
   the others go before any shuffle) and each cluster is dealt into blocks of
   about ``BLOCK`` classes; each pair of blocks is one task's group, so a large
   cluster is spread and no group is unbounded.
4. Inside a pair of blocks MinHash values are compared step by step: after n
   values with m agreements a pair is dropped when the posterior probability
   (uniform prior) that its similarity reaches the threshold is below
   ``TOLERANCE``. What survives is verified on the whole shingle sets.
5. Nothing leaves a group as pairs: it returns for each class the number of rows
   it is linked to, and a spanning forest of its links. The forests' components
   are the near-duplicate classes.

Defined results: a text of one to four words has one shingle of all its words; a
null, empty or blank text has none, is linked to nothing and is a class of its
own; rows with equal texts are linked to each other; a null id is a row like any
other (class ids are the least non-null id); repeated rows count as rows; an
empty table gives an empty result; other columns pass through ``keep_first``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, free_name, give_back, text_or_empty
from quire.llm.graph import bitmap, components, has
from quire.llm.shingles import Words, minhash, multipliers, slices

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 25
FUNCTIONS = ROWS * BANDS
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
#: MinHash values that are compared in a step.
STEPS = (25, 50, 75, 100, 125)
#: Classes in a block, on average.
BLOCK = 256


def digest_of(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def least_agreements(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Agreements of ``n`` from which P(similarity >= threshold | agreements) >=
    tolerance. The posterior is Beta(m + 1, n - m + 1); its upper tail at t is the
    chance of at most m successes in n + 1 trials of probability t."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, digest, bands (a 64-bit key for each; none without words)."""
    factors = multipliers(FUNCTIONS)
    for whole in batches:
        for batch in slices(whole, 1):
            words = Words(batch.column(1))
            hashes, starts = words.shingles(WIDTH)
            full = np.flatnonzero(np.diff(starts) > 0)
            values = minhash(hashes, starts[full], factors).astype(np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                bands = (bands ^ values[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                bands ^= bands >> np.uint64(29)
            bands = (bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
            held = np.zeros(batch.num_rows, np.int64)
            held[full] = BANDS
            offsets = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_hash": batch.column(2), "digest": pa.array([digest_of(x) for x in batch.column(1).to_pylist()], pa.binary()),
                "bands": pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))})
        give_back()


def _short(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest as int64."""
    return np.array([int.from_bytes(x[:8], "little", signed=True) for x in digests.to_pylist()], np.int64)


def _shingles(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value
        for whole in batches:
            for batch in slices(whole, 0):
                digests = pa.array([digest_of(x) for x in batch.column(0).to_pylist()], pa.binary())
                take = np.flatnonzero(has(mask, _short(digests)))
                if not len(take):
                    continue
                texts = batch.column(0).take(pa.array(take))
                hashes, starts = Words(texts).shingles(WIDTH)
                sets = [np.unique(hashes[starts[i]:starts[i + 1]]).astype("<u8").tobytes() for i in range(len(take))]
                yield pa.RecordBatch.from_pydict({"digest": digests.take(pa.array(take)), "shingles": pa.array(sets, pa.binary())})
            give_back()
    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the linked pairs of ``left`` x ``right`` places in
    ``sets``; within one block (left is right) each pair once."""
    same = left is right
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    values = minhash(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), factors)
    found_i, found_j = [], []
    for a in range(0, len(left), 64):
        own = left[a:a + 64]
        i, j = (x.ravel() for x in np.meshgrid(own, right, indexing="ij"))
        ok = np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j])
        if same:
            ok &= i < j
        i, j = i[ok], j[ok]
        agree, done = np.zeros(len(i), np.int64), 0
        for n in STEPS:
            agree = agree + (values[i, done:n] == values[j, done:n]).sum(1)
            go = agree >= least_agreements(n)
            i, j, agree, done = i[go], j[go], agree[go], n
        if len(i):
            both = _common(sets, i, j)
            go = both >= THRESHOLD * (sizes[i] + sizes[j] - both) - 1e-9
            found_i.append(i[go])
            found_j.append(j[go])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    if len(i) < 200:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    # many pairs of few sets: incidence matrices, multiplied over runs of columns
    rows, own = np.unique(i), np.unique(j)
    every = np.unique(np.concatenate([sets[a] for a in np.union1d(rows, own)]))
    out = np.zeros((len(rows), len(own)), np.float32)
    wide = 4096
    at_rows = [np.searchsorted(every, sets[a]) for a in rows]
    at_own = [np.searchsorted(every, sets[a]) for a in own]

    def part(places, c):
        m = np.zeros((len(places), wide), np.float32)
        for k, p in enumerate(places):
            lo, hi = np.searchsorted(p, (c, c + wide))
            m[k, p[lo:hi] - c] = 1
        return m

    for c in range(0, len(every), wide):
        out += part(at_rows, c) @ part(at_own, c).T
    return out[np.searchsorted(rows, i), np.searchsorted(own, j)].round().astype(np.int64)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task (root, x, y); returns digest, links and parent."""
    factors = multipliers(FUNCTIONS)
    held, task = [], None

    def finish():
        group = pd.concat(held) if len(held) > 1 else held[0]
        group = group.drop_duplicates("digest")
        if len(group) < 2:
            return None
        x, y = group.x.iloc[0], group.y.iloc[0]
        sets = [np.frombuffer(s, "<u8") for s in group.shingles]
        block, copies = group.block.to_numpy(), group.copies.to_numpy()
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        if not len(left) or not len(right):
            return None
        i, j = _links(sets, left, right, factors)
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
        parent = np.arange(len(sets))

        def top(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for a, b in zip(i, j):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        digests = group.digest.to_numpy()
        keep = np.flatnonzero(links > 0)
        return pd.DataFrame({"digest": digests[keep], "links": links[keep].astype(np.int64),
                             "parent": [digests[top(v)] for v in keep]})

    for batch in batches:
        change = (batch[["root", "x", "y"]] != batch[["root", "x", "y"]].shift()).any(axis=1).to_numpy()
        change[0] = False
        for piece in np.split(np.arange(len(batch)), np.flatnonzero(change)):
            part = batch.iloc[piece]
            now = (part.root.iloc[0], part.x.iloc[0], part.y.iloc[0])
            if held and now != task:
                out = finish()
                held = []
                if out is not None:
                    yield out
            task = now
            held.append(part)
    if held and (out := finish()) is not None:
        yield out


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, class_key (a digest), class_id (least doc_id of the
    near-duplicate class), n_links (rows it is linked to) and worded, a row for
    each row of ``docs``."""
    spark = docs.sparkSession
    rows = cut_lineage(docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("text_hash")
    ).mapInArrow(_sketches, "doc_id bigint, text_hash bigint, digest binary, bands array<bigint>"), "jaccard-sketches")
    classes = cut_lineage(rows.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("bands").alias("bands")), "jaccard-classes")
    banded = classes.select("digest", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where(
        F.col("least") != F.col("most")).select("band", "least")
    stars = banded.join(buckets, "band").select(F.col("digest").alias("u"), F.col("least").alias("v"))
    clusters = cut_lineage(components(stars), "jaccard-clusters")

    sizes = clusters.groupBy("root").agg(F.count("*").alias("m")).withColumn("n", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = clusters.join(sizes, "root").join(classes, F.col("node") == F.col("digest")).select(
        "digest", "root", "n", "copies", F.pmod(F.xxhash64("digest"), F.col("n")).cast("int").alias("block"))
    # little-endian first eight bytes, as the tasks read them
    key8 = F.expr("cast(conv(concat_ws('', transform(sequence(8, 1, -1), i -> substr(hex(digest), 2 * i - 1, 2))), 16, -10) as bigint)")
    bits = spark.sparkContext.broadcast(bitmap(clusters.select(F.col("node").alias("digest")).withColumn("k", key8), "k"))
    sets = docs.select(F.col(text).alias("text")).mapInArrow(_shingles(bits), "digest binary, shingles binary")
    full = members.join(sets.groupBy("digest").agg(F.first("shingles").alias("shingles")), "digest")
    tasks = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "digest", "block", "copies", "shingles")
    found = tasks.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    found = cut_lineage(found.mapInPandas(_compare, "digest binary, links bigint, parent binary"), "jaccard-links")

    roots = components(found.select(F.col("digest").alias("u"), F.col("parent").alias("v")))
    roots = classes.select("digest", "least", "copies", (F.size("bands") > 0).alias("worded")).join(
        roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("class_key", F.coalesce("root", "digest"))
    least = roots.groupBy("class_key").agg(F.min("least").alias("class_id"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    named = roots.join(least, "class_key").join(links, "digest", "left").select(
        "digest", "class_key", "worded", F.col("class_id").alias("c"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("l"))
    out = rows.select("doc_id", "text_hash", "digest").join(named, "digest")
    return out.select("doc_id", "text_hash", "class_key", F.when(F.col("worded"), F.col("c")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(F.col("worded"), F.col("l")).otherwise(0).cast("long").alias("n_links"), "worded")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (null ids
    last; one of repeated rows). Rows without words are classes of their own."""
    found = join(docs, text, key).where("worded")
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("b"))
    a, n, h = (free_name(docs, x) for x in ("id_", "null_", "hash_"))
    best = best.select(F.coalesce("b.doc_id", F.lit(0)).alias(a), F.col("b.n").alias(n), F.col("b.text_hash").alias(h))
    named = docs.withColumns({a: F.coalesce(F.col(key).cast("long"), F.lit(0)), n: F.col(key).isNull(),
                              h: F.xxhash64(text_or_empty(text))})
    blank = ~text_or_empty(text).rlike(r"[^\x20\x09-\x0D]")
    kept = named.where(~blank).join(best, [a, n, h], "left_semi").dropDuplicates([a, n, h])
    return kept.select(*docs.columns).unionByName(docs.where(blank))

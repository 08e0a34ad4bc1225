"""Substring dedup by relative Lempel-Ziv parsing (operator 7).

A document is factored against everything that earlier documents (smaller ids)
hold: each factor copies a run of words from one place of one earlier document.
A factor must be ``WINDOW`` words long or more; the words of such factors are
duplicates.

*Index.* All windows of 13 words are grouped by an anchor: the least hash among
the window's seven-word sequences. Equal windows have equal anchors, so the
corpus is indexed in reference blocks by anchor, one row for each anchor
occurrence with 32-bit tags of the windows it stands for (anchor and tag
together identify a window by 96 bits). Anchors that occur in one document only
go before windows are expanded. Inside an anchor a window's first occurrence, in
(doc_id, place) order, is its reference.

*Hot passages.* Each task first looks at its own block of documents: occurrences
that repeat a window of an earlier document in that block are known duplicates
and skip the index, so a passage that a third of all documents share sends one
row per block. Groups are sorted and streamed (they may spill), never collected.

*Parsing.* A document's seeds (place, reference, place there) are read from left
to right: a factor runs on while the next window continues in the same
reference; where it ends, the window at the boundary is looked at again, and if
it has a reference of its own, another factor starts there (overlapping by up to
twelve words), otherwise the words that no factor covers are literal.

Windows are judged on the input, not on what is left. Defined results: a null,
empty or blank text has no words; texts of fewer than 13 words lose nothing;
rows of equal id are not earlier than each other, so repeated rows have equal
results; a row with a null id is no reference and loses nothing; an empty table
gives an empty result; other columns pass through ``strip``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, free_name, text_or_empty
from quire.llm.graph import bitmap, has
from quire.llm.shingles import Words, slices

WINDOW = 13
ANCHOR = 7
#: Bytes of text in the blocks that tasks look at on their own.
BLOCK = 8 << 20

INDEX = ("anchor bigint, doc_id bigint, text_hash bigint, first int, tags array<int>, n int, ref_doc bigint, ref_place int")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, text_hash -> rows of the index, and known duplicates (tags
    null, n windows from ``first`` on that continue in ref_doc from ref_place)."""
    for whole in batches:
        for batch in slices(whole, 1, BLOCK):
            out = _block(batch)
            if out is not None:
                yield out


def _block(batch: pa.RecordBatch):
    words = Words(batch.column(1))
    full, ok = words.windows(WINDOW)
    known_id = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    per = words.counts()
    doc = np.repeat(np.arange(len(per)), per)
    at = np.flatnonzero(ok & known_id[doc])
    if not len(at):
        return None
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    doc, place = doc[at], (at - words.doc[doc[at]]).astype(np.int32)
    grams = words.windows(ANCHOR)[0]
    best, where = grams[at], at.copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        less = grams[at + j] < best
        best = np.where(less, grams[at + j], best)
        where[less] = at[less] + j
    window, own = full[at], ids[doc]

    # the first occurrence in this block, by (doc_id, place)
    order = np.lexsort((place, own, window))
    lead = np.ones(len(order), bool)
    lead[1:] = window[order[1:]] != window[order[:-1]]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    known = own[first] < own

    # windows of one anchor occurrence that are adjacent and of one kind
    head = np.ones(len(at), bool)
    head[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
    index = np.flatnonzero(head & ~known)
    size = np.diff(np.append(np.flatnonzero(head), len(at)))[~known[np.flatnonzero(head)]]
    keep = np.flatnonzero(~known)
    tags = (window[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    hashes = batch.column(2).to_numpy(zero_copy_only=False)
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(tags))

    run = known.copy()
    run[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]) & (own[first[1:]] == own[first[:-1]])
                 & (doc[first[1:]] == doc[first[:-1]]) & (place[first[1:]] == place[first[:-1]] + 1))
    begin = np.flatnonzero(run)
    group = np.cumsum(run)[known] - 1
    length = np.bincount(group, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    none, zero = pa.nulls, np.zeros(len(index), np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([best[index].view(np.int64), hashes[doc[begin]]])),
        pa.array(np.concatenate([own[index], own[begin]])),
        pa.array(np.concatenate([hashes[doc[index]], hashes[doc[begin]]])),
        pa.array(np.concatenate([place[index], place[begin]])),
        pa.concat_arrays([listed, none(len(begin), listed.type)]),
        pa.array(np.concatenate([zero, length]).astype(np.int32)),
        pa.array(np.concatenate([zero.astype(np.int64), own[first[begin]]])),
        pa.array(np.concatenate([zero, place[first[begin]]]).astype(np.int32))],
        names=["anchor", "doc_id", "text_hash", "first", "tags", "n", "ref_doc", "ref_place"])


def seeds(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash and ``seeds``: array of struct(place, n, ref_doc, ref_place),
    for documents that repeat a window of an earlier one."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text_or_empty(text)).alias("text_hash")).mapInArrow(_anchor_rows, INDEX)
    by_anchor = Window.partitionBy("anchor")
    shared = rows.withColumn("low", F.min(F.when(F.col("tags").isNotNull(), F.col("doc_id"))).over(by_anchor)).withColumn(
        "high", F.max(F.when(F.col("tags").isNotNull(), F.col("doc_id"))).over(by_anchor)).where(
        F.col("tags").isNull() | (F.col("low") < F.col("high")))
    # a known duplicate passes through as one row with a null tag
    each = shared.select("anchor", "doc_id", "text_hash", "first", "n", "ref_doc", "ref_place",
                         F.posexplode_outer("tags").alias("k", "tag"))
    each = each.withColumn("place", F.col("first") + F.coalesce("k", F.lit(0)))
    ordered = Window.partitionBy("anchor", "tag").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.first(F.struct("doc_id", "place")).over(ordered)
    found = each.withColumn("lead", lead).where(F.col("tag").isNull() | (F.col("lead.doc_id") < F.col("doc_id")))
    found = found.select("doc_id", "text_hash", F.when(F.col("tag").isNull(), F.struct("place", "n", "ref_doc", "ref_place")).otherwise(
        F.struct("place", F.lit(1).alias("n"), F.col("lead.doc_id").alias("ref_doc"), F.col("lead.place").alias("ref_place"))).alias("seed"))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("seed").alias("seeds"))


def parse(place: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_place: np.ndarray):
    """Factors (start, words, ref_doc, ref_start) from seeds, left to right."""
    one = np.repeat(np.arange(len(place)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, ref_doc, ref_place = place[one] + step, ref_doc[one], ref_place[one] + step
    order = np.lexsort((ref_place, ref_doc, place))
    place, ref_doc, ref_place = place[order], ref_doc[order], ref_place[order]
    once = np.ones(len(place), bool)
    once[1:] = place[1:] != place[:-1]
    place, ref_doc, ref_place = place[once], ref_doc[once], ref_place[once]
    head = np.ones(len(place), bool)
    head[1:] = (place[1:] != place[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_place[1:] != ref_place[:-1] + 1)
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(place))) + WINDOW - 1
    return place[start], length, ref_doc[start], ref_place[start]


def _seed_arrays(column: pa.Array, i: int):
    s = column[i].values
    return [s.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "n", "ref_doc", "ref_place")]


def factors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, start, n_words, ref_doc, ref_start: a row for each factor."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, length, ref, at = parse(*_seed_arrays(batch.column(2), i))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(start), pa.int64()),
                    pa.array([batch.column(1)[i].as_py()] * len(start), pa.int64()),
                    pa.array(start), pa.array(length), pa.array(ref), pa.array(at)],
                    names=["doc_id", "text_hash", "start", "n_words", "ref_doc", "ref_start"])
    return seeds(docs, text, key).mapInArrow(
        run, "doc_id bigint, text_hash bigint, start bigint, n_words bigint, ref_doc bigint, ref_start bigint")


def _covered(n_words: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _words_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])


def _plain(bits):
    """doc_id, text, text_hash -> the same with n_words, and either kept_text (no
    seed, by the bitmap) or the text again for those that may have seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value
        for whole in batches:
            for batch in slices(whole, 1):
                maybe = has(mask, batch.column(2).to_numpy(zero_copy_only=False)) & batch.column(0).is_valid().to_numpy(
                    zero_copy_only=False)
                words = Words(batch.column(1))
                digests, texts = [], []
                for i, again in enumerate(maybe):
                    a, b = words.doc[i], words.doc[i + 1]
                    if again:
                        digests.append(None)
                        texts.append(batch.column(1)[i].as_py())
                        continue
                    texts.append(None)
                    lo, hi = (int(words.start[a]), int(words.end[b - 1])) if b > a else (0, 0)
                    digests.append(hashlib.sha256(_words_of(
                        words.data[lo:hi], words.start[a:b] - lo, words.end[a:b] - lo)).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(2), pa.array(words.counts()), pa.array(digests, pa.string()),
                    pa.array(texts, pa.string())], names=["doc_id", "text_hash", "n_words", "kept_sha256", "text"])
    return run


def _strip(batches: Iterator[pa.RecordBatch], with_text: bool = False) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, kept_sha256, text, seeds -> the digest columns."""
    for batch in batches:
        removed, digests = [], []
        for i in range(batch.num_rows):
            if batch.column(2)[i].is_valid:
                removed.append(0)
                digests.append(batch.column(2)[i].as_py())
                continue
            words = Words(batch.column(3).slice(i, 1))
            gone = np.zeros(len(words.start), bool)
            if batch.column(4)[i].is_valid:
                start, length, _, _ = parse(*_seed_arrays(batch.column(4), i))
                gone = _covered(len(words.start), start, length)
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(_words_of(words.data, words.start[~gone], words.end[~gone])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one
    space, a row for each row of ``docs``. Only texts that may have factors move."""
    spark = docs.sparkSession
    found = cut_lineage(seeds(docs, text, key), "factor-seeds")
    bits = spark.sparkContext.broadcast(bitmap(found, "text_hash"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text_or_empty(text)).alias("text_hash")).mapInArrow(
        _plain(bits), "doc_id bigint, text_hash bigint, n_words bigint, kept_sha256 string, text string")
    # rows without a text to strip need no partner: they skip the shuffle
    done = rows.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    open_rows = rows.where("kept_sha256 is null").join(found, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", "kept_sha256", "text", "seeds")
    return done.unionByName(open_rows.mapInArrow(_strip, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))


def strip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the words of all factors taken out of the text (kept words
    joined by one space); texts without a factor stay as they are."""
    found = seeds(docs, text, key).select(F.col("doc_id").alias("k_"), F.col("text_hash").alias("h_"), F.col("seeds").alias("s_")).alias("f")
    h, s = free_name(docs, "text_hash"), free_name(docs, "seeds")
    d = docs.withColumn(h, F.xxhash64(text_or_empty(text))).alias("d")
    d = d.join(found, (F.col(f"d.{key}").cast("long") == F.col("f.k_")) & (F.col(f"d.{h}") == F.col("f.h_")), "left").select(
        "d.*", F.col("f.s_").alias(s))

    @F.pandas_udf("string")
    def kept(texts, found):
        import pandas as pd
        out = []
        for t, x in zip(texts, found):
            if x is None or t is None:
                out.append(t)
                continue
            words = Words(pa.array([t]))
            start, length, _, _ = parse(*[np.array([v[k] for v in x], np.int64) for k in ("place", "n", "ref_doc", "ref_place")])
            gone = _covered(len(words.start), start, length)
            out.append(_words_of(words.data, words.start[~gone], words.end[~gone]).decode())
        return pd.Series(out)

    d = d.withColumn(text, F.when(F.col(s).isNull(), F.col(text)).otherwise(kept(F.col(text), F.col(s))))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(s).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(
            docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)

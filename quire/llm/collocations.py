"""Phrase collocation mining (operator 13), on count streams in prefix and
suffix order.

Texts become pieces, pieces become words; a phrase is 1 to ``LONGEST`` words of
one piece. **Counting** goes level by level: a phrase of n words can be frequent
only if its first and its last n - 1 words are, so tasks count at each level
only what the frequent phrases of the level before leave (a bitmap of fixed size
says which these may be; it spares work and loses nothing, all counts are
exact). A block of texts is counted as sorted runs of word numbers, and the
blocks' counts are added up per phrase, combined in each task first.

**Joining** uses the layout of external language-model estimation. In *prefix
order* (by words, from the first) every phrase follows its own beginnings and
precedes its extensions to the right. So one pass over the sorted stream, with
one phrase of each length in memory, sees the count of every beginning and the
largest count of a one-word extension. The same pass over the stream in *suffix
order* (by words, from the last) yields the counts of all ends and of extensions
to the left. Streams are range-partitioned by the two words they start from, so
that a beginning of two words or more stands in its phrase's partition; counts of
single words come by a sort-merge join. No hash table holds counts.

A phrase inside a longer one cannot be rarer than it; so if any longer candidate
covers a phrase, a candidate with one word more does.

Defined results: a null text is empty, a null language is ``und``; repeated rows
count each time; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, text_or_empty
from quire.llm.graph import bitmap, has

#: Words of the longest phrase.
LONGEST = 5
#: Bytes of text that are counted at a time (one text, if that has more).
BLOCK_BYTES = 6_000_000
#: Parts of a language whose best phrases are found apart.
SHARES = 64
#: A key is the language, a tab, and the words with a blank between them (words
#: hold neither): one short string in the shuffles of all phrases.
COUNTS = "key string, f bigint"

# Class of each byte: 0 in a word, 1 blank, 2 end of a piece; lower case of A-Z.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
# Odd factors of a phrase's hash, one for each place (fixed values).
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of phrases, given the hashes of their language and words."""
    out = lang.copy()
    for factor, w in zip(_FACTORS, words):
        out = (out ^ (out >> np.uint64(29))) * factor + w * _FACTORS[0]
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


class _Block:
    """Words of some texts: numbers in a dictionary, pieces, languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
        begin = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
        kind = _CLASS[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[begin] = inside[begin]
        breaks = kind == 2
        breaks[begin] = True
        starts = np.flatnonzero(first)
        piece = np.cumsum(breaks, dtype=np.int32)[starts]
        # letters of the words, one after the other
        ends = np.cumsum(np.bincount(np.cumsum(first)[inside] - 1, minlength=len(starts))) if len(starts) else np.zeros(0, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        self.n = len(starts)
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = words.dictionary
        self.piece = piece
        langs = langs.dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.searchsorted(offsets[1:] - offsets[0], starts, "right")
        self.lang, self.langs = codes[doc], langs.dictionary

    def fits(self, n: int) -> np.ndarray:
        """Places where a phrase of n words begins."""
        return np.flatnonzero(self.piece[:self.n - n + 1] == self.piece[n - 1:]) if self.n >= n else np.zeros(0, np.int64)

    def known(self, n: int, bits: np.ndarray) -> np.ndarray:
        """For each place, whether the phrase of n words there may be frequent."""
        out = np.zeros(self.n + 1, bool)
        at = self.fits(n)
        hashes, langs = _word_hashes(self.names), _word_hashes(self.langs)
        out[at] = has(bits, _hash(langs[self.lang[at]], [hashes[self.word[at + i]] for i in range(n)]))
        return out

    def counts(self, n: int, at: np.ndarray) -> pa.RecordBatch:
        """Phrases of n words at the given places, each once with its count."""
        key, size = self.lang[at], max(len(self.names), 1)
        for i in range(n - 1):
            # numbers of the beginnings so far: exact, whatever their length
            key = np.unique(key * size + self.word[at + i], return_inverse=True)[1]
        key = key * size + self.word[at + n - 1]
        _, first, f = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.names.take(pa.array(self.word[first + i])) for i in range(n)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
        lang = self.langs.cast(pa.large_binary()).take(pa.array(self.lang[first]))
        keys = pc.binary_join_element_wise(lang, phrase, pa.scalar(b"\t", pa.large_binary()))
        return pa.RecordBatch.from_arrays([keys.cast(pa.binary()).cast(pa.string()), pa.array(f.astype(np.int64))], names=["key", "f"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            n = max(1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")) - at)
            part = batch.slice(at, n)
            yield _Block(part.column(1), part.column(0))
            at += n


def _counter(n: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            at = block.fits(n)
            if bits is not None:
                known = block.known(n - 1, bits.value)
                at = at[known[at] & known[at + 1]]
            if len(at):
                yield block.counts(n, at)
    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        flat = words.flatten().dictionary_encode()
        own = _word_hashes(flat.dictionary)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
        n = len(words)
        size = len(own) // max(n, 1)
        langs = batch.column(0).dictionary_encode()
        lang = _word_hashes(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_hash(lang, [own[i::size] for i in range(size)]) if n else np.zeros(0, np.int64))], names=["h"])


def phrase_counts(docs: DataFrame, min_count: int, text: str = "text", lang: str = "lang", longest: int = LONGEST):
    """(n words per language, frequent phrases of one word, frequent phrases of
    2 to ``longest`` words), as written tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    found, bits, totals = [], None, None
    # a language may hold a tab, a phrase does not
    of_lang = F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)")
    for n in range(1, longest + 1):
        counts = rows.mapInArrow(_counter(n, bits), COUNTS).groupBy("key").agg(F.sum("f").alias("f"))
        if n == 1:
            counts = cut_lineage(counts, "word-counts")
            totals = counts.groupBy(of_lang.alias("lang")).agg(F.sum("f").alias("n"))
        often = counts.where(F.col("f") >= min_count).select(of_lang.alias("lang"), F.split(F.substring_index("key", "\t", -1), " ").alias("words"), "f")
        found.append(often if n == 1 else cut_lineage(often, "phrase-counts"))
        if n < longest:
            keys = found[-1].select("lang", "words").mapInArrow(_hashes, "h bigint")
            bits = spark.sparkContext.broadcast(bitmap(keys, "h"))
    longer = found[1]
    for more in found[2:]:
        longer = longer.unionByName(more)
    return totals, found[0], longer


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted stream of lang, path (the words in stream order), f
    and more: adds the counts of the proper beginnings of two words or more, and
    the largest count of a one-word extension."""
    held: list = []          # lang, path, f, largest extension, other columns: one of each length
    names = None

    def close(keep: int, out: list) -> None:
        while len(held) > keep:
            out.append(held.pop())

    def batch_of(out: list) -> pa.RecordBatch:
        columns = {"lang": [x[0] for x in out], "path": [x[1] for x in out], "f": [x[2] for x in out]}
        columns |= {k: [x[5][i] for x in out] for i, k in enumerate(names)}
        columns |= {"starts": pa.array([x[4] for x in out], pa.list_(pa.int64())), "extension": pa.array([x[3] for x in out], pa.int64())}
        return pa.RecordBatch.from_pydict(columns, schema=pa.schema(
            [("lang", pa.string()), ("path", pa.list_(pa.string())), ("f", pa.int64())] + [(k, t) for k, t in zip(names, types)]
            + [("starts", pa.list_(pa.int64())), ("extension", pa.int64())]))

    for batch in batches:
        names, types = batch.schema.names[3:], [batch.schema.field(i).type for i in range(3, batch.num_columns)]
        columns = [c.to_pylist() for c in batch.columns]
        out: list = []
        for lang, path, f, *more in zip(*columns):
            keep = len(held)
            while keep and not (held[keep - 1][0] == lang and len(held[keep - 1][1]) < len(path)
                                and held[keep - 1][1] == path[:len(held[keep - 1][1])]):
                keep -= 1
            close(keep, out)
            if held and len(held[-1][1]) == len(path) - 1:
                held[-1][3] = max(held[-1][3], f)
            held.append([lang, path, f, 0, [x[2] for x in held], more])
        if out:
            yield batch_of(out)
    if held:
        out = []
        close(0, out)
        yield batch_of(out)


def _in_order(rows: DataFrame, more: str) -> DataFrame:
    """``_scan`` over ``rows`` (lang, path, f, ...) in order of ``path``."""
    keyed = rows.withColumn("_a", F.col("path")[0]).withColumn("_b", F.col("path")[1])
    sorted_rows = keyed.repartitionByRange("lang", "_a", "_b").sortWithinPartitions("lang", "path").drop("_a", "_b")
    return sorted_rows.mapInArrow(_scan, "lang string, path array<string>, f bigint, " + more + "starts array<bigint>, extension bigint")


def _best_first(*keys):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))


def mine(docs: DataFrame, min_count: int = 100, top: int | None = 2_000, cover: int = 100, text: str = "text", lang: str = "lang",
         longest: int = LONGEST) -> DataFrame:
    """The best ``top`` phrases of 2 to ``longest`` words of each language (all of
    them for None): lang, rank, phrase, a, l, r, n, score. A phrase is left out
    if a longer frequent phrase that holds it has ``cover`` percent of its count
    or more."""
    totals, words, phrases = phrase_counts(docs, min_count, text, lang, longest)
    prefix = _in_order(phrases.select("lang", F.col("words").alias("path"), "f"), "")
    seen = prefix.select("lang", F.reverse("path").alias("path"), "f", F.col("starts").alias("begins"), F.col("extension").alias("right_most"))
    suffix = _in_order(seen, "begins array<bigint>, right_most bigint, ")
    rows = suffix.withColumnsRenamed({"starts": "ends", "extension": "left_most"}).withColumn("words", F.reverse("path")).drop("path")
    kept = rows.where(100 * F.greatest("right_most", "left_most") < cover * F.col("f"))
    first = words.select("lang", F.col("words")[0].alias("w_first"), F.col("f").alias("f_first"))
    last = words.select("lang", F.col("words")[0].alias("w_last"), F.col("f").alias("f_last"))
    kept = kept.withColumn("w_first", F.col("words")[0]).withColumn("w_last", F.element_at("words", -1))
    kept = kept.join(first.hint("merge"), ["lang", "w_first"]).join(last.hint("merge"), ["lang", "w_last"]).join(totals, "lang")
    # counts of the first k and of the last k words, k = 1, 2, ...
    begins, ends = F.concat(F.array("f_first"), "begins"), F.concat(F.array("f_last"), "ends")
    kept = kept.select("lang", "words", F.col("f").alias("a"), "n", begins.alias("begins"), ends.alias("ends"))
    wide = "decimal(38,0)"

    def cut(k):
        left, right = F.get("begins", k - 1), F.get("ends", F.size("words") - k - 1)
        return F.struct(left.alias("l"), right.alias("r"), k.alias("k"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)
    kept = kept.withColumn("cuts", cuts).withColumn("above", F.col("a").cast(wide) * F.col("n").cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)"))
    scored = F.transform("cuts", lambda c: F.struct(
        F.call_function("div", F.col("above").cast(wide), (c["l"].cast("decimal(19,0)") * c["r"].cast("decimal(19,0)")).cast(wide)).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = kept.withColumn("best", F.array_min(scored)).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").cast("long").alias("score"))
    if top is not None:
        # the first ones of each share of a language before its shares meet
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        best = best.withColumn("rank", F.row_number().over(_best_first("lang", share))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(_best_first("lang")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

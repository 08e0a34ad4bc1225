"""Byte-level BPE encoding and decoding (operator 10).

Texts are split by the tokenizer's pattern on the JVM side. Blocks of documents
(``BLOCK_PIECES`` pieces, or one document if that has more) become one row each:
the block's distinct pieces, and for each document the numbers of its pieces.
Spark higher-order functions then fold the ranked merges over the bytes of each
distinct piece: the state is the list of tokens so far, each with the rank that
it and the next one would merge to; each step merges the leftmost pair of the
lowest rank, as the reference implementation of this encoding does. The rank
map is a hash table in one array (a map lookup in Spark scans the map), the value
of a table of one row: a literal of its length would be written out in every text
of a plan, and the driver makes and keeps many. Every piece has its single bytes as first tokens; a piece that is a token
itself needs no fold. Decoding concatenates the tokens' binary pieces.

Words are very unevenly frequent, so the distinct pieces of a bounded sample of
documents (about ``CACHE_ROWS`` rows, ``CACHE_PIECES`` pieces) are folded first and sent
to all tasks, with the tokens: a cache that spares folds and changes no result.

A fold over n bytes takes n steps of n, so pieces of more than ``LONG`` bytes
(unbroken runs, which no vocabulary holds whole) are merged by a heap where
blocks are built: the same merges, in n log n.

Nothing is shuffled; a block is a bounded piece of one input partition, so a
lost executor costs its partitions only.

Defined results: a null or empty text has no ids; repeated rows, null ids and
empty tables work; the vocabulary must hold all 256 single bytes (checked).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, give_back, let, text_or_empty

#: Pieces of the documents that share one block.
BLOCK_PIECES = 1_000_000
#: Bytes up to which a piece is merged by the fold.
LONG = 2_048
#: Rows that the cache is taken from (about), and pieces that it holds at most.
CACHE_ROWS = 30_000
CACHE_PIECES = 500_000
#: Rank of a pair that is no token.
NONE = 1 << 30
#: Sizes of the two halves of the rank table (primes).
HALVES = (131_071, 32_749)
#: Factors of a pair's two ids for its place in each half.
FACTORS = ((92_821, 31_337), (68_917, 48_611))

#: White space as the tokenizer's pattern means it (the Unicode property).
SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with white space spelled out for Java."""
    return (pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines ``base64 rank`` of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no rank for the single bytes {missing[:8]}")
    return ranks


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(first << 17 | second) -> rank, for the pairs of tokens that merging can
    meet. Until a span of bytes is one token, no merge crosses its ends, so its
    merges are those of its bytes alone: only their last pair ever joins to it."""
    if max(ranks.values()) >= 1 << 17:
        raise ValueError("ranks of 17 bits at most")
    found = {}
    for token, rank in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == NONE:
                break
            i = joined.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]] << 17 | ranks[parts[1]]] = rank
    return found


def rank_table(ranks: dict[bytes, int]) -> list[int]:
    """Cuckoo hash table of (pair << 17 | rank) + 1: a pair stands at its place in
    the first half or in the second; 0 is free."""
    table = [0] * sum(HALVES)

    def places(pair):
        a, b = pair >> 17, pair & 131_071
        return [(a * f + b * g) % n + before for (f, g), n, before in zip(FACTORS, HALVES, (0, HALVES[0]))]

    for pair, rank in pair_ranks(ranks).items():
        entry = (pair << 17 | rank) + 1
        at = places(pair)[0]
        for _ in range(500):
            entry, table[at] = table[at], entry
            if not entry:
                break
            one, two = places(entry - 1 >> 17)
            at = two if at == one else one
        else:
            raise ValueError("the rank table is too small for this vocabulary")
    return table


def with_array(df: DataFrame, name: str, values: pa.Array) -> DataFrame:
    """``df`` with ``values`` as an array in each row: the value of a table of one row.
    Plans name that table; a literal's elements would stand in each of them."""
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return df.withColumn(name, df.sparkSession.createDataFrame(pa.table({"held": one})).scalar())


def _rank(table: Column, a: Column, b: Column) -> Column:
    """Rank of the token that ``a`` and ``b`` join to, or NONE."""
    none = F.lit(NONE).cast("long")

    def entry(half, otherwise):
        f, g = FACTORS[half]
        at = (a * f + b * g) % HALVES[half] + (HALVES[0] if half else 0)
        # a place that is free was never taken, so its pairs are nowhere
        return let(F.get(table, at.cast("int")) - 1, lambda x: F.when(x < 0, none).when(
            F.shiftright(x, 17) == a * 131_072 + b, x.bitwiseAND(131_071)).otherwise(otherwise))
    return entry(0, entry(1, none))


def merge(tokens: Column, table: Column) -> Column:
    """Ids of one piece given as the tokens of its bytes: fold over its merges.
    The state is one array: each token with, in the bits above it, the rank that
    it and the next one merge to (the rank of a merge is the id of the token it
    makes, and only one pair makes it). So the least element, at its first place,
    is the next merge."""
    def paired(rank, token):
        return F.shiftleft(rank, 17).bitwiseOR(token)

    def token(x):
        return x.bitwiseAND(131_071)

    none = F.lit(NONE << 17).cast("long")
    start = F.transform(tokens, lambda x, i: F.when(
        i + 1 < F.size(tokens), paired(_rank(table, x, F.get(tokens, i + 1)), x)).otherwise(none.bitwiseOR(x)))

    def step(acc, _):
        def joined(least, q):
            # the q-th element (from 1) and the one after it become one token
            new, before, after = F.shiftright(least, 17), F.get(acc, q - 2), F.get(acc, q + 1)
            own = F.when(after.isNull(), none.bitwiseOR(new)).otherwise(paired(_rank(table, new, token(after)), new))
            rest = F.slice(acc, q + 2, F.size(acc))
            return F.when(q == 1, F.concat(F.array(own), rest)).otherwise(F.concat(
                F.slice(acc, F.lit(1), q - 2), F.array(paired(_rank(table, token(before), new), token(before)), own), rest))

        return let(F.array_min(acc), lambda least: F.when(least < none, let(
            F.array_position(acc, least).cast("int"), lambda q: joined(least, q))).otherwise(acc))

    return F.aggregate(F.sequence(F.lit(2), F.size(tokens)), start, step, lambda acc: F.transform(acc, token))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece, lowest rank and leftmost pair first."""
    n = len(word)
    end = list(range(1, n + 1))
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i:end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


#: ``sizes`` and ``known``: how many ids each distinct piece has so far, and these ids
#: (little-endian 32 bits, as the places are). ``words`` are the pieces to fold.
BLOCK_SCHEMA = ("keys array<bigint>, counts array<int>, places binary, sizes binary, known binary, words array<binary>, "
                "open array<int>, bytes array<array<bigint>>")


def known_pieces(ranks: dict[bytes, int], more: pa.Table | None = None) -> tuple:
    """Pieces whose ids are known (tokens, and the pieces and ids of ``more``): the
    pieces as an Arrow buffer, where each one's ids end, and all ids. Plain values:
    what is broadcast needs no package on the executors."""
    words = pa.array(list(ranks), pa.binary())
    ids, sizes = np.fromiter(ranks.values(), np.int32, len(ranks)), np.ones(len(ranks), np.int64)
    if more is not None and more.num_rows:
        more = more.combine_chunks()
        found, lists = more.column("piece").chunk(0).cast(pa.binary()), more.column("ids").chunk(0)
        words = pa.concat_arrays([words, found])
        ids = np.concatenate([ids, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
        sizes = np.concatenate([sizes, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)])
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([words], names=["piece"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), np.concatenate([[0], np.cumsum(sizes)]), ids


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _blocks(ranks: dict[bytes, int], have, words_too: bool = False):
    """key, pieces -> blocks. ``known`` has the ids of the pieces that are tokens,
    long, or in the cache; ``open`` are the pieces to fold, ``bytes`` the tokens
    of their bytes, ``words`` (if asked for) the pieces themselves."""
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def block(keys, counts, flats):
        words = pa.concat_arrays(flats).dictionary_encode()
        names = words.dictionary.cast(pa.binary())
        pieces, stops, all_ids = have.value
        pieces = pa.ipc.open_stream(pieces).read_next_batch().column(0)
        at = pc.index_in(names, value_set=pieces)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False)
        begin, sizes = stops[at], stops[at + 1] - stops[at]
        sizes[missing] = 0
        # the very long ones are merged here and follow the known ids
        long = missing[pc.binary_length(names.take(pa.array(missing))).to_numpy(zero_copy_only=False) > LONG]
        extra = [heap_merge(w, ranks) for w in names.take(pa.array(long)).to_pylist()]
        begin[long] = len(all_ids) + np.cumsum([0] + [len(x) for x in extra])[:-1]
        sizes[long] = [len(x) for x in extra]
        ids = np.concatenate([all_ids, *[np.array(x, np.int32) for x in extra]])[_runs(begin, sizes)]
        to_fold = np.setdiff1d(missing, long).astype(np.int32)
        chosen = names.take(pa.array(to_fold)).cast(pa.large_binary())
        ends = np.frombuffer(chosen.buffers()[1], np.int64)[chosen.offset:chosen.offset + len(chosen) + 1] if len(chosen) else np.zeros(1, np.int64)
        raw = np.frombuffer(chosen.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(chosen) else np.zeros(0, np.uint8)
        tokens = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(of_byte[raw]))
        raw_ints = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([
            one(pa.concat_arrays(keys)), one(pa.array(np.concatenate(counts).astype(np.int32))),
            raw_ints(words.indices.to_numpy(zero_copy_only=False)), raw_ints(sizes), raw_ints(ids),
            one(names.take(pa.array(to_fold)) if words_too else names.slice(0, 0)), one(pa.array(to_fold)), one(tokens)],
            names=["keys", "counts", "places", "sizes", "known", "words", "open", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, flats, held, batch = [], [], [], 0, None
        for batch in batches:
            at, sizes = 0, batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            while at < len(sizes):
                n = int(np.searchsorted(held + np.cumsum(sizes[at:]), BLOCK_PIECES, "right"))
                n = max(n, 0 if held else 1)
                if n:
                    part = batch.slice(at, n)
                    keys.append(part.column(0))
                    counts.append(sizes[at:at + n])
                    flats.append(part.column(1).flatten())
                    held += int(sizes[at:at + n].sum())
                    at += n
                if at < len(sizes):
                    yield block(keys, counts, flats)
                    keys, counts, flats, held = [], [], [], 0
                    give_back()
        if keys:
            yield block(keys, counts, flats)
        keys = flats = batch = None
        give_back()
    return run


def _pieces(docs: DataFrame, pattern: str, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.regexp_extract_all(
        text_or_empty(text), F.lit(java_pattern(pattern)), 0).alias("pieces"))


def _folded(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    ranked = with_array(blocks, "ranks", pa.array(rank_table(ranks), pa.int64()))
    return ranked.select("keys", "counts", "places", "sizes", "known", "words", "open", let(F.col("ranks"), lambda r: F.transform(
        "bytes", lambda b: merge(b, r))).alias("ids"))


def fill_cache(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> pa.Table:
    """piece and ids of the pieces that occur twice or more in a bounded sample,
    most frequent first, ``CACHE_PIECES`` at most."""
    # rows are drawn where they lie: a limit would move every text
    spark = docs.sparkSession
    n = docs.count()
    drawn = docs.sample(min(1.0, CACHE_ROWS / max(n, 1)), seed=7)
    sample = _pieces(drawn, pattern, text, key).select(F.explode("pieces").alias("piece"))
    often = sample.groupBy("piece").count().where("count > 1").orderBy(F.desc("count"), "piece").limit(CACHE_PIECES)
    often = often.select(F.lit(0).cast("long").alias("key"), F.array("piece").alias("pieces"))
    have = spark.sparkContext.broadcast(known_pieces(ranks))
    found = _folded(often.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_blocks(ranks, have, True), BLOCK_SCHEMA), ranks)
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("piece"), F.get("ids", i).cast("array<int>").alias("ids")))
    out = found.select(F.inline(pairs)).toArrow()
    have.destroy()
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id",
           digests: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row; with ``digests`` instead n_tokens
    and the SHA-256 of the comma-joined ids and of the decoded bytes."""
    have = docs.sparkSession.sparkContext.broadcast(known_pieces(ranks, fill_cache(docs, ranks, pattern, text, key)))
    blocks = _pieces(docs, pattern, text, key).mapInArrow(_blocks(ranks, have), BLOCK_SCHEMA)
    byte_strings = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        byte_strings[rank] = token

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(byte_strings, pa.binary())
        batch = None
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, places, sizes, known, _, opened, folded = (c.slice(i, 1) for c in batch.columns)
                places, sizes, known = (np.frombuffer(x[0].as_buffer(), "<i4") for x in (places, sizes, known))
                words = _all_ids(known, sizes.astype(np.int64), opened.flatten(), folded.flatten())
                ends = np.concatenate([[0], np.cumsum(counts.flatten().to_numpy())]).astype(np.int64)
                yield from _put_together(keys.flatten(), ends, places, words, tokens, digests)
                del keys, counts, places, sizes, known, opened, folded, words, ends
                give_back()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "doc_id bigint, ids array<int>"
    return _folded(blocks, ranks).mapInArrow(documents, schema)


#: Documents in one batch that leaves the last step.
BATCH = 500


def _all_ids(own: np.ndarray, sizes: np.ndarray, opened: pa.Array, folded: pa.ListArray) -> pa.ListArray:
    """Ids of all words of a block: the known ones, and those of the open words."""
    new = folded.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    at = opened.to_numpy(zero_copy_only=False)
    more = folded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin[at] = len(own) + np.cumsum(more) - more
    sizes[at] = more
    flat = np.concatenate([own, new]).astype(np.int32)[_runs(begin, sizes)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _put_together(keys, ends, places, words, tokens, digests) -> Iterator[pa.RecordBatch]:
    flat, stops = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(stops)
    if digests:
        # comma-joined ids, and decoded bytes, of each word
        texts = pc.binary_join(pa.ListArray.from_arrays(words.offsets, flat.cast(pa.string())), ",")
        binary = pc.binary_join(pa.ListArray.from_arrays(words.offsets, tokens.take(flat)), b"")
    else:
        flat = flat.to_numpy()
    for a in range(0, len(keys), BATCH):
        n = min(BATCH, len(keys) - a)
        p = places[ends[a]:ends[a + n]]
        offsets = ends[a:a + n + 1] - ends[a]
        out = {"doc_id": keys.slice(a, n)}
        before = np.concatenate([[0], np.cumsum(sizes[p])])[offsets]
        if digests:
            out["n_tokens"] = np.diff(before)

            def digest(parts, between):
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), parts.take(pa.array(p))), between)
                return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
            out["ids_sha256"], out["decoded_sha256"] = digest(texts, ","), digest(binary, b"")
        else:
            out["ids"] = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(flat[_runs(stops[p], sizes[p])]))
        yield pa.RecordBatch.from_pydict(out)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with the decoded bytes of ``ids`` in a column ``decoded``."""
    hexes = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        hexes[rank] = token.hex()
    pieces = free_name(encoded, "pieces")
    return with_array(encoded, pieces, pa.array(hexes, pa.string())).withColumn("decoded", let(F.col(pieces), lambda p: F.unhex(
        F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))).drop(pieces)

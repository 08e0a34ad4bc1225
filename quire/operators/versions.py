"""Versioned writes: gate, optimistic concurrency, stamping and history.

Write log columns: doc_id, seq (unique commit order), actor, ts (commit time),
expected_version, doc (new document), n_deals, optional claimed_* columns.
Current rows (``base``): doc_id, version, doc, n_deals, updated_at, updated_by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import LOAD_LABEL, UNKNOWN_AUTHOR
from quire.operators.ordering import CHUNK, DEFAULT_CHUNK, even_chunks, ordered_lag, ordered_last, ordered_rank
from quire.session import cut_lineage, ship_package

APPLIED, CONFLICT, FORBIDDEN, LOADED = "applied", "conflict", "forbidden", "loaded"
IMAGE_COLS = ["version", "doc", "n_deals", "updated_at", "updated_by"]


# ---------------------------------------------------------------- J2 / J3 / V4
def ignore_claimed_fields(w: DataFrame) -> DataFrame:
    """V4: the version and author a client claims are never trusted."""
    return w.drop(*[c for c in w.columns if c.startswith("claimed_")])


def claims_overridden(w: DataFrame, stamped: DataFrame) -> DataFrame:
    """V4 report: claims that differ from what the stamping decided."""
    s = stamped.select("doc_id", "seq", F.col("version").alias("stamped_version"),
                       F.col("updated_by").alias("stamped_author"))
    c = w.where(F.col("claimed_version").isNotNull() | F.col("claimed_author").isNotNull()) \
        .select("doc_id", "seq", "claimed_version", "claimed_author")
    differs = (F.col("claimed_version").isNotNull() & (F.col("claimed_version") != F.col("stamped_version"))) | (
        F.col("claimed_author").isNotNull() & (F.col("claimed_author") != F.col("stamped_author")))
    return c.join(s, ["doc_id", "seq"], "inner").where(differs)


def with_actor_profile(w: DataFrame, profiles: DataFrame) -> DataFrame:
    """One join on the actor serves both J2 (author) and J3 (gate).

    A shuffle join on the actor id: AQE splits a hot actor's partition of the
    log; the profile side has one row per id.
    """
    p = profiles.select(F.col("id").alias("_p_id"), F.col("nome").alias("_p_nome"),
                        F.col("papel").alias("_p_papel"))
    j = w.join(p, w["actor"] == p["_p_id"], "left")
    return j.withColumn("author", F.coalesce(F.col("_p_nome"), F.lit(UNKNOWN_AUTHOR))) \
            .withColumn("eligible", F.coalesce(F.col("_p_papel") == "editor", F.lit(False))) \
            .drop("_p_id", "_p_nome", "_p_papel")


def author_name(w: DataFrame, profiles: DataFrame) -> DataFrame:
    """author = profile name of the actor, else 'desconhecido'."""
    return with_actor_profile(w, profiles).drop("eligible")


def write_gate(w: DataFrame, profiles: DataFrame) -> DataFrame:
    """Accepted iff a profile with this id and role 'editor' exists."""
    return with_actor_profile(w, profiles).drop("author")


# ---------------------------------------------------------------- V5
# A write applies iff the document's version equals its expected version at
# that point of the log (a write without one always applies); the version
# then grows by one. That is a fold over each document's log. To keep a hot
# document parallel the log is cut into seq chunks and each chunk is
# summarised as a function  entering version -> leaving version:
#   * ``u`` = number of unconditional writes in the chunk, and
#   * a map on the few "special" entering versions that meet some
#     conditional write; every other entering version v leaves as v + u.
# Summaries of neighbouring chunks are composed pairwise (log2(#chunks)
# levels of equi-joins on (doc, block, version)), the entering version of
# every chunk follows by binary lifting, and each chunk is finally replayed
# from its known entering version. Every group handed to Python is one chunk.
#
# A load (S2) sets the version to 1, whatever it was: the function of a chunk
# that holds one is a constant ``c``, and so is every composition with it.

_SUMMARY_SCHEMA = "doc_id long, blk long, s_in int, s_out int, u int, c int"
_FOLD_SCHEMA = "doc_id long, seq long, applied boolean, version int"


def _summarise(exps: list) -> tuple[dict, int]:
    """Transfer function of one chunk: ({special entering -> leaving}, u).

    States are tracked relative to the number of unconditional writes seen
    so far; groups of entering versions that meet merge (union-find)."""
    origins, off = [], 0
    for e in exps:
        if e is None:
            off += 1
        else:
            origins.append(e - off)
    origins = sorted(set(origins))
    parent = {o: o for o in origins}

    def find(g):
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    at = {o: o for o in origins}            # relative state -> group
    off = 0
    for e in exps:
        if e is None:
            off += 1
            continue
        g = at.pop(e - off, None)
        if g is None:
            continue
        nxt = e - off + 1
        if nxt in at:
            parent[find(g)] = find(at[nxt])
        else:
            at[nxt] = g
    final = {find(g): r + off for r, g in at.items()}
    return {o: final[find(o)] for o in origins}, off


def _expected_list(pdf: pd.DataFrame) -> list:
    return [None if pd.isna(x) else int(x) for x in pdf["expected_version"].tolist()]


def _after_load(pdf: pd.DataFrame) -> int | None:
    """Version that a chunk (in order) leaves if it holds a load, else None."""
    loads = np.flatnonzero(pdf["load"].to_numpy(dtype=bool))
    if not len(loads):
        return None
    state = 1
    for e in _expected_list(pdf.iloc[loads[-1] + 1:]):
        state += e is None or e == state
    return state


def _chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    constant = _after_load(pdf)
    m, u = _summarise(_expected_list(pdf)) if constant is None else ({}, 0)
    n = len(m) + 1
    return pd.DataFrame({
        "doc_id": np.full(n, np.int64(pdf["doc_id"].iloc[0])),
        "blk": np.full(n, np.int64(pdf[CHUNK].iloc[0])),
        "s_in": pd.array(list(m.keys()) + [None], dtype="Int32"),
        "s_out": pd.array(list(m.values()) + [None], dtype="Int32"),
        "u": np.full(n, np.int32(u)),
        "c": pd.array([constant] * n, dtype="Int32")})


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    state = int(pdf["_s0"].iloc[0])
    applied, version = [], []
    for e, load in zip(_expected_list(pdf), pdf["load"].tolist()):
        if load:
            state = 1
            applied.append(True)
            version.append(state)
        elif e is None or e == state:
            state += 1
            applied.append(True)
            version.append(state)
        else:
            applied.append(False)
            version.append(None)
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(dtype=np.int64),
                         "seq": pdf["seq"].to_numpy(dtype=np.int64),
                         "applied": applied,
                         "version": pd.array(version, dtype="Int32")})


def _compose(m: DataFrame) -> DataFrame:
    """Summaries of blocks 2p and 2p+1 -> summary of block p."""
    m = m.withColumn("_p", F.shiftright("blk", 1)).withColumn("_odd", F.col("blk").bitwiseAND(F.lit(1)) == 1)
    spec = m.where(F.col("s_in").isNotNull())
    dflt = m.where(F.col("s_in").isNull())
    ls = spec.where(~F.col("_odd")).select("doc_id", "_p", F.col("s_in").alias("a"), F.col("s_out").alias("b"))
    rs = spec.where(F.col("_odd")).select("doc_id", "_p", F.col("s_in").alias("c"), F.col("s_out").alias("d"))
    lu = dflt.where(~F.col("_odd")).select("doc_id", "_p", F.col("u").alias("ul"), F.col("c").alias("cl"))
    ru = dflt.where(F.col("_odd")).select("doc_id", "_p", F.col("u").alias("ur"), F.col("c").alias("cr"))
    # left specials: a -> b, then through the right block (a constant one leaves none)
    through = ls.join(rs.withColumnRenamed("c", "b"), ["doc_id", "_p", "b"], "left") \
                .join(ru, ["doc_id", "_p"], "left").where(F.col("cr").isNull()) \
                .select("doc_id", "_p", F.col("a").alias("s_in"),
                        F.coalesce(F.col("d"), F.col("b") + F.coalesce(F.col("ur"), F.lit(0))).alias("s_out"))
    # right specials reached by versions the left block only shifts
    shifted = rs.join(lu, ["doc_id", "_p"], "left").where(F.col("cl").isNull()) \
                .select("doc_id", "_p", (F.col("c") - F.coalesce(F.col("ul"), F.lit(0))).alias("s_in"),
                        F.col("d").alias("s_out"))
    shifted = shifted.join(ls.withColumnRenamed("a", "s_in"), ["doc_id", "_p", "s_in"], "left_anti")
    specials = through.unionByName(shifted).select("doc_id", F.col("_p").alias("blk"), "s_in", "s_out",
                                                   F.lit(None).cast("int").alias("u"), F.lit(None).cast("int").alias("c"))
    # a constant left block leaves what the right block makes of its constant
    after = rs.select("doc_id", "_p", F.col("c").alias("cl"), "d")
    defaults = lu.join(ru, ["doc_id", "_p"], "full").join(after, ["doc_id", "_p", "cl"], "left").select(
        "doc_id", F.col("_p").alias("blk"), F.lit(None).cast("int").alias("s_in"), F.lit(None).cast("int").alias("s_out"),
        (F.coalesce(F.col("ul"), F.lit(0)) + F.coalesce(F.col("ur"), F.lit(0))).cast("int").alias("u"),
        F.coalesce("cr", "d", F.col("cl") + F.coalesce(F.col("ur"), F.lit(0))).cast("int").alias("c"))
    return specials.unionByName(defaults)


def resolve_conflicts(w: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """V5: per write ``outcome`` (applied / conflict / forbidden) and the new
    ``version`` of applied writes. ``w`` needs doc_id, seq, expected_version
    (NULL = no version predicate) and ``eligible`` (J3); ``base`` holds each
    document's starting version (absent documents start at 1). Access is
    decided first: a write that is not eligible is 'forbidden' whatever its
    version. A true ``load`` (a column that ``w`` may have) marks a full reload
    (S2): outcome 'loaded', version 1, whatever came before."""
    ship_package(w.sparkSession)
    # The eligible log (narrow columns) is read several times below: materialise
    # it once in the shared folder. Loads are no client's writes: no gate.
    load = F.col("load") if "load" in w.columns else F.lit(False)
    elig = cut_lineage(w.where(F.col("eligible") | load).select("doc_id", "seq", "expected_version", load.alias("load")), "eligible-log")
    elig, top = even_chunks(elig, "doc_id", "seq", chunk_width)
    levels = int(top).bit_length() if top is not None else 0
    maps = []
    if levels:
        maps.append(cut_lineage(elig.groupBy("doc_id", CHUNK).applyInPandas(_chunk_map, _SUMMARY_SCHEMA), "fold-maps"))
    for _ in range(1, levels):
        maps.append(cut_lineage(_compose(maps[-1]), "fold-maps"))
    start = base.select("doc_id", F.col("version").alias("_b"))
    q = elig.select("doc_id", CHUNK).distinct().join(start, "doc_id", "left") \
            .withColumn("_s", F.coalesce(F.col("_b"), F.lit(1)).cast("int")).drop("_b")
    for j in reversed(range(levels)):
        spec = maps[j].where(F.col("s_in").isNotNull()).select("doc_id", F.col("blk").alias("_blk"),
                                                               F.col("s_in").alias("_s"), "s_out")
        dflt = maps[j].where(F.col("s_in").isNull()).select("doc_id", F.col("blk").alias("_blk"), "u", "c")
        bit = F.shiftright(F.col(CHUNK), j).bitwiseAND(F.lit(1)) == 1
        q = q.withColumn("_blk", F.when(bit, F.shiftright(F.col(CHUNK), j) - 1))
        q = q.join(spec, ["doc_id", "_blk", "_s"], "left").join(dflt, ["doc_id", "_blk"], "left") \
             .select("doc_id", CHUNK, F.coalesce(F.col("c"), F.col("s_out"), F.col("_s") + F.coalesce(F.col("u"), F.lit(0)))
                     .cast("int").alias("_s"))
        if levels > 2:       # a task holds the joins of one level, however many there are
            q = cut_lineage(q, "fold-entering")
    entering = elig.join(q.withColumnRenamed("_s", "_s0"), ["doc_id", CHUNK], "inner")
    folded = entering.groupBy("doc_id", CHUNK).applyInPandas(_replay, _FOLD_SCHEMA)
    out = w.join(folded, ["doc_id", "seq"], "left")
    outcome = F.when(load, F.lit(LOADED)).when(~F.col("eligible"), F.lit(FORBIDDEN)) \
               .when(F.col("applied"), F.lit(APPLIED)).otherwise(F.lit(CONFLICT))
    return out.withColumn("outcome", outcome).drop("applied")


# ---------------------------------------------------------------- V1 / V3
def stamp_versions(accepted: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """V1: each accepted write sets version = previous + 1 (no version check:
    every accepted write counts), starting from the document's base version."""
    r = ordered_rank(accepted, "doc_id", "seq", "_rank", chunk_width)
    start = base.select("doc_id", F.col("version").alias("_b"))
    return r.join(start, "doc_id", "left").withColumn(
        "version", (F.coalesce(F.col("_b"), F.lit(1)) + F.col("_rank")).cast("int")).drop("_b", "_rank")


def stamp_author_time(w: DataFrame, profiles: DataFrame) -> DataFrame:
    """V3: the commit time of the write and the looked-up author name."""
    a = author_name(w, profiles)
    return a.withColumn("updated_at", F.col("ts")).withColumn("updated_by", F.col("author")).drop("author")


# ---------------------------------------------------------------- V2 / V7 / V8
def before_images(stamped: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """V2: each applied write archives the image it replaced: the previous
    applied write of the document, or the base row for the first one.
    ``hist_id`` is the archiving write's seq (unique, in commit order)."""
    cols = IMAGE_COLS
    lagged = ordered_lag(stamped.select("doc_id", "seq", *cols), "doc_id", "seq", cols, "prev_", chunk_width)
    b = base.select("doc_id", *[F.col(c).alias("base_" + c) for c in cols])
    j = lagged.join(b, "doc_id", "left")
    first = F.col("prev_version").isNull()
    return j.select(
        F.col("seq").alias("hist_id"), "doc_id",
        *[F.when(first, F.col("base_" + c)).otherwise(F.col("prev_" + c)).alias(c) for c in cols])


def current_snapshot(stamped: DataFrame, base: DataFrame | None) -> DataFrame:
    """V7: latest row per document (partial ``max_by``, no per-key sort);
    documents without an applied write keep their base row."""
    cols = IMAGE_COLS
    rows = stamped.select("doc_id", "seq", *cols)
    if base is not None:
        rows = rows.unionByName(base.select("doc_id", F.lit(-1).cast("bigint").alias("seq"), *cols))
    packed = F.struct(*[F.col(c) for c in cols])
    out = rows.groupBy("doc_id").agg(F.max_by(packed, F.col("seq")).alias("_r"))
    return out.select("doc_id", *[F.col("_r")[c].alias(c) for c in cols])


def noop_write_report(stamped: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """V8: applied writes that left the document unchanged still got a new
    version and a history row."""
    h = before_images(stamped, base, chunk_width).select("doc_id", "hist_id", F.col("doc").alias("_old"))
    s = stamped.select("doc_id", F.col("seq").alias("hist_id"), "version", "doc")
    j = s.join(h, ["doc_id", "hist_id"], "inner")
    return j.select("doc_id", "version", F.col("doc").eqNullSafe(F.col("_old")).alias("unchanged"))


def history_listing(history: DataFrame) -> DataFrame:
    """V6: version, time, author and number of deals, newest first."""
    return history.select("doc_id", "version", "updated_at", "updated_by", F.col("n_deals").alias("deals")) \
                  .orderBy(F.col("doc_id"), F.col("version").desc())


def sort_by_version(history: DataFrame) -> DataFrame:
    """L1: version descending (range-partitioned global sort)."""
    return history.orderBy(F.col("version").desc(), F.col("doc_id"))


# ---------------------------------------------------------------- chain
def apply_writes(w: DataFrame, profiles: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK,
                 materialize: bool = True):
    """E1 end to end: V4 -> J2/J3 -> V5 -> V1/V3 stamps -> V2 history -> V7.

    Returns (outcomes, history, current). With ``materialize`` the outcomes
    (the log's durable result, read by both history and current) are written
    once to the shared folder; a caller that uses a single output can skip it."""
    clean = ignore_claimed_fields(w)
    gated = with_actor_profile(clean, profiles)
    resolved = resolve_conflicts(gated, base, chunk_width)
    if materialize:
        resolved = cut_lineage(resolved, "outcomes")
    stamped = resolved.where(F.col("outcome") == APPLIED) \
        .withColumn("updated_at", F.col("ts")).withColumn("updated_by", F.col("author"))
    history = before_images(stamped, base, chunk_width)
    current = current_snapshot(stamped, base)
    return resolved, history, current


# ---------------------------------------------------------------- reloads
def apply_log(w: DataFrame, profiles: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK,
              label: str = LOAD_LABEL, materialize: bool = True):
    """E1 on a log of writes and reloads (S2; ``load`` true). A reload replaces
    the document, sets its version to 1 and its author to ``label``, and archives
    nothing; so versions repeat, and every image carries its load ``epoch``: the
    number of reloads of its document up to it, counted on from ``base`` (doc_id,
    version, doc, n_deals, updated_at, updated_by and, if there is one, epoch).

    Returns (outcomes, history, current); history is the before-images (hist_id =
    seq of the write that replaced them), listed by epoch, then version."""
    gated = with_actor_profile(ignore_claimed_fields(w), profiles)
    load = F.coalesce(F.col("load"), F.lit(False))
    resolved = resolve_conflicts(gated.withColumn("load", load), base, chunk_width)
    if materialize:
        resolved = cut_lineage(resolved, "outcomes")
    stamped = resolved.where(F.col("outcome").isin(APPLIED, LOADED)) \
        .withColumn("updated_at", F.col("ts")) \
        .withColumn("updated_by", F.when(F.col("load"), F.lit(label)).otherwise(F.col("author")))
    if "epoch" not in base.columns:
        base = base.withColumn("epoch", F.lit(0).cast("bigint"))
    counted = ordered_last(stamped, "doc_id", "seq", ["seq"], "load", "_q_", chunk_width).drop("_q_seq")
    start = base.select("doc_id", F.col("epoch").alias("_q_epoch"))
    images = counted.join(start, "doc_id", "left").withColumn(
        "epoch", (F.coalesce("_q_epoch", F.lit(0)) + F.col("_q_count")).cast("bigint"))
    cols = ["epoch", *IMAGE_COLS]
    images = images.select("doc_id", "seq", "load", *cols)
    if materialize:          # read by the history, its carries and the current rows
        images = cut_lineage(images, "images")
    lagged = ordered_lag(images, "doc_id", "seq", cols, "prev_", chunk_width)
    old = base.select("doc_id", *[F.col(c).alias("base_" + c) for c in cols])
    first = F.col("prev_version").isNull()
    history = lagged.where(~F.col("load")).join(old, "doc_id", "left").select(
        F.col("seq").alias("hist_id"), "doc_id",
        *[F.when(first, F.col("base_" + c)).otherwise(F.col("prev_" + c)).alias(c) for c in cols])
    rows = images.select("doc_id", "seq", *cols).unionByName(base.select("doc_id", F.lit(-(1 << 62)).cast("bigint").alias("seq"), *cols))
    current = rows.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "seq").alias("_r")).select("doc_id", "_r.*")
    return resolved, history, current


def reload_listing(history: DataFrame) -> DataFrame:
    """V6 over a log with reloads: by epoch, then version, newest first."""
    return history.select("doc_id", "epoch", "version", "updated_at", "updated_by", F.col("n_deals").alias("deals"), "doc") \
                  .orderBy("doc_id", F.col("epoch").desc(), F.col("version").desc())


def provisional_flag(flag_events: DataFrame, profiles: DataFrame) -> DataFrame:
    """V9: the latest flag event per person wins; people without events keep
    their stored flag (false by default)."""
    last = flag_events.groupBy(F.col("user_id").alias("id")).agg(
        F.max_by("flag", F.struct("ts", "event_id")).alias("_f"))
    p = profiles.select("id", "senha_provisoria")
    return p.join(last, "id", "left").select(
        "id", F.coalesce(F.col("_f"), F.col("senha_provisoria"), F.lit(False)).alias("provisional"))

"""Versioned writes as they arrive.

Per document the state is its current version. Each micro-batch's writes are
resolved against it by the batch fold (V5: chunk summaries, composed, then
replayed from each chunk's entering version), so a frame in Python holds one
chunk of a document's writes, however many of them a batch has. The versions
after each batch are a table of their own; a batch that is run again overwrites
its own folders, so nothing is written twice.

``versioned_writes_stream`` is the same as one streaming DataFrame with keyed
state, for sinks that need one: there a frame holds all writes of a document in
a batch, so batches must be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.ordering import DEFAULT_CHUNK
from quire.operators.versions import APPLIED, CONFLICT, FORBIDDEN, resolve_conflicts, with_actor_profile
from quire.session import conf_override, cut_lineage, ship_package, shared_path

OUT_SCHEMA = ("doc_id long, seq long, actor long, expected_version int, eligible boolean, "
              "outcome string, version int")
STATE_SCHEMA = "version int"
VERSIONS_SCHEMA = "doc_id long, version int"
#: Rows of a commit (about; a commit is a range of seq).
COMMIT_ROWS = 1_000_000
LOG_SCHEMA = "doc_id long, seq long, actor long, expected_version int"


def _replay(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version = state.get[0] if state.exists else 1
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    outcome, new_version = [], []
    expected = pdf["expected_version"]
    free = expected.isna().to_numpy()          # no version predicate: always applies
    for elig, any_version, exp in zip(pdf["eligible"].to_numpy(), free, expected.fillna(-1).to_numpy(dtype=np.int64)):
        if not elig:
            outcome.append(FORBIDDEN)
            new_version.append(None)
        elif any_version or exp == version:
            version += 1
            outcome.append(APPLIED)
            new_version.append(version)
        else:
            outcome.append(CONFLICT)
            new_version.append(None)
    state.update((version,))
    yield pd.DataFrame({
        "doc_id": pdf["doc_id"].to_numpy(dtype=np.int64), "seq": pdf["seq"].to_numpy(dtype=np.int64),
        "actor": pdf["actor"].astype("Int64"), "expected_version": pdf["expected_version"].astype("Int32"),
        "eligible": pdf["eligible"].astype(bool), "outcome": outcome,
        "version": pd.array(new_version, dtype="Int32")})


def versioned_writes_stream(log: DataFrame, profiles: DataFrame) -> DataFrame:
    """Streaming DataFrame of write outcomes. ``log`` is a streaming write
    log (doc_id, seq, actor, expected_version); ``profiles`` is static (a
    stream-static join decides the gate)."""
    ship_package(log.sparkSession)
    gated = with_actor_profile(log, profiles).select("doc_id", "seq", "actor", "expected_version", "eligible")
    return gated.groupBy("doc_id").applyInPandasWithState(
        _replay, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def commits(w: DataFrame, parts: int, name: str) -> list[DataFrame]:
    """The log as ``parts`` successive ranges of seq; an empty log is one commit."""
    w = cut_lineage(w, name + "-src")        # derive once, then cut by seq range
    bounds = w.agg(F.min("seq"), F.max("seq")).first()
    if bounds[0] is None:
        return [w]
    lo, hi = int(bounds[0]), int(bounds[1])
    step = (hi - lo) // parts + 1
    return [w.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step)) for i in range(parts)]


def stage_log(w: DataFrame, parts: int, name: str = "write-log") -> str:
    """Write the log as ``parts`` successive commits in seq order, so a file
    stream replays it as ``parts`` micro-batches in commit order (or as more, where
    a commit has several files and the stream takes one at a time)."""
    path = shared_path(w.sparkSession, name)
    for commit in commits(w, parts, name):
        commit.write.mode("append").parquet(path)
    return path


def _drive(spark: SparkSession, log_path: str, profiles: DataFrame, folder: str, state_partitions: int | None,
           chunk_width: int) -> None:
    """Process all files that are there in one micro-batch (no file limit: a
    batch must hold whole commits, however many files a commit has)."""
    log = spark.readStream.schema(LOG_SCHEMA).parquet(log_path)
    spark.createDataFrame([], OUT_SCHEMA).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    spark.createDataFrame([], VERSIONS_SCHEMA).write.mode("overwrite").parquet(f"{folder}/versions/-1")

    def resolve(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/{n}")
        gated = with_actor_profile(spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log/{n}"), profiles)
        gated = gated.select("doc_id", "seq", "actor", "expected_version", "eligible")
        before = spark.read.schema(VERSIONS_SCHEMA).parquet(f"{folder}/versions/{n - 1}")
        out = resolve_conflicts(gated, before, chunk_width).select("doc_id", "seq", "actor", "expected_version", "eligible", "outcome", "version")
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        done = spark.read.schema(OUT_SCHEMA).parquet(f"{folder}/out/batch={n}").where(F.col("outcome") == APPLIED)
        # versions only grow
        before.unionByName(done.select("doc_id", "version")).groupBy("doc_id").agg(F.max("version").alias("version")) \
            .write.mode("overwrite").parquet(f"{folder}/versions/{n}")

    with conf_override(spark, {"spark.sql.shuffle.partitions": state_partitions} if state_partitions else {}):
        q = log.writeStream.foreachBatch(resolve).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUT_SCHEMA + ", batch long").parquet(f"{folder}/out").drop("batch")


def run_versioned_writes(spark: SparkSession, log_path: str, profiles: DataFrame,
                         state_partitions: int | None = None, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """Drive T1 over a staged log to completion (``availableNow``) into a
    parquet sink in the shared folder; returns the sink as a batch frame.
    ``state_partitions`` sets the shuffle partitions of the batches."""
    folder = shared_path(spark, "t1")
    _drive(spark, log_path, profiles, folder, state_partitions, chunk_width)
    return _outcomes(spark, folder)


def replay_commits(spark: SparkSession, w: DataFrame, parts: int, profiles: DataFrame,
                   state_partitions: int | None = None, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """T1 over a log that arrives as commits in seq order, ``parts`` of them or as
    many more as ``COMMIT_ROWS`` needs: each commit, of any number of files, is
    written to the inbox and processed as one micro-batch before the next one
    arrives; versions carry over between them."""
    inbox, folder = shared_path(spark, "t1-inbox"), shared_path(spark, "t1")
    w = cut_lineage(w, "t1-log")
    parts = max(parts, -(-w.count() // COMMIT_ROWS))
    shares = [i / parts for i in range(1, parts)]
    cuts = w.agg(F.percentile_approx("seq", shares, max(10_000, 10 * parts))).first()[0] if shares else []
    cuts = [None, *sorted(set(cuts or [])), None]
    for a, b in zip(cuts, cuts[1:]):
        after = F.lit(True) if a is None else F.col("seq") > a
        upto = F.lit(True) if b is None else F.col("seq") <= b
        w.where(after & upto).write.mode("append").parquet(inbox)
        _drive(spark, inbox, profiles, folder, state_partitions, chunk_width)
    return _outcomes(spark, folder)

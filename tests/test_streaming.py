"""Streaming twins: state survives a restart from the checkpoint, and the
stream equals the batch fold."""

import random

from pyspark.sql import functions as F

from quire.operators import versions as V
from quire.session import shared_path
from quire.streaming.writes import LOG_SCHEMA, OUT_SCHEMA, versioned_writes_stream


def test_restart_keeps_document_versions(spark):
    rnd = random.Random(5)
    log, nxt = [], {}
    for seq in range(200):
        d = rnd.choice([0, 0, 0, 1, 2])
        k = nxt.get(d, 0)
        nxt[d] = k + 1
        log.append((d, seq, rnd.choice([1, 2, 3]), 1 + k // 2))
    profiles = spark.createDataFrame([(1, "E", "editor"), (2, "R", "leitor")], "id long, nome string, papel string")
    src, out, ckpt = (shared_path(spark, n) for n in ("t-src", "t-out", "t-ckpt"))
    df = spark.createDataFrame(log, LOG_SCHEMA)

    def run():
        stream = spark.readStream.schema(LOG_SCHEMA).parquet(src)
        q = versioned_writes_stream(stream, profiles).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()

    df.where(F.col("seq") < 100).coalesce(1).write.mode("append").parquet(src)
    run()                                     # first half, then the query stops
    df.where(F.col("seq") >= 100).coalesce(1).write.mode("append").parquet(src)
    run()                                     # restart: versions continue from the stored state
    got = {r["seq"]: (r["outcome"], r["version"]) for r in spark.read.schema(OUT_SCHEMA).parquet(out).collect()}
    gated = V.write_gate(df, profiles)
    want = {r["seq"]: (r["outcome"], r["version"])
            for r in V.resolve_conflicts(gated, spark.createDataFrame([], "doc_id long, version int")).collect()}
    assert len(got) == 200 and got == want


def test_empty_log_stages_and_streams(spark):
    from quire.streaming.writes import run_versioned_writes, stage_log
    empty = spark.createDataFrame([], LOG_SCHEMA)
    profiles = spark.createDataFrame([], "id long, nome string, papel string")
    assert run_versioned_writes(spark, stage_log(empty, 3, "t-empty"), profiles).count() == 0


def test_commits_of_several_files_and_free_versions(spark):
    from quire.streaming.writes import replay_commits
    rnd = random.Random(8)
    log, nxt = [], {}
    for seq in range(400):
        d = rnd.choice([0, 0, 0, 1, 2])
        nxt[d] = nxt.get(d, 0) + 1
        log.append((d, seq, rnd.choice([1, 1, 2, 3]), None if rnd.random() < 0.2 else 1 + nxt[d] // 2))
    profiles = spark.createDataFrame([(1, "E", "editor"), (2, "R", "leitor")], "id long, nome string, papel string")
    df = spark.createDataFrame(log, LOG_SCHEMA).repartition(6)
    got = {r["seq"]: (r["outcome"], r["version"]) for r in replay_commits(spark, df, 3, profiles).collect()}
    want = {r["seq"]: (r["outcome"], r["version"]) for r in V.resolve_conflicts(
        V.write_gate(df, profiles), spark.createDataFrame([], "doc_id long, version int")).collect()}
    assert len(got) == 400 and got == want


def test_hot_document_in_chunks_and_commits_of_bounded_size(spark, monkeypatch):
    from quire.streaming import writes

    def whole_document(key, batches, state):
        raise AssertionError("all writes of a document in one frame")
    monkeypatch.setattr(writes, "_replay", whole_document)
    monkeypatch.setattr(writes, "COMMIT_ROWS", 100)
    batches, drive = [], writes._drive
    monkeypatch.setattr(writes, "_drive", lambda spark, path, *rest: (batches.append(spark.read.parquet(path).count()), drive(spark, path, *rest)))
    rnd = random.Random(9)
    log, nxt = [], {}
    for k in range(600):
        d = rnd.choice([0, 0, 0, 1, 2])
        nxt[d] = nxt.get(d, 0) + 1
        log.append((d, k if k < 300 else 1_000_000 + 7 * k, rnd.choice([1, 1, 2, 3]), None if rnd.random() < 0.2 else 1 + nxt[d] // 2))
    profiles = spark.createDataFrame([(1, "E", "editor"), (2, "R", "leitor")], "id long, nome string, papel string")
    df = spark.createDataFrame(log, LOG_SCHEMA).repartition(4)
    want = {r["seq"]: (r["outcome"], r["version"]) for r in V.resolve_conflicts(
        V.write_gate(df, profiles), spark.createDataFrame([], "doc_id long, version int")).collect()}
    got = writes.replay_commits(spark, df, 2, profiles, chunk_width=16)
    assert [f"{c} {t}" for c, t in got.dtypes] == [f"{c} {t}" for c, t in spark.createDataFrame([], OUT_SCHEMA).dtypes]
    rows = got.collect()
    assert len(rows) == 600 and {r["seq"]: (r["outcome"], r["version"]) for r in rows} == want
    assert len(batches) == 6 and max(b - a for a, b in zip([0] + batches, batches)) <= 110
    rows = writes.run_versioned_writes(spark, writes.stage_log(df, 2, "t-hot"), profiles, chunk_width=16).collect()
    assert len(rows) == 600 and {r["seq"]: (r["outcome"], r["version"]) for r in rows} == want


def test_flag_deltas_merge_by_levels_and_survive_a_lost_merge_and_a_replay(spark):
    from quire.streaming import flags as FL
    rnd = random.Random(4)
    root, last = shared_path(spark, "t-flags"), {}
    sink = FL.delta_sink(root, 2)

    def flags():
        return {r.user_id: r.flag for r in FL.current_flags(spark, root, 2).collect()}
    assert flags() == {}
    batches = []
    for n in range(7):
        events = [(100 * n + i, rnd.randint(0, 9), rnd.random() < 0.5) for i in range(6)]
        df = FL.latest_flags(spark.createDataFrame(events, "event_id long, user_id long, flag boolean").withColumn(
            "ts", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id)")))
        batches.append(df)
        sink(df, n)
        last.update({u: f for _, u, f in events})
        assert flags() == last
    names = [f.split("/", f.count("/") - 1)[-1] for f in FL.delta_folders(spark, root, 2)]
    assert names == ["level=2/upto=3", "level=1/upto=5", "level=0/upto=6"]
    sink(batches[3], 3)                       # batch 3 runs again, with its two merges
    assert flags() == last
    # a merge that was not committed does not count; its batch makes it again
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/level=2/upto=3/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/level=2/upto=3/_lost"))
    assert len(FL.delta_folders(spark, root, 2)) == 4 and flags() == last
    sink(batches[3], 3)
    assert len(FL.delta_folders(spark, root, 2)) == 3 and flags() == last


def test_profiles_arrive_in_commits_of_several_files(spark, monkeypatch):
    """A commit is one batch however many files it has, and the table's ids are not
    broadcast to meet it."""
    from quire.session import shared_path
    from quire.streaming import profiles as P
    users = spark.range(40).selectExpr(
        "id", "concat('u', id, '@example.com') as email", "'{}' as raw_user_meta_data",
        *[f"cast(null as timestamp_ntz) as {c}" for c in ("last_sign_in_at", "created_at", "email_confirmed_at", "confirmed_at")], "id as seq")
    table = shared_path(spark, "t-profiles")
    spark.createDataFrame([(3, "kept", "editor", None, False)], P.PROFILE_SCHEMA).write.parquet(table)
    batches, sink = [], P.profile_sink

    def counting(path):
        write = sink(path)

        def one(batch, n):
            batches.append(batch.count())
            write(batch, n)
        return one
    monkeypatch.setattr(P, "profile_sink", counting)
    got = P.replay_profiles(spark, users.repartition(4), 2, table).collect()
    assert sorted(r.id for r in got) == list(range(40)) and {r.id: r.nome for r in got}[3] == "kept"
    assert batches == [20, 20]

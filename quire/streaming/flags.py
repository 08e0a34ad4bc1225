"""The provisional flag per person, kept current as flag events arrive
(V9 as a streaming aggregation: the latest event per person wins).

The streaming aggregate keeps one (flag, ts, event_id) per person in state and
emits, per micro-batch, only the people it changed (update mode). Each
batch's changes are one delta folder, named by the batch's number and
overwritten when the batch runs again; the current flags are the latest delta
row per person (a partial ``max_by`` over the deltas).

Deltas are merged by levels: the folder ``level=k/upto=e`` holds the latest row
per person of ``FAN`` to the power k batches up to batch e, made of ``FAN``
folders of the level below when that batch is done. So a person's row is written
once a level, not once a batch, and a reader opens at most ``FAN`` folders of
each level. Which folders are merged depends on the batch number alone, and a
merge only reads numbers up to its own: after a failure the same merge runs
again. A folder counts once its job's ``_SUCCESS`` is there, until then readers
take the folders below it. Folders that a merge replaced stay for readers that
opened them, and for the retention policy of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import conf_override, default_state_partitions, shared_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, flag boolean"
DELTA_SCHEMA = "user_id long, flag boolean, ts timestamp_ntz, event_id long"
#: Folders of a level that are merged into one of the next.
FAN = 4


def latest_flags(events: DataFrame) -> DataFrame:
    """Streaming aggregate: state is one (flag, ts, event_id) per person."""
    return events.groupBy("user_id").agg(
        F.max_by(F.struct("flag", "ts", "event_id"), F.struct("ts", "event_id")).alias("last"))


def _folder(root: str, level: int, upto: int) -> str:
    return f"{root}/level={level}/upto={upto}"


def _done(spark: SparkSession, folder: str) -> bool:
    """Whether the job that wrote the folder was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _latest(deltas: DataFrame) -> DataFrame:
    packed = F.struct("flag", "ts", "event_id")
    return deltas.groupBy("user_id").agg(F.max_by(packed, F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")


def merge_levels(spark: SparkSession, root: str, epoch: int, fan: int = FAN) -> None:
    """The merges that are due once batch ``epoch`` is written."""
    level, width = 1, fan
    while (epoch + 1) % width == 0:
        step = width // fan
        below = [_folder(root, level - 1, epoch - i * step) for i in range(fan)]
        _latest(spark.read.schema(DELTA_SCHEMA).parquet(*below)).write.mode("overwrite").parquet(_folder(root, level, epoch))
        level, width = level + 1, width * fan


def delta_sink(root: str, fan: int = FAN):
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.select("user_id", F.col("last.flag").alias("flag"), F.col("last.ts").alias("ts"),
                     F.col("last.event_id").alias("event_id")).write.mode("overwrite").parquet(_folder(root, 0, epoch_id))
        merge_levels(batch.sparkSession, root, epoch_id, fan)
    return write


def delta_folders(spark: SparkSession, root: str, fan: int = FAN) -> list[str]:
    """The folders that hold the current flags: from the first batch on, each time
    the largest finished merge that begins there."""
    out, at = [], 0
    while True:
        level, width = 0, 1
        while at % (width * fan) == 0 and _done(spark, _folder(root, level + 1, at + width * fan - 1)):
            level, width = level + 1, width * fan
        folder = _folder(root, level, at + width - 1)
        if level == 0 and not _done(spark, folder):
            return out
        out.append(folder)
        at += width


def current_flags(spark: SparkSession, root: str, fan: int = FAN) -> DataFrame:
    """Latest flag per person over all deltas."""
    folders = delta_folders(spark, root, fan)
    deltas = spark.read.schema(DELTA_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], DELTA_SCHEMA)
    return _latest(deltas).select("user_id", "flag")


def run_flags(spark: SparkSession, events_path: str, profiles: DataFrame, files_per_trigger: int = 1,
              state_partitions: int | None = None) -> DataFrame:
    root = shared_path(spark, "t3-flags")
    ckpt = shared_path(spark, "t3-ckpt")
    ev = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)
    n = state_partitions or default_state_partitions(spark)
    with conf_override(spark, {"spark.sql.shuffle.partitions": n}):
        q = latest_flags(ev).writeStream.outputMode("update").foreachBatch(delta_sink(root)) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    f = current_flags(spark, root).select(F.col("user_id").alias("id"), "flag")
    p = profiles.select("id", "senha_provisoria")
    return p.join(f, "id", "left").select("id", F.coalesce("flag", "senha_provisoria", F.lit(False)).alias("provisional"))

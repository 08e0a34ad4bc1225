"""Profiles created as users arrive (U1 + J6 per micro-batch).

``foreachBatch`` derives the batch's profiles and appends only ids the
profile table does not hold yet (an anti join against the table), so a
replayed batch inserts nothing twice. The ids of the table are read once per
batch and meet the batch in a shuffle, never on the driver; a batch is a whole
commit, of any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.people import PROFILE_COLS, derive_profiles
from quire.session import shared_path
from quire.streaming.writes import commits

USER_SCHEMA = ("id long, email string, raw_user_meta_data string, last_sign_in_at timestamp_ntz, "
               "created_at timestamp_ntz, email_confirmed_at timestamp_ntz, confirmed_at timestamp_ntz")
PROFILE_SCHEMA = "id long, nome string, papel string, email string, senha_provisoria boolean"


def profile_sink(table_path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema(PROFILE_SCHEMA).parquet(table_path).select("id")
        derived = derive_profiles(batch)
        packed = F.struct(*[c for c in PROFILE_COLS if c != "id"])
        firsts = derived.groupBy("id").agg(F.min_by(packed, packed).alias("_r")) \
            .select("id", *[F.col("_r")[c].alias(c) for c in PROFILE_COLS if c != "id"])
        firsts.join(have.hint("merge"), "id", "left_anti").select(*PROFILE_COLS).write.mode("append").parquet(table_path)
    return write


def run_profiles(spark: SparkSession, users_path: str, table_path: str, ckpt: str | None = None) -> DataFrame:
    """Process the files that arrived as one batch; the table afterwards. ``ckpt``
    is the stream's own folder, by which it knows the files it has read."""
    users = spark.readStream.schema(USER_SCHEMA).parquet(users_path)
    q = users.writeStream.foreachBatch(profile_sink(table_path)) \
        .option("checkpointLocation", ckpt or shared_path(spark, "t2-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(PROFILE_SCHEMA).parquet(table_path)


def replay_profiles(spark: SparkSession, users: DataFrame, parts: int, table_path: str) -> DataFrame:
    """T2 over users that arrive in ``parts`` commits by ``seq``, each processed as
    one batch before the next arrives."""
    inbox, ckpt = shared_path(spark, "t2-users"), shared_path(spark, "t2-ckpt")
    for commit in commits(users, parts, "t2-users"):
        commit.write.mode("append").parquet(inbox)
        table = run_profiles(spark, inbox, table_path, ckpt)
    return table

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.ordering import last_wins_by_key, ordered_lag, ordered_rank
from tests.conftest import rows


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([0, 0, 0, 1, 2, None]), s * 7 - 50, rnd.randint(0, 9)) for s in range(200)]
    return spark.createDataFrame(data, "k long, seq long, v int")


#: Chunk width and chunks of a block.
CUTS = [(1, 2), (3, 1), (16, 4), (5, 1 << 22), (1 << 20, 1 << 22)]


@pytest.mark.parametrize("width,fan", CUTS)
def test_rank_equals_window(log, width, fan):
    got = ordered_rank(log, "k", "seq", "rn", chunk_width=width, fan=fan)
    want = log.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("bigint"))
    assert rows(got, "k", "seq", "rn") == rows(want, "k", "seq", "rn")


@pytest.mark.parametrize("width,fan", CUTS)
def test_lag_equals_window(log, width, fan):
    got = ordered_lag(log, "k", "seq", ["v", "seq"], "p_", chunk_width=width, fan=fan)
    w = Window.partitionBy("k").orderBy("seq")
    want = log.withColumn("p_v", F.lag("v").over(w)).withColumn("p_seq", F.lag("seq").over(w))
    assert rows(got, "k", "seq", "p_v", "p_seq") == rows(want, "k", "seq", "p_v", "p_seq")


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "x")], "id long, seq long, v string")
    assert rows(last_wins_by_key(df, "id", "seq")) == [(1, 3, "c"), (2, 5, "x")]


@pytest.mark.parametrize("width,fan", CUTS)
def test_as_of_equals_window(spark, log, width, fan):
    from quire.operators.ordering import ordered_last
    df = log.withColumn("f", (F.col("v") % 3) == 0)
    got = ordered_last(df, "k", "seq", ["v", "seq"], "f", "a_", chunk_width=width, fan=fan)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("a_v", F.last(F.when(F.col("f"), F.col("v")), ignorenulls=True).over(w)) \
             .withColumn("a_seq", F.last(F.when(F.col("f"), F.col("seq")), ignorenulls=True).over(w)) \
             .withColumn("a_count", F.count_if("f").over(w).cast("bigint"))
    cols = ("k", "seq", "a_v", "a_seq", "a_count")
    assert rows(got, *cols) == rows(want, *cols)


def test_sparse_order_values_leave_no_window_of_a_whole_key(spark):
    """4,000 rows of one key, a second apart in microseconds: every row is a chunk of
    its own, and the carry is cut into blocks."""
    from quire.operators.ordering import CHUNK, _carry, with_chunk
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 1_000_000 + 1_700_000_000_000_000).alias("seq"))
    per = with_chunk(df, "seq", 1000).groupBy("k", CHUNK).agg(F.count(F.lit(1)).alias("_q_n")).withColumn("_q_last", F.lit(None).cast("boolean"))
    assert per.count() == 4000
    blocks = per.groupBy("k", F.floor(F.col(CHUNK) / 64_000)).count()
    assert blocks.count() == 63 and blocks.agg(F.max("count")).first()[0] <= 64
    got = _carry(per, ["k"], 64_000).orderBy(CHUNK).select("_q_off").collect()
    assert [r[0] for r in got] == list(range(4000))
    far = df.union(spark.createDataFrame([(1, -5), (1, (1 << 63) - 1)], "k int, seq long"))
    assert [r.rn for r in ordered_rank(far, "k", "seq", "rn", 1000, 64_000).orderBy("seq").collect()] == list(range(1, 4003))

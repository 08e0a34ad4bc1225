"""T1 as the full row trigger: write requests and reloads arrive in commits, and
every commit leaves outcomes, before-images and new current rows.

Folders below one root, by commit number ``n``:

* ``log/n``       the commit as it arrived;
* ``outcomes/n``  one row per write: outcome, version, epoch of its document;
* ``history/n``   the before-image (epoch, version, document, time, author) of
  every row that the commit replaced;
* ``deltas/n``    the current rows of the documents that the commit changed;
* ``merged/m``    the current rows of all documents after commit ``m``.

The state is ``merged`` plus the deltas since, so a commit writes what it
changes; every ``MERGE_EVERY`` commits the deltas are merged into a new ``merged``
folder, which depends on the commit number alone. A commit only reads folders of
earlier numbers and overwrites its own: run again after a failure, it writes the
same rows. Within a commit the order of writes is ``seq``; the batch fold (V5 with
reloads) decides, starting from the state's versions, and only documents of the
commit are read from the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordering import DEFAULT_CHUNK
from quire.operators.versions import IMAGE_COLS, apply_log
from quire.session import cut_lineage, shared_path

LOG_SCHEMA = ("doc_id long, seq long, actor long, ts timestamp_ntz, expected_version int, load boolean, "
              "n_deals long, doc string")
ROW_SCHEMA = "doc_id long, epoch long, version int, doc string, n_deals long, updated_at timestamp_ntz, updated_by string"
OUTCOME_SCHEMA = "doc_id long, seq long, outcome string, version int"
HISTORY_SCHEMA = "hist_id long, " + ROW_SCHEMA
ROW_COLS = ["doc_id", "epoch", *IMAGE_COLS]
#: Commits after which the deltas are merged.
MERGE_EVERY = 8
#: Rows of a commit (about; a commit is a range of seq).
COMMIT_ROWS = 1_000_000


class Trigger:
    """The state of a stream of commits in one shared folder."""

    def __init__(self, spark: SparkSession, root: str, profiles: DataFrame, merge_every: int = MERGE_EVERY,
                 chunk_width: int = DEFAULT_CHUNK):
        self.spark, self.root, self.profiles = spark, root, profiles
        self.merge_every, self.chunk_width = merge_every, chunk_width

    def start(self, base: DataFrame) -> "Trigger":
        """Take over the given current rows (doc_id, version, doc, n_deals,
        updated_at, updated_by and, if there is one, epoch)."""
        if "epoch" not in base.columns:
            base = base.withColumn("epoch", F.lit(0).cast("bigint"))
        base.select(*ROW_COLS).write.mode("overwrite").parquet(f"{self.root}/merged/-1")
        return self

    def _state(self, n: int) -> tuple[DataFrame, list[DataFrame]]:
        """Rows before commit n: the last merged folder and the deltas since."""
        m = n // self.merge_every * self.merge_every - 1
        read = self.spark.read.schema(ROW_SCHEMA)
        return read.parquet(f"{self.root}/merged/{m}"), [
            read.parquet(f"{self.root}/deltas/{i}").withColumn("_at", F.lit(i)) for i in range(m + 1, n)]

    @staticmethod
    def _latest(merged: DataFrame, deltas: list[DataFrame]) -> DataFrame:
        rows = merged.withColumn("_at", F.lit(-1))
        for d in deltas:
            rows = rows.unionByName(d)
        packed = F.struct(*[c for c in ROW_COLS if c != "doc_id"])
        return rows.groupBy("doc_id").agg(F.max_by(packed, "_at").alias("_r")).select("doc_id", "_r.*")

    def current(self, n: int) -> DataFrame:
        """Current rows of all documents before commit ``n``."""
        return self._latest(*self._state(n))

    def commit(self, batch: DataFrame, n: int) -> None:
        log = f"{self.root}/log/{n}"
        batch.write.mode("overwrite").parquet(log)
        w = self.spark.read.schema(LOG_SCHEMA).parquet(log)
        merged, deltas = self._state(n)
        touched = w.select("doc_id").distinct()
        before = self._latest(merged.join(touched, "doc_id", "left_semi"),
                              [d.join(touched, "doc_id", "left_semi") for d in deltas])
        before = cut_lineage(before.select(*ROW_COLS), "rows-before")
        outcomes, history, current = apply_log(w, self.profiles, before, self.chunk_width)
        outcomes.select("doc_id", "seq", "outcome", "version").write.mode("overwrite").parquet(f"{self.root}/outcomes/{n}")
        history.select("hist_id", *ROW_COLS).write.mode("overwrite").parquet(f"{self.root}/history/{n}")
        # documents whose row this commit replaced, by a write or a load
        changed = outcomes.where(F.col("outcome").isin("applied", "loaded")).select("doc_id").distinct()
        current.join(changed, "doc_id", "left_semi").select(*ROW_COLS).write.mode("overwrite").parquet(f"{self.root}/deltas/{n}")
        if (n + 1) % self.merge_every == 0:
            read = self.spark.read.schema(ROW_SCHEMA)
            delta = read.parquet(f"{self.root}/deltas/{n}").withColumn("_at", F.lit(n))
            self._latest(merged, [*deltas, delta]).write.mode("overwrite").parquet(f"{self.root}/merged/{n}")

    def run(self, log_path: str) -> int:
        """Process the files that arrived as one commit; the number of commits so
        far. (A batch holds whole commits, however many files a commit has.)"""
        stream = self.spark.readStream.schema(LOG_SCHEMA).parquet(log_path)
        q = stream.writeStream.foreachBatch(self.commit).option("checkpointLocation", f"{self.root}/ckpt") \
            .trigger(availableNow=True).start()
        q.awaitTermination()
        last = q.lastProgress
        self.commits = max(getattr(self, "commits", 0), last["batchId"] + 1 if last and last["numInputRows"] else 0)
        return self.commits

    def _all(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for n in range(getattr(self, "commits", 0)):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{n}"))
        return out

    def outcomes(self) -> DataFrame:
        return self._all("outcomes", OUTCOME_SCHEMA)

    def history(self) -> DataFrame:
        return self._all("history", HISTORY_SCHEMA)


def replay(spark: SparkSession, w: DataFrame, profiles: DataFrame, base: DataFrame, parts: int,
           merge_every: int = MERGE_EVERY, chunk_width: int = DEFAULT_CHUNK) -> Trigger:
    """The log as commits in seq order, ``parts`` of them or as many more as
    ``COMMIT_ROWS`` needs, each processed before the next arrives."""
    inbox = shared_path(spark, "trigger-inbox")
    trigger = Trigger(spark, shared_path(spark, "trigger"), profiles, merge_every, chunk_width).start(base)
    names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
    w = cut_lineage(w.select(*names), "trigger-log")
    parts = max(parts, -(-w.count() // COMMIT_ROWS))
    shares = [i / parts for i in range(1, parts)]
    cuts = w.agg(F.percentile_approx("seq", shares, max(10_000, 10 * parts))).first()[0] if shares else []
    cuts = [None, *sorted(set(cuts or [])), None]
    for a, b in zip(cuts, cuts[1:]):
        after = F.lit(True) if a is None else F.col("seq") > a
        upto = F.lit(True) if b is None else F.col("seq") <= b
        w.where(after & upto).write.mode("append").parquet(inbox)
        trigger.run(inbox)
    return trigger

"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (oracle parity), AQE for
# runtime coalescing and skew-join splitting.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(master: str | None = None, cpus: int | None = None,
              app: str = "quire", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        n = cpus or os.cpu_count() or 8
        conf.setdefault("spark.sql.shuffle.partitions", str(n))
        conf.setdefault("spark.ui.enabled", "false")
        conf.setdefault("spark.ui.showConsoleProgress", "false")
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, _DEFAULTS[k])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session. Only a local-mode session without one (tests)
    gets a fresh folder of its own; a cluster without the setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="quire-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quire/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "stage"):
    """Materialise ``df`` as a parquet table in the shared folder and read it
    back: the plan above is computed once, later readers scan the table, and
    a lost executor re-reads files instead of replaying the lineage (never
    ``localCheckpoint``, never a machine-local folder)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


class conf_override:
    """Temporarily set session options (e.g. the state partition count a
    streaming query fixes at start), restoring the previous values."""

    def __init__(self, spark: SparkSession, options: dict):
        self.spark, self.options, self.saved = spark, options, {}

    def __enter__(self):
        for k, v in self.options.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, str(v))
        return self

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


def default_state_partitions(spark: SparkSession) -> int:
    """One state partition per executor core: stateful streaming does not get
    AQE's partition coalescing, so 200 tiny state stores per batch on a small
    cluster (or 8 cores) cost more than the state itself."""
    return max(1, spark.sparkContext.defaultParallelism)


def dealt(df, *cols: str):
    """``df`` dealt out by ``cols`` into as many partitions as a shuffle has. AQE
    puts partitions together by their compressed size, and a number in the plan
    keeps it from that: short keys are a small part of the memory that the table
    of them takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in the Python workers (what ``--py-files``
    does at submit time): Python steps such as ``applyInPandas`` unpickle
    functions by module name. The package is zipped once per application
    into the shared folder and added with ``addPyFile``. A shared folder on a
    non-local file system is left alone: there the package is deployed with
    the job (``--py-files`` / an installed wheel)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import io
    import zipfile

    import quire
    folder = shared_path(spark, "pyfiles")
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    if "://" in local:
        _SHIPPED.add(sc.applicationId)
        return
    pkg = os.path.dirname(os.path.abspath(quire.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    os.makedirs(local, exist_ok=True)
    target = os.path.join(local, "quire.zip")
    with open(target, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)

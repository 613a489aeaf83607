"""Session helpers: building a local session for tests/bench and locating the
shared checkpoint folder of a cluster session."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants; a cluster session passed in by a caller
# keeps whatever its owner configured.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    # checkpointed light frames (id offsets) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ragtide", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and the bench.  On a cluster, the caller
    builds its own session and passes it to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def recommended_conf(input_bytes: int, total_cores: int,
                     partition_bytes: int = 256 * 1024 * 1024,
                     shuffle_bytes: int | None = None) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of parquet.

    Scan splits of ``partition_bytes`` keep a task's input well inside an
    executor core's memory share.  The shuffle partition count is the
    expected shuffled volume divided by the same target, and at least two
    waves of the cluster's cores.  By default the volume is a tenth of the
    input: these plans shuffle projections, partial aggregates and light
    per-document frames, not the text.  AQE coalesces the partitions that
    turn out small and splits skewed join partitions.
    ``spark.checkpoint.dir`` is the cluster's shared folder and is not set
    here."""
    volume = input_bytes // 10 if shuffle_bytes is None else shuffle_bytes
    shuffle = max(2 * total_cores, math.ceil(volume / partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that ``spark.checkpoint.dir`` names, if any.  It is the
    folder itself: the context's own checkpoint folder is a random one
    inside it, another for every session."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; only when none is configured
    (local tests) create a scratch one under /tmp.  A context that has its
    folder keeps it."""
    sc = spark.sparkContext
    d = checkpoint_dir(spark) or sc.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="ragtide-ckpt-", dir=os.environ.get("RAGTIDE_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Shared tables written inside the block are removed at its end: for jobs
    that run again and again and have written their own result by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _SCRATCH.pop():
            p = hadoop(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder."""
    root = (checkpoint_dir(spark) or ensure_checkpoint_dir(spark)).rstrip("/")
    path = f"{root}/table-{uuid.uuid4().hex[:12]}-{name}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written as Parquet under the shared checkpoint folder and read
    back, so several passes over it do not repeat its work and a lost
    executor loses nothing.  The cluster clears that folder as it does for checkpoints
    (or see ``scratch_tables``)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``ragtide`` importable in the Python workers (broadcast payloads
    and Arrow batch functions refer to its classes): zip the package once
    per SparkContext and ``addPyFile`` it, as ``--py-files`` would.  The zip
    is written on the driver only; Spark ships it to every executor."""
    try:
        sc = spark.sparkContext
    except Exception:          # sessions without a SparkContext handle
        return
    if getattr(sc, "_ragtide_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="ragtide-pyfiles-"), "ragtide.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._ragtide_shipped = True

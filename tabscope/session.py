"""SparkSession construction and lineage helpers.

On a cluster the session comes from the platform; ``get_spark`` is for tests,
the bench and local runs.  Checkpoints go to ``spark.checkpoint.dir`` as the
cluster names it; a folder of our own is set only when none is configured.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "tabscope",
              shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("TABSCOPE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABSCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tune_session(spark)
    return spark


# Runtime SQL settings the operators rely on, applied only where still at Spark's default.
# One-pass multi-statistic aggregates (every pairwise corr, all missing counts)
# carry more than 100 buffer fields; above ``maxFields`` whole-stage codegen is
# switched off and the aggregate runs interpreted (about 8x slower measured).
_TUNING = {"spark.sql.codegen.maxFields": ("100", "2000")}


def tune_session(spark: SparkSession) -> None:
    for key, (default, value) in _TUNING.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is made only if unset and in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None) \
        or sc.getConf().get(_CKPT_KEY, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CKPT_KEY} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tabscope-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set(_CKPT_KEY, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, calls: list[Callable], at_once: int = 4) -> list:
    """The results of ``calls``, in order, ``at_once`` running at a time; the first failure is raised.

    An iterative fit is a chain of short jobs with a few tasks each, which alone leaves most cores idle.  Each fit keeps its
    trees on the driver, so only a few go side by side.
    """
    from pyspark import inheritable_thread_target
    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]
        try:
            return [r.result() for r in running]
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

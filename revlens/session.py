"""Session helpers: a local session for tests/bench, and the shared checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system).  Only when the session has none (tests, a bare local run) do we
set one ourselves.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import weakref

from pyspark.sql import SparkSession

#: Whether Spark deletes the shuffle files of a query as soon as it ends, instead of when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = threading.Lock()
_writing: weakref.WeakKeyDictionary[SparkSession, int] = weakref.WeakKeyDictionary()  # writes under way that set SHUFFLE_CLEANUP


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "revlens", extra: dict[str, str] | None = None
) -> SparkSession:
    """A local-mode session configured like the tests and the bench expect."""
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder; a local one is set only in local mode, where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the server-side setting applies
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    target = configured or tempfile.mkdtemp(prefix="revlens-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """For writing a table that is read back: the shuffle files of the write go when it ends.

    Else those of all steps of a job add up, for as long as the driver's heap has room.
    """
    with _LOCK:
        if spark not in _writing and spark.conf.get(SHUFFLE_CLEANUP, "false") == "true":
            ours = False  # the session's own choice stays
        else:
            ours = True
            _writing[spark] = _writing.get(spark, 0) + 1
            spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            if ours:
                _writing[spark] -= 1
                if not _writing[spark]:
                    del _writing[spark]
                    spark.conf.unset(SHUFFLE_CLEANUP)


def session_key(spark: SparkSession) -> str:
    """Identifies the running application (for per-session caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def freeze(df):
    """Cut lineage with a reliable checkpoint (survives executor loss, fixes range bounds)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session helpers.

The library never builds its own cluster configuration: callers hand in a
``SparkSession``.  ``local_session`` is only for tests, the bench and the
driver smoke check.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # CPU-heavy stages (tokenising, per-key windows) want more, smaller post-shuffle partitions
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "churnlab") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CHURNLAB_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the setting must point to shared storage and is only read.
    Only when it is unset on a local master (tests, bench) a fresh scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a driver-side context
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not str(master).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="churnlab-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # noqa: BLE001 - static conf in some deployments
            pass
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    return conf_dir


def cut_lineage(df):
    """Cut lineage by writing a parquet table into the shared checkpoint folder and reading it back.

    Survives executor loss (never localCheckpoint), is columnar (later reads prune columns and push
    filters), and the planner sizes it from its files, so a large intermediate is never mistaken
    for a broadcastable one.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lineage/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require_small(df, max_rows: int, what: str) -> int:
    """Count ``df`` and refuse sizes that are not meant to be broadcast (samples, catalogues)."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{what} has {n} rows; at most {max_rows} are broadcast")
    return n

"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC semantics, adaptive execution (partition coalescing,
# skew-join splitting, runtime join re-planning) and Arrow for the few Python steps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Generated code for wide event rows can exceed HotSpot's 8 KB "huge method" cut-off,
    # which would leave it un-JIT-compiled; let the JIT compile it.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "logspark", cpus: str | int = "*", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter owns the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (8 if cpus == "*" else cpus))
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only for a local master that leaves the setting unset (tests);
    on a cluster an unset folder is an error, since executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = known.get() if known.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="logspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared folder (never reused between runs)."""
    base = shared_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder; its lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, so that later steps read the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

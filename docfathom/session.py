"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a caller's cluster normally leaves at their defaults. Memory, core
# counts and shuffle partitions stay with the cluster.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of one Arrow batch between the JVM and a Python worker, so that a few
#: very long texts do not meet in one batch. A single longer text has its own.
BATCH_BYTES = "16m"

_shipped: dict[str, str] = {}


def build_session(
    app_name: str = "docfathom",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Spark hand this package to the Python workers, once per application.

    Functions run by workers import it there, wherever they were started.
    """
    context = spark.sparkContext
    if _shipped.get("application") != context.applicationId:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="docfathom-")) / "docfathom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped["application"] = context.applicationId
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Limit Arrow batches by bytes where the session does not say otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (None, "67108864b", str(1 << 28), "256MB", str((1 << 63) - 1)):
        spark.conf.set(key, BATCH_BYTES)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster, executors could not read each other's files in it.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="docfathom-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage, so later uses do not recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

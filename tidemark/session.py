"""Session construction and the few session-level facts the operators need."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

#: Removes a query's shuffle files as soon as the query has ended, not when the driver happens to collect garbage.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: After so many stored results those no longer in use are looked for; each has a file for every partition.
COLLECT_EVERY = 12


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; extra ``conf`` wins.

    Only settings the operators rely on are fixed here (UTC, AQE with skew
    joins).  Sizing is left to the cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        RELEASE_SHUFFLES: "true",
        # call sites are captured for every column expression otherwise
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, so that they need no copy in their path.

    Once per Spark application; Spark itself copies the archive from the driver to
    the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-package-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tidemark", os.path.relpath(path, top)))
    context.addPyFile(archive)
    context._tidemark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder reliable checkpoints go to.

    What is stored there is not made again, so shuffle files are released from then on.
    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the master is local (tests, laptops) is a scratch folder created.
    """
    if spark.conf.get(RELEASE_SHUFFLES, None) is None:
        spark.conf.set(RELEASE_SHUFFLES, "true")
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before cutting lineage")
    folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an intermediate result reliably, so that its many readers do not recompute it."""
    context = df.sparkSession.sparkContext
    ensure_checkpoint_dir(df.sparkSession)
    context._tidemark_stored = getattr(context, "_tidemark_stored", 0) + 1
    if context._tidemark_stored % COLLECT_EVERY == 0:
        release_unused(context)
    return df.checkpoint(eager=True)


def release_unused(context: SparkContext) -> None:
    """Let Spark's cleaner remove stored results and broadcasts that nothing refers to any more.

    It learns of them when the driver collects garbage, as ``spark.cleaner.periodicGC.interval`` has it do every half hour.
    """
    context._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this run wrote, wherever the cluster keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

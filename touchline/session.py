"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and Arrow switched on.

    Nothing here names a cluster: memory, executors and
    ``spark.checkpoint.dir`` come from spark-submit or ``conf``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints nobody refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, made known to it if it wasn't."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="touchline-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder the cluster shares, and read it back.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset
    and everything runs in this one process (tests, a laptop) a temporary
    folder is made; on a cluster a machine's own folder would lose data with
    the machine, so there an unset folder is an error.

    What was shuffled for it is deleted when it is written; else those files
    hold disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    _checkpoint_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan of its own: no other action finds its files gone
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="touchline-ship-")  # the driver serves the file from here
    archive = shutil.make_archive(os.path.join(folder, "touchline"), "zip", root, "touchline")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)

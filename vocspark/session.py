"""Session helpers: folders for intermediate tables, and the package for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a temporary folder: on a cluster a machine-local
    path would not survive the loss of the machine, so that is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured is None:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="vocspark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one table written by an operator."""
    return f"{checkpoint_root(spark).rstrip('/')}/vocspark-{uuid.uuid4().hex}/{label}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver runs from; once per context.

    Spark serves the archive to the executors.  A package that already came as an archive, for
    instance with ``--py-files``, is left alone.
    """
    context, folder = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_vocspark_shipped", False) or not os.path.isdir(folder):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="vocspark-package-"), "vocspark")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(folder), os.path.basename(folder)))
    context._vocspark_shipped = True

"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: keep the folder the cluster names in
    ``spark.checkpoint.dir``; only where none is set and Spark runs in this process (tests,
    a laptop) use a new temporary folder that goes with it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="facetry-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.
    The copies survive lost executors. They go when the frame is no longer used if the
    cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``, else with the
    folder."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder (a URI, for Spark's own IO)."""
    import uuid

    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_folder` through Hadoop's file system API."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers
    can import it wherever the driver's working folder is."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="facetry-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "facetry_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.join("facetry", os.path.relpath(full, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)

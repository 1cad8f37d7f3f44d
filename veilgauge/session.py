"""What Python workers need of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once per application, so that Python workers need no path of their own."""
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_veilgauge_shipped", False):
        return
    top = Path(__file__).parent
    d = tempfile.mkdtemp(prefix="veilgauge-")  # the driver's own: executors fetch the file from the driver
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(f"{d}/veilgauge.zip", "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(f"{d}/veilgauge.zip")
    sc._veilgauge_shipped = True


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as machines do not share theirs.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilgauge-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/veilgauge-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, however often it is used."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan makes fewer tasks than there are (few files, large row groups); else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df

"""What a session needs: its Python workers find this package, and tables between jobs have a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers started from now on look for packages where this one lies. On a cluster
    that does not share that folder, the package is to be installed or added with ``addPyFile``."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names. Where it names none, a local session
    gets one on its disk, and a cluster, whose executors could not read that, an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="corpuslab-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in a shared folder and read back, for what several jobs use."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

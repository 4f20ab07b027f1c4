"""Where operators of several jobs cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder of ``spark.checkpoint.dir``; only a local master may do without the setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='terralens-')}")

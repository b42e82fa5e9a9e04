"""Sessions: where Python workers find this library; small inputs dealt to all cores."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let workers import the library from where the driver has it; harmless where it is installed or shipped already."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df written once to the folder that all executors share (spark.checkpoint.dir), its lineage cut; survives the loss of executors.

    Only a local session without such a folder gets one of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Bytes of input per core up to which spread() deals rows out.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files are so small that they may lie in fewer splits (one row group can't be split);
    larger inputs stay as they are, without a shuffle. For work that costs much more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL * cores else df

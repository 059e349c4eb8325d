"""The folder all executors share: checkpoints, and whatever a query writes and reads again.

It is the session's own checkpoint folder or the one named in spark.checkpoint.dir. Where neither is set, a local session
gets a temporary folder; any other raises, because a folder of one machine is lost with it. What was put there is deleted
when the application ends; with spark.cleaner.referenceTracking.cleanCheckpoints Spark drops checkpoints sooner.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


_marked: set[str] = set()


def base_folder(spark: SparkSession) -> str:
    """The folder of this application's checkpoints, one of its own within the folder that was set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docweave-"))
    folder = sc._jsc.sc().getCheckpointDir().get()
    if folder not in _marked:
        _marked.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    base_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_missing(e: AnalysisException) -> bool:
    """The path that was to be read does not exist."""
    return e.getCondition() == "PATH_NOT_FOUND"

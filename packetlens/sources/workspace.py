"""Where jobs put intermediate tables, stream checkpoints and lines to be streamed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


# The folder of the job that runs in this context, where its intermediate tables go.
_JOB: ContextVar[str | None] = ContextVar("job", default=None)


@contextmanager
def job_workspace(spark: SparkSession, purpose: str = "job") -> Iterator[str]:
    """Tables that ``materialize`` writes inside go with the job, when it ends and when it fails.

    A job must be done with them by then: what it returns is what it wrote elsewhere. Within another
    job's workspace this one's tables live as long as that job's.
    """
    outer = _JOB.get()
    if outer is not None:
        yield outer
        return
    folder = new_folder(spark, purpose)
    token = _JOB.set(folder)
    try:
        yield folder
    finally:
        _JOB.reset(token)
        delete_folder(spark, folder)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder of any file system that Spark reaches; False if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must see the folder, so a machine-local one is made only in local mode. What is
    put there stays; ``job_workspace`` is for what should go with a job.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = tempfile.mkdtemp(prefix="packetlens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """Where Spark checkpoints: the cluster's folder if it named one, else a new one of this session."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or new_folder(spark, "checkpoints"))
        folder = context.getCheckpointDir()
    return folder


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives the loss of executors and is columnar, so that later passes read
    only the columns they need.
    """
    job = _JOB.get()
    path = f"{job}/{purpose}-{uuid.uuid4().hex}" if job else new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True

"""Tables that one operator reads several times, written once to a folder that all executors share."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Writes that run at the same time; each is a job of its own.
AT_ONCE = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session that runs in one process may fall back on a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="capfolio-"))
    return context.getCheckpointDir()


def stage(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet and read again. The files are left to the folder's own cleaning."""
    path = f"{staging_folder(frame.sparkSession)}/stage-{uuid4().hex}"
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each frame staged, several at once, so that a small one does not wait for a large one.

    The shuffle files of a write are dropped when it ends, since nothing runs its plan again; they would otherwise
    stay beside those of all later steps until the driver happens to collect its garbage.
    """
    if not frames:
        return {}
    conf = next(iter(frames.values())).sparkSession.conf
    earlier = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return dict(zip(frames, pool.map(stage, frames.values()), strict=True))
    finally:
        conf.unset(CLEANUP) if earlier is None else conf.set(CLEANUP, earlier)

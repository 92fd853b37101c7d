"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Where nothing names a shared folder and the driver is the only machine, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's checkpoint folder. Without either an error, as a
    machine's own folder is seen by that machine alone; only a master of one machine gets a default."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(DEFAULT_SHARED)
        found = DEFAULT_SHARED
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; nothing if the session is gone."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new shared folder, which is deleted at the latest when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass

    atexit.register(end)
    return path


def stored(frame: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The frame, written once as Parquet and read back: its lineage is cut, and lost executors take nothing along. With
    ``by`` it is dealt to folders by some columns."""
    (frame.repartition(*by).write.partitionBy(*by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

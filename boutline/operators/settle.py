"""Cutting lineage where several branches of a later plan read the same derived rows."""

import re
import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder every executor can reach: the one the session names in ``spark.checkpoint.dir``. Where it names none (tests on one
    machine) a temporary folder is made and set for the session; on a cluster that is an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="boutline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so later branches read them instead of deriving them again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()

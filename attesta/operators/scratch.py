"""Where intermediate results go: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a task takes in a join or sort, where adaptive execution would give it what 64 MB of shuffled
#: data come to, which may be many millions.
TASK_ROWS = 1 << 20

def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset and the master is
    local (tests, a single machine) a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-"))
    return named or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tasks_for(read: DataFrame) -> int:
    """Tasks of ``TASK_ROWS`` rows each for a table as it is read, whose files tell how many it has; at least what runs at once."""
    return max(read.sparkSession.sparkContext.defaultParallelism, -(-read.count() // TASK_ROWS))

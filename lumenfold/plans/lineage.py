"""Cutting lineage and choosing partition counts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the reliable checkpoint folder.

    The folder is the session's `spark.checkpoint.dir`. Only a session without one that
    runs on one machine, as in tests, gets a temporary folder; on a cluster such a folder
    would not survive its machine, so a session without one raises there. Executors may be
    lost afterwards.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, computed and cut, with a broadcast hint if it has at most so many rows, which are counted.

    The optimizer's estimate of a size is no bound: behind a join it is the product of both sides.
    """
    from pyspark.sql import functions as F

    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df

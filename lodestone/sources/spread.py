"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's cores where its scan has fewer partitions than that.

    A file of one row group is one task, however many cores there are.  Inputs
    of at least as many partitions as cores, thus all large ones, are left as
    they are, and so is what comes of a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df._jdf.queryExecution()
    if "Exchange" in planned.executedPlan().toString():  # dealt already; and asking would run its stages
        return df
    return df if planned.toRdd().getNumPartitions() >= cores else df.repartition(cores)

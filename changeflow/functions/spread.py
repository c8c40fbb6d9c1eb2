"""How wide to lay out stages that run Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def python_tasks(df: DataFrame) -> int:
    """The session's shuffle width, given explicitly.

    An explicit width is left alone by adaptive coalescing, which goes by bytes: rows that
    are few bytes but much Python work would otherwise end up in a task or two.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

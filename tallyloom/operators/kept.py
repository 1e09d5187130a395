"""Tables that a query reads several times and that are made once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, whose rows stay on the executors' disks from their first use on. Nothing runs here. What an earlier call kept for
    an equal df is dropped, since the tables under it may have changed."""
    level = df.storageLevel
    if level.useDisk or level.useMemory:
        df.unpersist()
    return df.persist(StorageLevel.DISK_ONLY)

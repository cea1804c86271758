"""Fixing a DataFrame whose second evaluation could differ from its first."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def fixed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage: a checkpoint in the cluster's shared folder, or, where the session names none (tests), kept in this process."""
    if df.sparkSession.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)

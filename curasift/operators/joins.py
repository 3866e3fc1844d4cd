"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we broadcast by hint, in bytes of the optimizer's estimate.
MAX_BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when the optimizer's own size estimate is within
    the bound.  No job runs: an input of unknown or larger size keeps the plain
    join, which AQE may still convert from run-time sizes."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def dealt_by_key(df: DataFrame, key: str) -> DataFrame:
    """The rows with a key, dealt by it.  Branches that read all columns of the result share one
    exchange (what makes the columns is done once), and need no other to group or join by the
    key.  Null keys go, so that no branch gets a filter of its own below the exchange."""
    return df.where(F.col(key).isNotNull()).repartition(key)

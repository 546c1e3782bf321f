"""Which cells a reader sees: TTL, tombstones, then ties of one timestamp.

All windows are over (row, family) or finer, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT

#: A wide row is one window group; it holds one row's cells of one family.
FAMILY = ("row", "family")
COLUMN = ("row", "family", "qualifier")


def live(cells: DataFrame, now_ms: int | None = None, ttl: dict[str, int] | None = None, snapshot: int | None = None) -> DataFrame:
    """Cells at a write position (``seq <= snapshot``) and not older than their TTL (seconds)."""
    if snapshot is not None:
        cells = cells.where(F.col("seq") <= snapshot)
    if ttl:
        if now_ms is None:
            raise ValueError("a TTL needs the time it is compared with")
        limit = F.lit(None).cast("long")
        for family, seconds in ttl.items():
            limit = F.when(F.col("family") == family, F.lit(now_ms - seconds * 1000)).otherwise(limit)
        cells = cells.where(limit.isNull() | (F.col("ts") >= limit))
    return cells


def unmasked(cells: DataFrame) -> DataFrame:
    """Puts that no tombstone hides: of the family or column up to its time, of a version at it."""
    ts_of = lambda kind: F.when(F.col("type") == kind, F.col("ts"))
    hidden = cells.withColumns(
        {
            "_df": F.max(ts_of(DELETE_FAMILY)).over(W.partitionBy(*FAMILY)),
            "_dc": F.max(ts_of(DELETE_COLUMN)).over(W.partitionBy(*COLUMN)),
            "_dv": F.max(F.when(F.col("type") == DELETE, 1)).over(W.partitionBy(*COLUMN, "ts")),
        }
    )
    seen = (F.col("type") == PUT) & (F.col("_df").isNull() | (F.col("ts") > F.col("_df"))) & (F.col("_dc").isNull() | (F.col("ts") > F.col("_dc"))) & F.col("_dv").isNull()
    return hidden.where(seen).drop("_df", "_dc", "_dv")


def newest_write(cells: DataFrame) -> DataFrame:
    """Of cells with the same coordinates and timestamp the latest write."""
    w = W.partitionBy(*COLUMN, "ts").orderBy(F.desc("seq"))
    return cells.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(cells: DataFrame, n: int | None, family_caps: dict[str, int] | None = None) -> DataFrame:
    """At most n newest versions a column, and no more than its family keeps."""
    if n is None and not family_caps:
        return cells
    cap = F.lit(n if n is not None else (1 << 31) - 1)
    for family, k in (family_caps or {}).items():
        cap = F.when(F.col("family") == family, F.least(cap, F.lit(k))).otherwise(cap)
    w = W.partitionBy(*COLUMN).orderBy(F.desc("ts"))
    return cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")

"""Compile a scan to a DataFrame in the fixed order of the stages.

row range and families -> TTL -> tombstones -> time range -> cell filters -> columns,
same-time ties, versions -> row filters -> limit.  The lower time bound is also applied
before the tombstones (older markers can't matter), the upper one never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import split_stages
from .model import CELL, LATEST, Scan
from .visible import live, newest_write, unmasked, versions


def _in_rows(scan: Scan) -> list[Column]:
    row = F.col("row")
    if scan.is_get:
        out = [row == F.lit(scan.start)]
    else:
        out = [row >= F.lit(scan.start)] * bool(scan.start) + [row < F.lit(scan.stop)] * bool(scan.stop)
    if scan.filter is not None and (r := scan.filter.row_range()):
        out += [row >= F.lit(r[0])] * bool(r[0]) + [row < F.lit(r[1])] * (r[1] is not None)
    return out


def _in_columns(scan: Scan) -> Column | None:
    if not scan.columns:
        return None
    keep = F.lit(False)
    for family, qualifiers in scan.columns.items():
        own = F.col("family") == family
        keep = keep | (own if qualifiers is None else own & F.col("qualifier").isin(*map(F.lit, sorted(qualifiers))))
    return keep


def visible_cells(cells: DataFrame, scan: Scan = Scan(), now_ms: int | None = None, ttl: dict[str, int] | None = None, caps: dict[str, int] | None = None, snapshot: int | None = None) -> DataFrame:
    """Cells (row, family, qualifier, ts, value) that a scan returns, unordered."""
    for c in _in_rows(scan):
        cells = cells.where(c)
    if scan.columns:
        cells = cells.where(F.col("family").isin(*scan.columns))
    if scan.time_min > 0:
        cells = cells.where(F.col("ts") >= scan.time_min)
    cells = live(cells, now_ms, ttl, snapshot)
    if scan.raw:
        # tombstones stay beside what they hide
        return cells.where((F.col("ts") >= scan.time_min) & (F.col("ts") < scan.time_max) if scan.time_max < LATEST else F.lit(True))
    seen = unmasked(cells)
    if scan.time_max < LATEST:
        seen = seen.where(F.col("ts") < scan.time_max)
    early, late = split_stages(scan.filter)
    for c in early:
        seen = seen.where(c)
    if (c := _in_columns(scan)) is not None:
        seen = seen.where(c)
    seen = versions(newest_write(seen), scan.max_versions, caps).select(*CELL)
    for f in late:
        seen = f.apply(seen)
    if scan.limit is not None:
        last = seen.select("row").distinct().orderBy("row").limit(scan.limit).agg(F.max("row"))
        seen = seen.where(F.col("row") <= last.scalar()) if scan.limit > 0 else seen.limit(0)
    return seen


#: Rows that are named in the scan itself; more are met by a join.
NAMED_ROWS = 1000
#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def of_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored cells of the rows in a column ``row``.

    All windows of a read are within a row, so this goes before them.  A few rows become a
    predicate that the files are read with; more are broadcast up to a counted bound, and
    joined on the row beyond it.
    """
    asked = rows.select("row").where("row is not null").distinct()
    few = [bytes(r["row"]) for r in asked.limit(NAMED_ROWS + 1).collect()]
    if len(few) <= NAMED_ROWS:
        return cells.where(F.col("row").isin(*map(F.lit, few))) if few else cells.limit(0)
    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return cells.join(F.broadcast(asked) if small else asked, "row", "left_semi").select(cells.columns)


def in_order(cells: DataFrame) -> DataFrame:
    return cells.orderBy("row", "family", "qualifier", F.desc("ts"))


def results(cells: DataFrame, batch: int = 0) -> DataFrame:
    """One Result a row (or a batch of a row's cells): row, part, cells in order."""
    part = F.lit(0)
    if batch > 0:
        w = W.partitionBy("row").orderBy("family", "qualifier", F.desc("ts"))
        part = F.floor((F.row_number().over(w) - 1) / batch).cast("int")
    packed = F.struct("family", "qualifier", (-F.col("ts")).alias("age"), "ts", "value")
    grouped = cells.withColumn("part", part).groupBy("row", "part").agg(F.array_sort(F.collect_list(packed)).alias("cells"))
    return grouped.withColumn("cells", F.transform("cells", lambda c: F.struct(c["family"].alias("family"), c["qualifier"].alias("qualifier"), c["ts"].alias("ts"), c["value"].alias("value"))))


# -- what a Result offers, as expressions on its cells ---------------------------------
def column_versions(family: str, qualifier: bytes) -> Column:
    return F.filter("cells", lambda c: (c["family"] == family) & (c["qualifier"] == F.lit(qualifier)))


def column_latest(family: str, qualifier: bytes) -> Column:
    return F.get(column_versions(family, qualifier), F.lit(0))


def value_of(family: str, qualifier: bytes) -> Column:
    return column_latest(family, qualifier)["value"]


def contains_column(family: str, qualifier: bytes) -> Column:
    return F.size(column_versions(family, qualifier)) > 0


def family_map(family: str) -> Column:
    """qualifier -> newest value of the family."""
    own = F.filter("cells", lambda c, i: (c["family"] == family) & ~F.coalesce(F.get(F.col("cells"), i - 1)["qualifier"].eqNullSafe(c["qualifier"]) & (F.get(F.col("cells"), i - 1)["family"] == family), F.lit(False)))
    return F.map_from_entries(F.transform(own, lambda c: F.struct(c["qualifier"], c["value"])))


def first_value() -> Column:
    return F.get(F.col("cells"), F.lit(0))["value"]


def is_empty() -> Column:
    return F.size("cells") == 0


def wide(cells: DataFrame, columns: list[tuple[str, bytes]]) -> DataFrame:
    """One column for each (family, qualifier), null where a row lacks it."""
    made = []
    for f, q in columns:
        own = (F.col("family") == f) & (F.col("qualifier") == F.lit(q))
        made.append(F.max_by("value", F.when(own, F.col("ts"))).alias(f"{f}:{q.decode()}"))
    return cells.groupBy("row").agg(*made)

"""Mutations as DataFrames of cells to append.

``state`` is the stored cells, ``now`` the time given to cells without one.  Nothing
here changes data: every function returns cells with positions in ``seq``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codecs import decode_number, encode_number
from ..plans.model import CELL_SCHEMA, DELETE, DELETE_COLUMN, DELETE_FAMILY, LATEST, PUT, Scan
from ..plans.scan import of_rows, visible_cells

MAX_ROW = 32767
MAX_VALUE = 10 << 20


def _cells(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])


def _numbered(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.lit(0))


def _at(now: int):
    return F.when(F.col("ts").isNull() | (F.col("ts") == LATEST), F.lit(now)).otherwise(F.col("ts"))


def puts(rows: DataFrame, now: int) -> DataFrame:
    """row, family, qualifier, value, and where given ts and seq (the order of writing)."""
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("long"))
    ok = (F.octet_length("row") > 0) & (F.octet_length("row") <= MAX_ROW) & (F.octet_length("value") <= MAX_VALUE)
    checked = F.when(ok | F.col("value").isNull(), F.col("row")).otherwise(F.raise_error(F.lit("a row of 1 to 32767 bytes and a value of at most 10 MB")).cast("binary"))
    return _cells(_numbered(rows).withColumns({"row": checked, "ts": _at(now), "type": F.lit(PUT), "value": F.coalesce("value", F.lit(b""))}))


def delete_rows(rows: DataFrame, families: list[str], now: int) -> DataFrame:
    """row (and ts): everything up to the time, in every family."""
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("long"))
    made = _numbered(rows).withColumn("family", F.explode(F.array(*map(F.lit, families))))
    return _cells(made.withColumns({"qualifier": F.lit(b""), "ts": _at(now), "type": F.lit(DELETE_FAMILY), "value": F.lit(None)}))


def delete_families(rows: DataFrame, now: int) -> DataFrame:
    """row, family (and ts)."""
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("long"))
    return _cells(_numbered(rows).withColumns({"qualifier": F.lit(b""), "ts": _at(now), "type": F.lit(DELETE_FAMILY), "value": F.lit(None)}))


def delete_columns(rows: DataFrame, now: int) -> DataFrame:
    """row, family, qualifier (and ts): all versions up to the time."""
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("long"))
    return _cells(_numbered(rows).withColumns({"ts": _at(now), "type": F.lit(DELETE_COLUMN), "value": F.lit(None)}))


def delete_versions(rows: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """row, family, qualifier (and ts): one version.

    Without a time it is the newest existing version, for the n-th repeat of a column the
    n-th newest; where there is none, the marker is at ``now``.
    """
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("long"))
    key = ["row", "family", "qualifier"]
    open_ones = _numbered(rows.where(F.col("ts").isNull() | (F.col("ts") == LATEST)).drop("ts")).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("seq")))
    have = visible_cells(of_rows(state, open_ones), Scan(max_versions=None)).select(*key, "ts").withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("ts"))))
    resolved = open_ones.join(have, [*key, "n"], "left").withColumn("ts", F.coalesce("ts", F.lit(now))).drop("n")
    timed = _numbered(rows.where(F.col("ts").isNotNull() & (F.col("ts") != LATEST)))
    return _cells(resolved.unionByName(timed.select(resolved.columns)).withColumns({"type": F.lit(DELETE), "value": F.lit(None)}))


def increments(rows: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """row, family, qualifier, amount: one new version with the sum; a missing column is 0.

    Amounts of a column are added up first, so a hot counter is summed where it is read.
    A sum beyond 64 bits wraps.
    """
    key = ["row", "family", "qualifier"]
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    added = rows.groupBy(*key).agg(F.sum(wide("amount")).alias("amount"))
    old = visible_cells(of_rows(state, rows)).select(*key, F.col("ts").alias("old_ts"), F.col("value").alias("old"))
    made = added.join(old, key, "left")
    bad = F.col("old").isNotNull() & (F.octet_length("old") != 8)
    base = F.when(bad, F.raise_error(F.lit("a counter has 8 bytes")).cast("long")).otherwise(F.coalesce(decode_number("old"), F.lit(0)))
    half, full = (F.lit(Decimal(1 << n)).cast("decimal(38,0)") for n in (63, 64))
    total = F.pmod(F.col("amount").cast("decimal(38,0)") + base.cast("decimal(38,0)") + half, full) - half
    return _cells(made.withColumns({"ts": F.greatest(F.lit(now), F.coalesce("old_ts", F.lit(now))), "type": F.lit(PUT), "value": encode_number(total), "seq": F.lit(0)}))


def check_and_mutate(checks: DataFrame, mutations: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells to append, (check, passed)).

    ``checks``: check, row, family, qualifier, expected (null or empty: the column must be
    absent).  ``mutations``: cells with a ``check``; they must be of the row checked.
    """
    key = ["row", "family", "qualifier"]
    now = visible_cells(of_rows(state, checks)).select(*key, F.col("value").alias("have"))
    empty = F.coalesce(F.octet_length("expected"), F.lit(0)) == 0
    ok = F.when(empty, F.coalesce(F.octet_length("have"), F.lit(0)) == 0).otherwise(F.coalesce(F.col("have") == F.col("expected"), F.lit(False)))
    passed = checks.join(now, key, "left").select("check", F.col("row").alias("_row"), ok.alias("passed"))
    good = mutations.join(passed.where("passed"), "check").withColumn("row", F.when(F.col("row") == F.col("_row"), F.col("row")).otherwise(F.raise_error(F.lit("the row checked and the row changed differ")).cast("binary")))
    return _cells(good), passed.select("check", "passed")


def compact(cells: DataFrame, major: bool, caps: dict[str, int], now: int | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """What a compaction leaves: a major one only what is visible, a minor one also the
    tombstones and what they hide, without expired cells and overwritten ties."""
    from ..plans.visible import live, newest_write, unmasked, versions

    kept = live(cells, now, ttl)
    if major:
        return _cells(versions(newest_write(unmasked(kept)), None, caps))
    w = W.partitionBy("row", "family", "qualifier", "ts", "type").orderBy(F.desc("seq"))
    return _cells(kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))

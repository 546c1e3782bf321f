"""Relational tables as cell tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import encode_number
from ..plans.model import CELL_SCHEMA, DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _key(c: str, n: int) -> Column:
    return F.lpad(F.col(c).cast("string"), n, "0").cast("binary")


def _shape(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def event_cells(spark: SparkSession, sf_dir: str, days: bool = False, deletes: bool = True, props: bool = False) -> DataFrame:
    """Users as rows, event types as columns of family ``e`` (value in cents, 8 bytes) and
    with ``props`` of family ``p``; tombstones are a fixed part of the event numbers."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    unit = 86_400_000_000 if days else 1000
    base = ev.select("event_id", _key("user_id", 8).alias("row"), F.col("event_type").cast("binary").alias("qualifier"), F.floor(_micros("ts") / unit).cast("long").alias("ts"), "value", "props")

    def cells(family: str, kind: Column, value: Column, seq: Column, qualifier: Column | None = None) -> DataFrame:
        return base.select("row", F.lit(family).alias("family"), qualifier if qualifier is not None else F.col("qualifier"), "ts", kind.alias("type"), value.alias("value"), seq.alias("seq"), "event_id")

    none = F.lit(None).cast("binary")
    out = cells("e", F.lit(PUT), encode_number(cents("value")), F.col("event_id"))
    if props:
        out = out.union(cells("p", F.lit(PUT), F.col("props").cast("binary"), F.col("event_id")))
    if deletes:
        one = cells("e", F.when(F.col("event_id") % 97 == 0, DELETE_COLUMN).otherwise(DELETE), none, F.col("event_id") + 1_000_000_000).where("event_id % 97 = 0 or event_id % 89 = 0")
        fam = cells("e", F.lit(DELETE_FAMILY), none, F.col("event_id") + 2_000_000_000, F.lit(b"").alias("qualifier")).where("event_id % 499 = 0")
        out = out.union(one).union(fam)
    return _shape(out)


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows, their attributes as columns of family ``c``."""
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = F.explode(F.array(*(F.struct(F.lit(n.encode()).alias("qualifier"), F.col(c).cast("string").cast("binary").alias("value")) for n, c in (("name", "c_name"), ("nation", "c_nationkey"), ("segment", "c_mktsegment")))))
    return _shape(cu.select(_key("c_custkey", 8).alias("row"), made.alias("c")).select("row", F.lit("c").alias("family"), "c.qualifier", F.lit(1).alias("ts"), F.lit(PUT).alias("type"), "c.value", F.lit(0).alias("seq")))


def shown(cells: DataFrame, number: bool = True) -> DataFrame:
    """Cells with text keys, the value as a number or as text."""
    from ..functions.codecs import decode_number

    v = decode_number("value") if number else F.col("value").cast("string")
    return cells.select(F.col("row").cast("string").alias("r"), F.col("family").alias("f"), F.col("qualifier").cast("string").alias("q"), "ts", v.alias("v"))

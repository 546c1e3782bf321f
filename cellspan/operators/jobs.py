"""Batch jobs over cells: counting, copying, comparing, indexing, grouping, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codecs import decode_number
from ..plans.filters import FirstKeyOnlyFilter
from ..plans.model import CELL, CELL_SCHEMA, PUT, Scan
from ..plans.scan import of_rows, visible_cells


def count_rows(cells: DataFrame) -> DataFrame:
    """Rows with a visible cell, as one row ``n``."""
    return visible_cells(cells).agg(F.count_distinct("row").alias("n"))


def row_counter(cells: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Rows whose first returned cell isn't empty."""
    first = FirstKeyOnlyFilter().apply(visible_cells(cells, scan))
    return first.where(F.octet_length("value") > 0).agg(F.count("*").alias("n"))


def as_puts(cells: DataFrame) -> DataFrame:
    """Visible cells as cells to store, their times kept."""
    return cells.withColumns({"type": F.lit(PUT), "seq": F.lit(0)}).select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])


def export_cells(cells: DataFrame, versions: int = 1, lo: int = 0, hi: int = (1 << 63) - 1, family: str | None = None) -> DataFrame:
    scan = Scan(max_versions=versions, time_min=lo, time_max=hi)
    return as_puts(visible_cells(cells, scan.add_family(family) if family else scan))


def import_cells(exported: DataFrame, rename: dict[str, str] | None = None, families: list[str] | None = None) -> DataFrame:
    """Cells of an export as cells to append, with their times and types, some families
    only and under other names."""
    out = exported.where(F.col("family").isin(*families)) if families else exported
    name = F.col("family")
    for old, new in (rename or {}).items():
        name = F.when(F.col("family") == old, F.lit(new)).otherwise(name)
    return out.withColumn("family", name).select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])


def copy_cells(cells: DataFrame, lo: int = 0, hi: int = (1 << 63) - 1, families: list[str] | None = None) -> DataFrame:
    """Newest versions in a window of time; ``old:new`` renames a family on the way."""
    scan, names = Scan(time_min=lo, time_max=hi), {}
    for f in families or []:
        old, _, new = f.partition(":")
        scan, names[old] = scan.add_family(old), new or old
    out = as_puts(visible_cells(cells, scan))
    for old, new in names.items():
        if old != new:
            out = out.withColumn("family", F.when(F.col("family") == old, new).otherwise(F.col("family")))
    return out


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """row and status: ``match``, ``value_differs``, ``keys_differ``, ``left_only``, ``right_only``.

    Rows are compared by digests of their cells, one row each: a wide row is a group of
    its own, and no table is gathered."""

    def digest(cells: DataFrame, side: str) -> DataFrame:
        key = F.sha2(F.concat_ws("\0", "family", F.hex("qualifier"), "ts"), 256)
        whole = F.sha2(F.concat_ws("\0", "family", F.hex("qualifier"), "ts", F.hex("value")), 256)
        lists = F.array_sort(F.collect_list(F.struct(key.alias("k"), whole.alias("v"))))
        return cells.groupBy("row").agg(lists.alias(side))

    both = digest(left, "a").join(digest(right, "b"), "row", "full_outer")
    keys = lambda c: F.transform(c, lambda x: x["k"])
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") == F.col("b"), "match").when(keys("a") == keys("b"), "value_differs").otherwise("keys_differ")
    return both.select("row", status.alias("status"))


def verify_copy(left: DataFrame, right: DataFrame, lo: int = 0, hi: int = (1 << 63) - 1, families: list[str] | None = None) -> DataFrame:
    """:func:`compare_tables` on the newest cells of a time range and of some families."""
    scan = Scan(time_min=lo, time_max=hi)
    for f in families or []:
        scan = scan.add_family(f)
    return compare_tables(visible_cells(left, scan), visible_cells(right, scan))


def good_and_bad(compared: DataFrame) -> DataFrame:
    """Good rows match in all keys (values may differ); rows of the right side only don't count."""
    good = F.col("status").isin("match", "value_differs")
    return compared.where("status <> 'right_only'").agg(F.count_if(good).alias("goodrows"), F.count_if(~good).alias("badrows"))


def build_index(cells: DataFrame, family: str, qualifiers: list[bytes], ts: int, index_family: str = "INDEX", index_qualifier: bytes = b"ROW") -> DataFrame:
    """qualifier ("index") and cells of its table: row = value, INDEX:ROW = original row."""
    scan = Scan(columns={family: frozenset(qualifiers)})
    found = visible_cells(cells, scan).where(F.octet_length("value") > 0)
    return found.select(F.col("qualifier").alias("index"), F.col("value").alias("row"), F.lit(index_family).alias("family"), F.lit(index_qualifier).alias("qualifier"), F.lit(ts).alias("ts"), F.lit(PUT).cast("byte").alias("type"), F.col("row").alias("value"), F.lit(0).cast("long").alias("seq"))


def index_lookup(index: DataFrame, cells: DataFrame, value: bytes) -> DataFrame:
    """Cells of the rows that an index lists under a value."""
    rows = index.where(F.col("row") == F.lit(value)).select(F.col("value").alias("row"))
    return cells.join(rows, "row", "left_semi")


def group_key(cells: DataFrame, columns: list[tuple[str, bytes]]) -> DataFrame:
    """row and key: the values of the columns in cell order, joined by spaces; rows that
    lack one of them are left out."""
    wanted = F.lit(False)
    for f, q in columns:
        wanted = wanted | ((F.col("family") == f) & (F.col("qualifier") == F.lit(q)))
    part = F.struct("family", "qualifier", F.col("value").cast("string").alias("v"))
    grouped = cells.where(wanted).groupBy("row").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.where(F.size("p") == len(set(columns))).select("row", F.array_join(F.transform("p", lambda x: x["v"]), " ").alias("key"))


def multi_get(cells: DataFrame, requests: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """idx, row and their cells; a request without cells gives one row of nulls."""
    return requests.join(visible_cells(of_rows(cells, requests), scan), "row", "left").select("idx", *CELL)


def row_or_before(cells: DataFrame, row: bytes, family: str) -> DataFrame:
    """Cells of the greatest row, at most ``row``, with a visible cell in the family."""
    scan, below, count = Scan(columns={family: None}), F.col("row") <= F.lit(row), 16
    while True:
        # the nearest stored rows by key alone; only these are read for what is visible
        near = cells.where(below & (F.col("family") == family) & (F.col("type") == PUT)).select("row").distinct().orderBy(F.desc("row")).limit(count)
        keys = [bytes(r["row"]) for r in near.collect()]
        if not keys:
            return visible_cells(cells.limit(0), scan)
        seen = visible_cells(cells.where(F.col("row").isin(*map(F.lit, keys))), scan)
        found = seen.agg(F.max("row")).first()[0]
        if found is not None:
            return visible_cells(cells.where(F.col("row") == F.lit(bytes(found))), scan)
        below, count = F.col("row") < F.lit(keys[-1]), min(4 * count, 4096)


def exists(cells: DataFrame, scan: Scan) -> bool:
    return not visible_cells(cells, scan).limit(1).isEmpty()


# -- regions -------------------------------------------------------------------------
def region_of(splits: list[bytes]) -> Column:
    """Number of the region, from static split keys, that a row lies in."""
    out = F.lit(0)
    for i, s in enumerate(sorted(splits), 1):
        out = F.when(F.col("row") >= F.lit(s), i).otherwise(out)
    return out


def endpoint_sum(cells: DataFrame, family: str, qualifier: bytes, splits: list[bytes], start: bytes = b"", stop: bytes = b"", kind: str = "int") -> DataFrame:
    """region and sum; the range selects regions, a region is always summed whole."""
    keys = sorted(splits)
    lo = sum(k <= start for k in keys)
    hi = sum(k < stop for k in keys) if stop else len(keys)
    found = visible_cells(cells, Scan(columns={family: frozenset([qualifier])})).withColumn("region", region_of(keys))
    return found.where(F.col("region").between(lo, hi)).groupBy("region").agg(F.sum(decode_number("value", kind)).alias("total"))


def endpoint(cells: DataFrame, splits: list[bytes], make: Callable, schema: str) -> DataFrame:
    """A function of one's own on each region's cells, as record batches in key order.

    Regions are streamed: the function is called once a region with cells, and gets an
    iterator of the region's batches, which have the number in a column ``region``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_runs(batches, "region"), key=lambda x: x[0]):
            yield from make(b for _, b in own)

    placed = cells.withColumn("region", region_of(splits)).repartition(max(1, len(splits) + 1), "region")
    return placed.sortWithinPartitions("region", "row", "family", "qualifier", F.desc("ts")).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """Record batches cut where the value of a column changes."""
    for b in batches:
        keys = b.column(column).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], b.slice(start, i - start)
                start = i


# -- functions of one's own ------------------------------------------------------------
def map_rows(cells: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None, schema: str, scan: Scan = Scan()) -> DataFrame:
    """A mapper over the visible cells; without a function the cells go through as they are."""
    seen = visible_cells(cells, scan)
    return seen if make is None else seen.mapInArrow(make, schema)


def reduce_rows(mapped: DataFrame, keys: list[str], make: Callable | None, schema: str) -> DataFrame:
    """A reducer: called once a key with an iterator of its batches, which are streamed, so
    a large group is never held.  Without a function the rows go through as they are."""
    if make is None:
        return mapped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_runs(batches, "_group"), key=lambda x: x[0]):
            yield from make(b.drop_columns(["_group"]) for _, b in own)

    named = mapped.withColumn("_group", F.struct(*keys).cast("string"))
    return named.repartition(*keys).sortWithinPartitions("_group").mapInArrow(run, schema)


def range_bounds(cells: DataFrame, regions: int) -> DataFrame:
    """First and last row of even ranges of rows."""
    return cells.select("row").repartitionByRange(regions, "row").groupBy(F.spark_partition_id().alias("region")).agg(F.min("row").alias("first"), F.max("row").alias("last"))


def sample_keys(cells: DataFrame, how: str = "random", n: int = 100, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Keys for borders: the first n rows, n of a random share, or a share of about one in
    k by a hash of the row, which stands for every k-th without an order over all rows."""
    rows = cells.select("row").distinct()
    if how == "split":
        return rows.orderBy("row").limit(n)
    if how == "random":
        return rows.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))).orderBy(F.xxhash64("row", F.lit(seed + 1))).limit(n)
    every = max(1, round(1 / fraction))
    return rows.withColumn("_n", F.pmod(F.xxhash64("row"), F.lit(every))).where("_n = 0").drop("_n").orderBy("row").limit(n)


def bulk_files(cells: DataFrame, path: str) -> None:
    """Files in total key order, one folder a family, ready to be adopted."""
    made = cells.repartitionByRange("row").sortWithinPartitions("row", "family", "qualifier", F.desc("ts"), F.desc("type"), F.desc("seq"))
    made.withColumn("dir", F.col("family")).write.partitionBy("dir").parquet(path)


def route(cells: DataFrame, table: str, names: list[str]) -> dict[str, DataFrame]:
    """Cells by the table that a column names."""
    return {n: cells.where(F.col(table) == n).drop(table) for n in names}


def newest_cell(cells: DataFrame) -> DataFrame:
    w = W.partitionBy("row").orderBy(F.desc("ts"), "family", "qualifier")
    return cells.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

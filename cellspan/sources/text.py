"""Text to cells: delimited lines with a column specification, and upload rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import parse_column
from ..plans.model import CELL_SCHEMA, PUT

#: The name that marks the row key in a column specification, unless another is given.
ROW_KEY = "ROW_KEY"


def parse_tsv(lines: DataFrame, columns: str, ts: int, separator: str = "\t", line: str = "value", marker: str = ROW_KEY, skip_bad_lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells, bad lines).  ``columns``: comma-separated, one of them the row key.

    A line is bad without a separator, with more fields than columns, or without the row
    key's field; it may have fewer fields.  All cells get the time ``ts``.
    Bad lines are skipped; without ``skip_bad_lines`` one fails the job that reads the cells.
    ``marker`` is the name that stands for the row key.
    """
    specs = columns.split(",")
    if specs.count(marker) != 1:
        raise ValueError(f"{marker} must stand for one column")
    if len(separator.encode()) != 1:
        raise ValueError("the separator is one byte")
    if len(specs) < 2:
        raise ValueError("a row key and one column at least")
    at = specs.index(marker)
    fields = F.split(F.col(line), "\\Q" + separator + "\\E", -1)
    parsed = lines.withColumn("_f", fields).withColumn("_bad", F.col(line).isNull() | (F.size("_f") < 2) | (F.size("_f") > len(specs)) | (F.size("_f") <= at) | (F.octet_length(F.get("_f", F.lit(at))) == 0))
    bad = parsed.where("_bad").select(line)
    cells = []
    for i, s in enumerate(specs):
        if i != at:
            family, qualifier = parse_column(s)
            cells.append(F.struct(F.lit(family).alias("family"), F.lit(qualifier or b"").alias("qualifier"), F.get("_f", F.lit(i)).cast("binary").alias("value"), F.lit(i).cast("long").alias("seq")))
    if not skip_bad_lines:
        parsed = parsed.withColumn("_bad", F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("bad line: "), F.coalesce(line, F.lit("null")))).cast("boolean")).otherwise(F.lit(False)))
    good = parsed.where("not _bad").select(F.get("_f", F.lit(at)).cast("binary").alias("row"), F.explode(F.array(*cells)).alias("c")).where("c.value is not null")
    out = good.select("row", "c.family", "c.qualifier", F.lit(ts).alias("ts"), F.lit(PUT).alias("type"), "c.value", "c.seq")
    return out.select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA]), bad


def parse_uploads(lines: DataFrame, ts: int, line: str = "value") -> DataFrame:
    """Cells of lines ``row,family,qualifier,value``; lines of another width are skipped."""
    f = F.split(F.col(line), ",", -1)
    rows = lines.select(f.alias("f")).where(F.size("f") == 4)
    made = rows.select(F.col("f")[0].cast("binary").alias("row"), F.col("f")[1].alias("family"), F.col("f")[2].cast("binary").alias("qualifier"), F.lit(ts).alias("ts"), F.lit(PUT).alias("type"), F.col("f")[3].cast("binary").alias("value"), F.lit(0).alias("seq"))
    return made.select([F.col(x.name).cast(x.dataType) for x in CELL_SCHEMA])

"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, settle

#: A node with more than this share of all edge ends is met by a broadcast.
HUB_SHARE = 1 / 1000


def join_hubs(rows: DataFrame, groups: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` with the ``value`` that ``groups(key, value, degree)`` has for their key.

    ``total``: the number of rows.  Keys with more than ``HUB_SHARE`` of them are few,
    1 / HUB_SHARE at most, and are broadcast; of the other keys none makes a large task.
    """
    limit = max(100, int(total * HUB_SHARE))
    near = rows.join(F.broadcast(groups.where(F.col("degree") > limit).select(key, value)), key, "left")
    rest = near.where(F.col(value).isNull()).drop(value).join(groups.where(F.col("degree") <= limit).select(key, value), key, "left")
    return near.where(F.col(value).isNotNull()).unionByName(rest)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node reached.

    Nulls in either end are ignored, loops and repeated edges are harmless.  Each round
    links every node's larger neighbours to its smallest neighbour, then its smaller
    ones; the number of edges never grows, and rounds grow with the logarithm of the
    diameter.  Every round is a written table, so lineage stays short.
    """
    settle(edges.sparkSession)
    both = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = durable(both, label)
    mark = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(now)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    while before[0]:
        edge_count = before[0]
        ends = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = join_hubs(ends, least, "u", "m", 2 * edge_count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node links its smaller neighbours and itself to the least
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = durable(small, label)
        state = mark(after)
        drop_durable(now)
        now = after
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))

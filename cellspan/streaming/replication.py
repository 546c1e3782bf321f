"""Ship a table's mutation batches to another table as they arrive.

The source is the table's folder of Parquet batches; the checkpoint is the position in
it.  Families whose replication scope is local are dropped.  Original times and types
are kept, so that order of arrival never matters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import CELL_SCHEMA
from ..sources.catalog import Catalog


@dataclass
class Replication:
    """Peers by id and their running queries."""

    source: Catalog
    checkpoints: str
    peers: dict[str, Catalog] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)
    running: dict[tuple[str, str], StreamingQuery] = field(default_factory=dict)

    def add_peer(self, name: str, target: Catalog) -> None:
        if name in self.peers:
            raise ValueError(f"peer {name} exists")
        self.peers[name] = target

    def remove_peer(self, name: str) -> None:
        self.disable_peer(name)
        del self.peers[name]

    def enable_peer(self, name: str) -> None:
        self.off.discard(name)

    def disable_peer(self, name: str) -> None:
        self.off.add(name)
        for key in [k for k in self.running if k[0] == name]:
            self.running.pop(key).stop()

    def start(self, table: str, available_now: bool = False) -> list[StreamingQuery]:
        """Start shipping a table to every peer that is on."""
        scoped = [f.name for f in self.source.describe(table).families.values() if f.replication_scope]
        out = []
        for name, target in self.peers.items():
            if name in self.off:
                continue
            edits = self.source.spark.readStream.schema(CELL_SCHEMA).parquet(f"{self.source._current(table)}/batch=*")
            kept = edits.where(F.col("family").isin(*scoped)) if scoped else edits.where(F.lit(False))

            def ship(batch: DataFrame, number: int, target=target) -> None:
                # a few batch numbers: each stays a batch, so that the order of writes stays
                source = F.shiftright("seq", 40)
                for r in batch.select(source.alias("n")).distinct().orderBy("n").collect():
                    target.append(table, batch.where(source == r["n"]).withColumn("seq", F.col("seq") % (1 << 40)))

            w = kept.writeStream.foreachBatch(ship).option("checkpointLocation", f"{self.checkpoints}/{name}/{table}")
            q = (w.trigger(availableNow=True) if available_now else w).start()
            self.running[(name, table)] = q
            out.append(q)
        return out

    def stop(self) -> None:
        for q in self.running.values():
            q.stop()
        self.running.clear()

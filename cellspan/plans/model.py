"""Cells, and the descriptions of scans and gets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.codecs import parse_columns

PUT, DELETE, DELETE_COLUMN, DELETE_FAMILY = 4, 8, 12, 14
LATEST = (1 << 63) - 1

CELL_SCHEMA = T.StructType(
    [
        T.StructField("row", T.BinaryType(), False),
        T.StructField("family", T.StringType(), False),
        T.StructField("qualifier", T.BinaryType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("type", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)
CELL = ["row", "family", "qualifier", "ts", "value"]


@dataclass(frozen=True)
class Scan:
    """What to read.  ``columns`` maps a family to its qualifiers, None for all of them.

    ``start`` is inclusive, ``stop`` exclusive, but equal ones are a point read; times
    are ``[min, max)``.  ``caching`` and ``cache_blocks`` are accepted and have no effect.
    """

    start: bytes = b""
    stop: bytes = b""
    columns: dict[str, frozenset[bytes] | None] = field(default_factory=dict)
    time_min: int = 0
    time_max: int = LATEST
    max_versions: int | None = 1
    batch: int = 0
    filter: Any = None
    limit: int | None = None
    raw: bool = False
    caching: int = -1
    cache_blocks: bool = True

    def add_family(self, family: str) -> Scan:
        return replace(self, columns={**self.columns, family: None})

    def add_column(self, family: str, qualifier: bytes) -> Scan:
        have = self.columns.get(family, frozenset())
        if family in self.columns and have is None:
            have = frozenset()
        return replace(self, columns={**self.columns, family: have | {qualifier}})

    def add_columns(self, specs: str | list[str]) -> Scan:
        out = self
        for family, qualifier in parse_columns(specs):
            out = out.add_family(family) if qualifier is None else out.add_column(family, qualifier)
        return out

    def set_time_range(self, lo: int, hi: int) -> Scan:
        if hi < lo or lo < 0:
            raise ValueError("a time range needs 0 <= min <= max")
        return replace(self, time_min=lo, time_max=hi)

    def set_timestamp(self, ts: int) -> Scan:
        return self.set_time_range(ts, ts + 1)

    def set_max_versions(self, n: int | None = None) -> Scan:
        return replace(self, max_versions=n)

    def set_batch(self, n: int) -> Scan:
        if self.filter is not None and self.filter.has_row_stage():
            raise ValueError("a filter of whole rows can't be combined with batches")
        return replace(self, batch=n)

    def set_filter(self, f: Any) -> Scan:
        return replace(self, filter=f)

    @property
    def is_get(self) -> bool:
        return bool(self.start) and self.start == self.stop

    def to_json(self) -> str:
        cols = {f: None if q is None else sorted(x.hex() for x in q) for f, q in self.columns.items()}
        plain = {k: getattr(self, k) for k in ("time_min", "time_max", "max_versions", "batch", "limit", "raw")}
        return json.dumps(plain | {"start": self.start.hex(), "stop": self.stop.hex(), "columns": cols, "filter": None if self.filter is None else self.filter.to_dict()})

    @staticmethod
    def from_json(text: str) -> Scan:
        from .filters import filter_from_dict

        d = json.loads(text)
        cols = {f: None if q is None else frozenset(bytes.fromhex(x) for x in q) for f, q in d.pop("columns").items()}
        f = d.pop("filter")
        return Scan(start=bytes.fromhex(d.pop("start")), stop=bytes.fromhex(d.pop("stop")), columns=cols, filter=f and filter_from_dict(f), **d)


def get(row: bytes, **more: Any) -> Scan:
    """A point read is a scan whose start and stop are the row."""
    if not row:
        raise ValueError("a get needs a row")
    return Scan(start=row, stop=row, **more)

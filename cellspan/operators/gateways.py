"""Ways in: row specifications, JSON filters and scanner models, a shell of functions."""

from __future__ import annotations

import base64
import json
import urllib.parse
from dataclasses import dataclass, replace
from typing import Any

from ..functions.codecs import parse_column, succ
from ..plans import filters as fl
from ..plans.model import LATEST, Scan
from ..sources.catalog import Catalog, Family
from .table import CellTable


def parse_rowspec(path: str, params: str = "") -> Scan:
    """``row[,end]``, a ``*`` at the row's end for a prefix, ``/col,col``, ``/ts[,ts]``;
    parameters ``v`` (versions)."""
    parts = path.strip("/").split("/")
    row = urllib.parse.unquote_to_bytes(parts[0])
    if row.endswith(b"*"):
        start, stop = row[:-1], succ(row[:-1]) or b""
    elif b"," in row:
        start, stop = row.split(b",", 1)
    else:
        start = stop = row
    scan = Scan(start=start, stop=stop)
    if len(parts) > 1 and parts[1]:
        for c in parts[1].split(","):
            f, q = parse_column(urllib.parse.unquote(c))
            scan = scan.add_family(f) if q is None else scan.add_column(f, q)
    if len(parts) > 2 and parts[2]:
        lo, _, hi = parts[2].partition(",")
        scan = scan.set_time_range(int(lo), int(hi)) if hi else scan.set_time_range(0, int(lo) + 1)
    for k, v in urllib.parse.parse_qsl(params.lstrip("?")):
        if k == "v":
            scan = scan.set_max_versions(int(v))
    return scan


def _b64(text: str) -> bytes:
    return base64.b64decode(text)


def json_comparator(d: dict[str, Any]) -> fl.Comparator:
    kind, value = d["type"], d.get("value", "")
    if kind == "BinaryComparator":
        return fl.BinaryComparator(_b64(value))
    if kind == "BinaryPrefixComparator":
        return fl.BinaryPrefixComparator(_b64(value))
    if kind == "RegexStringComparator":
        return fl.RegexComparator(value)
    if kind == "SubstringComparator":
        return fl.SubstringComparator(value)
    raise ValueError(f"no comparator {kind}")


def json_filter(source: str | dict[str, Any]) -> fl.Filter:
    """A filter from its JSON form; bytes are Base64."""
    d = json.loads(source) if isinstance(source, str) else source
    kind = d["type"]
    compare = lambda: (d["op"], json_comparator(d["comparator"]))
    if kind == "ColumnCountGetFilter":
        return fl.ColumnCountGetFilter(int(d["limit"]))
    if kind == "ColumnPaginationFilter":
        return fl.ColumnPaginationFilter(int(d["limit"]), int(d["offset"]))
    if kind == "FilterList":
        return fl.FilterList(d["op"], tuple(json_filter(f) for f in d["filters"]))
    if kind == "FirstKeyOnlyFilter":
        return fl.FirstKeyOnlyFilter()
    if kind == "InclusiveStopFilter":
        return fl.InclusiveStopFilter(_b64(d["value"]))
    if kind == "PageFilter":
        return fl.PageFilter(int(d["value"]))
    if kind == "PrefixFilter":
        return fl.PrefixFilter(_b64(d["value"]))
    if kind in ("QualifierFilter", "RowFilter", "ValueFilter"):
        return getattr(fl, kind)(*compare())
    if kind == "SingleColumnValueFilter":
        op, comparator = compare()
        return fl.SingleColumnValueFilter(_b64(d["family"]).decode(), _b64(d["qualifier"]), op, comparator, bool(d.get("ifMissing", False)), bool(d.get("latestVersion", True)))
    if kind in ("SkipFilter", "WhileMatchFilter"):
        return getattr(fl, kind)(json_filter(d["filters"][0]))
    raise ValueError(f"no filter {kind}")


def scanner_model(source: str | dict[str, Any]) -> Scan:
    """A scan from the JSON form of a scanner."""
    d = json.loads(source) if isinstance(source, str) else source
    scan = Scan(start=_b64(d.get("startRow", "")), stop=_b64(d.get("endRow", "")), batch=int(d.get("batch", 0)))
    for c in d.get("column", []):
        f, q = parse_column(_b64(c).decode())
        scan = scan.add_family(f) if q is None else scan.add_column(f, q)
    scan = scan.set_time_range(int(d.get("startTime", 0)), int(d.get("endTime", LATEST)))
    scan = scan.set_max_versions(int(d.get("maxVersions", 1)))
    return scan.set_filter(json_filter(d["filter"])) if "filter" in d else scan


@dataclass
class Shell:
    """The commands of the shell as methods; options as keyword arguments."""

    catalog: Catalog

    def _table(self, name: str) -> CellTable:
        return CellTable(self.catalog, name)

    def create(self, name: str, *families: str | dict[str, Any], splits: list[bytes] | None = None):
        return self.catalog.create(name, [self._family(f) for f in families], splits)

    @staticmethod
    def _family(f: str | dict[str, Any]) -> Family:
        if isinstance(f, str):
            return Family(f)
        names = {"NAME": "name", "VERSIONS": "versions", "TTL": "ttl", "BLOOMFILTER": "bloom", "COMPRESSION": "compression", "BLOCKSIZE": "block_size", "BLOCKCACHE": "block_cache", "IN_MEMORY": "in_memory", "REPLICATION_SCOPE": "replication_scope"}
        return Family(**{names[k]: v for k, v in f.items()})

    def alter(self, name: str, *changes: str | dict[str, Any]) -> None:
        for c in changes:
            d = {"NAME": c} if isinstance(c, str) else dict(c)
            method = d.pop("METHOD", None)
            if method == "delete":
                self.catalog.delete_family(name, d["NAME"])
            elif method == "table_att":
                self.catalog.modify_table(name, **d)
            elif d["NAME"] in self.catalog.describe(name).families:
                self.catalog.modify_family(name, self._family(d))
            else:
                self.catalog.add_family(name, self._family(d))

    def put(self, name: str, row: str, column: str, value: str, ts: int | None = None) -> None:
        f, q = parse_column(column)
        self._table(name).put([(row.encode(), f, q or b"", value.encode(), ts)])

    def _scan(self, COLUMNS=None, COLUMN=None, TIMESTAMP=None, VERSIONS=1, FILTER=None, LIMIT=None, CACHE_BLOCKS=True, **_) -> Scan:
        scan = Scan(max_versions=VERSIONS, limit=LIMIT, filter=FILTER, cache_blocks=CACHE_BLOCKS)
        columns = COLUMNS or COLUMN
        if columns:
            scan = scan.add_columns([columns] if isinstance(columns, str) else list(columns))
        return scan.set_timestamp(TIMESTAMP) if TIMESTAMP is not None else scan

    @staticmethod
    def _shown(rows, MAXLENGTH=None):
        cut = lambda v: v if MAXLENGTH is None else v[:MAXLENGTH]
        return [(r["row"].decode(), f"{r['family']}:{bytes(r['qualifier']).decode()}", r["ts"], cut(bytes(r["value"]).decode())) for r in rows]

    def get(self, name: str, row: str, MAXLENGTH=None, **options):
        scan = replace(self._scan(**options), start=row.encode(), stop=row.encode())
        return self._shown(self._table(name).get(scan), MAXLENGTH)

    def scan(self, name: str, STARTROW: str = "", STOPROW: str = "", MAXLENGTH=None, **options):
        scan = replace(self._scan(**options), start=STARTROW.encode(), stop=STOPROW.encode())
        return self._shown(self._table(name).scan(scan).toLocalIterator(), MAXLENGTH)

    def delete(self, name: str, row: str, column: str, ts: int | None = None) -> None:
        self.deleteall(name, row, column, ts)

    def deleteall(self, name: str, row: str, column: str | None = None, ts: int | None = None) -> None:
        f, q = parse_column(column) if column else (None, None)
        self._table(name).delete(row.encode(), f, q, ts)

    def incr(self, name: str, row: str, column: str, amount: int = 1) -> int:
        f, q = parse_column(column)
        return self._table(name).increment_column_value(row.encode(), f, q or b"", amount)

    def get_counter(self, name: str, row: str, column: str) -> int | None:
        f, q = parse_column(column)
        found = self._table(name).get(Scan(start=row.encode(), stop=row.encode()).add_column(f, q or b""))
        return int.from_bytes(found[0]["value"], "big", signed=True) if found else None

    def count(self, name: str) -> int:
        return self._table(name).count()

    def truncate(self, name: str) -> None:
        self.catalog.truncate(name)

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def enable(self, name: str) -> None:
        self.catalog.enable(name)

    def disable(self, name: str) -> None:
        self.catalog.disable(name)

    def exists(self, name: str) -> bool:
        return self.catalog.exists(name)

    def is_enabled(self, name: str) -> bool:
        return self.catalog.is_enabled(name)

    def is_disabled(self, name: str) -> bool:
        return self.catalog.is_disabled(name)

    def list(self, pattern: str = ".*") -> list[str]:
        return self.catalog.list(pattern)

    def describe(self, name: str):
        return self.catalog.describe(name)

    def compact(self, name: str) -> None:
        self._table(name).compact(major=False)

    def major_compact(self, name: str) -> None:
        self._table(name).compact(major=True)

    def flush(self, name: str) -> None:
        """Batches are stored as they are written: nothing is held back."""
        self.catalog.describe(name)

"""Filters and comparators as column expressions.

A filter says which cells it keeps.  Predicates on single cells run before versions are
limited; all others see the version-limited cells of a row.  Lists keep their order:
what follows a paging filter sees only its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codecs import succ

LESS, LESS_OR_EQUAL, EQUAL, NOT_EQUAL, GREATER_OR_EQUAL, GREATER, NO_OP = "LESS LESS_OR_EQUAL EQUAL NOT_EQUAL GREATER_OR_EQUAL GREATER NO_OP".split()
_KINDS: dict[str, type] = {}


def _register(cls):
    _KINDS[cls.__name__] = cls
    return cls


# -- comparators -------------------------------------------------------------------
class Comparator:
    """``test(x, op)``: does "x op this" hold."""

    def test(self, x: Column, op: str) -> Column:
        raise NotImplementedError


class _Match(Comparator):
    """Comparators that only know match (0) and no match (1)."""

    def match(self, x: Column) -> Column:
        raise NotImplementedError

    def test(self, x: Column, op: str) -> Column:
        m = F.coalesce(self.match(x), F.lit(False))
        return {EQUAL: m, GREATER_OR_EQUAL: m, NOT_EQUAL: ~m, LESS: ~m, LESS_OR_EQUAL: F.lit(True), GREATER: F.lit(False), NO_OP: F.lit(True)}[op]


def _ordered(x: Column, y: Column, op: str) -> Column:
    if op == NO_OP:
        return F.lit(True)
    return {LESS: x < y, LESS_OR_EQUAL: x <= y, EQUAL: x == y, NOT_EQUAL: x != y, GREATER_OR_EQUAL: x >= y, GREATER: x > y}[op]


@_register
@dataclass(frozen=True)
class BinaryComparator(Comparator):
    value: bytes

    def test(self, x: Column, op: str) -> Column:
        return _ordered(x, F.lit(self.value), op)


@_register
@dataclass(frozen=True)
class BinaryPrefixComparator(Comparator):
    value: bytes

    def test(self, x: Column, op: str) -> Column:
        return _ordered(F.substring(x, 1, len(self.value)) if self.value else F.lit(b""), F.lit(self.value), op)


@_register
@dataclass(frozen=True)
class BitComparator(_Match):
    """Matches if lengths are equal and ``x mode value`` has a bit set."""

    value: bytes
    mode: str = "AND"

    def match(self, x: Column) -> Column:
        def byte(i: int) -> Column:
            return F.conv(F.hex(F.substring(x, i + 1, 1)), 16, 10).cast("int")

        found = F.lit(False)
        for i, b in enumerate(self.value):
            v = F.lit(b)
            bits = {"AND": byte(i).bitwiseAND(v), "OR": byte(i).bitwiseOR(v), "XOR": byte(i).bitwiseXOR(v)}[self.mode]
            found = found | (bits != 0)
        return F.when(F.octet_length(x) == len(self.value), found).otherwise(False)


@_register
@dataclass(frozen=True)
class RegexComparator(_Match):
    """Finds the pattern anywhere; a dot also stands for a line end."""

    pattern: str

    def match(self, x: Column) -> Column:
        return x.cast("string").rlike("(?s)" + self.pattern)


@_register
@dataclass(frozen=True)
class SubstringComparator(_Match):
    """Contains the text, whatever the case."""

    text: str

    def match(self, x: Column) -> Column:
        return F.contains(F.lower(x.cast("string")), F.lit(self.text.lower()))


# -- filters -----------------------------------------------------------------------
class Filter:
    """Base of all filters.  ``predicate`` is set for filters of single cells."""

    def predicate(self) -> Column | None:
        return None

    def row_range(self) -> tuple[bytes, bytes | None] | None:
        """Rows outside ``[lo, hi)`` are never kept: lets the scan prune."""
        return None

    def has_row_stage(self) -> bool:
        """Whether whole rows must be seen."""
        return False

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        """Cells with helper columns, and whether each is kept."""
        return cells, self.predicate()

    def apply(self, cells: DataFrame) -> DataFrame:
        before = cells.columns
        cells, keep = self.flags(cells)
        return cells.where(keep).select(*before)

    def to_dict(self) -> dict[str, Any]:
        return {"type": type(self).__name__, **{k: _plain(v) for k, v in self.__dict__.items()}}


def _plain(v: Any) -> Any:
    if isinstance(v, bytes):
        return {"hex": v.hex()}
    if isinstance(v, Filter | Comparator):
        return {"type": type(v).__name__, **{k: _plain(x) for k, x in v.__dict__.items()}}
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else v


def filter_from_dict(d: Any) -> Any:
    if isinstance(d, dict):
        if set(d) == {"hex"}:
            return bytes.fromhex(d["hex"])
        return _KINDS[d["type"]](**{k: filter_from_dict(v) for k, v in d.items() if k != "type"})
    return tuple(map(filter_from_dict, d)) if isinstance(d, list) else d


def _named(cells: DataFrame, made: Column, stem: str) -> tuple[DataFrame, Column]:
    name = f"_{stem}{len(cells.columns)}"
    return cells.withColumn(name, made), F.col(name)


def whole_row():
    return W.partitionBy("row")


def in_row():
    return W.partitionBy("row").orderBy("family", "qualifier", F.desc("ts"))


def _as_comparator(c: Any) -> Comparator:
    return BinaryComparator(c) if isinstance(c, bytes) else c


@dataclass(frozen=True)
class _Compare(Filter):
    op: str
    comparator: Any
    _field = "row"

    def predicate(self) -> Column:
        x = F.col(self._field)
        return _as_comparator(self.comparator).test(x.cast("binary") if self._field == "family" else x, self.op)


@_register
class RowFilter(_Compare):
    def row_range(self) -> tuple[bytes, bytes | None] | None:
        if not isinstance(self.comparator, bytes | BinaryComparator):
            return None
        v = self.comparator if isinstance(self.comparator, bytes) else self.comparator.value
        return {LESS: (b"", v), LESS_OR_EQUAL: (b"", v + b"\0"), EQUAL: (v, v + b"\0"), GREATER_OR_EQUAL: (v, None), GREATER: (v + b"\0", None)}.get(self.op)


@_register
class FamilyFilter(_Compare):
    _field = "family"


@_register
class QualifierFilter(_Compare):
    """A cell with an empty qualifier always passes."""

    _field = "qualifier"

    def predicate(self) -> Column:
        return (F.octet_length("qualifier") == 0) | super().predicate()


@_register
class ValueFilter(_Compare):
    _field = "value"


@_register
@dataclass(frozen=True)
class PrefixFilter(Filter):
    """Rows with the prefix, as a range that a scan can prune by; None keeps nothing."""

    prefix: bytes | None

    def predicate(self) -> Column:
        if self.prefix is None:
            return F.lit(False)
        hi = succ(self.prefix)
        lo = F.col("row") >= F.lit(self.prefix)
        return lo if hi is None else lo & (F.col("row") < F.lit(hi))

    def row_range(self) -> tuple[bytes, bytes | None] | None:
        return None if self.prefix is None else (self.prefix, succ(self.prefix))


@_register
@dataclass(frozen=True)
class InclusiveStopFilter(Filter):
    stop: bytes

    def predicate(self) -> Column:
        return F.col("row") <= F.lit(self.stop)

    def row_range(self) -> tuple[bytes, bytes | None]:
        return b"", self.stop + b"\0"


@_register
@dataclass(frozen=True)
class ColumnPrefixFilter(Filter):
    prefix: bytes

    def predicate(self) -> Column:
        return F.startswith(F.col("qualifier"), F.lit(self.prefix))


@_register
@dataclass(frozen=True)
class TimestampsFilter(Filter):
    timestamps: tuple[int, ...]

    def predicate(self) -> Column:
        return F.col("ts").isin(*self.timestamps) if self.timestamps else F.lit(False)


@_register
@dataclass(frozen=True)
class SingleColumnValueFilter(Filter):
    """Keeps whole rows by the value of one column; without it, unless told otherwise."""

    family: str
    qualifier: bytes
    op: str
    comparator: Any
    filter_if_missing: bool = False
    latest_only: bool = True

    def __post_init__(self):
        if self.op == NO_OP:
            raise ValueError("a single column value filter needs an operator")

    def has_row_stage(self) -> bool:
        return True

    def _tested(self) -> Column:
        return (F.col("family") == self.family) & (F.col("qualifier") == F.lit(self.qualifier))

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        ok = _as_comparator(self.comparator).test(F.col("value"), self.op)
        if self.latest_only:
            seen = F.max(F.when(self._tested(), F.struct("ts", ok.alias("ok")))).over(whole_row())["ok"]
        else:
            seen = F.max(F.when(self._tested(), ok)).over(whole_row())
        cells, seen = _named(cells, seen, "scv")
        return cells, F.coalesce(seen, F.lit(not self.filter_if_missing))


@_register
class SingleColumnValueExcludeFilter(SingleColumnValueFilter):
    """The same, and the tested column is left out."""

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        cells, keep = super().flags(cells)
        return cells, keep & ~self._tested()


@_register
@dataclass(frozen=True)
class DependentColumnFilter(Filter):
    """Cells whose time is that of a (passing) cell of the dependent column in the row."""

    family: str
    qualifier: bytes
    drop: bool = False
    op: str = NO_OP
    comparator: Any = None

    def has_row_stage(self) -> bool:
        return True

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        dep = (F.col("family") == self.family) & (F.col("qualifier") == F.lit(self.qualifier))
        ok = dep if self.comparator is None else dep & _as_comparator(self.comparator).test(F.col("value"), self.op)
        cells, hit = _named(cells, F.max(ok).over(W.partitionBy("row", "ts")), "dep")
        # a dependent cell stands for itself only
        keep = F.when(dep, ok).otherwise(hit)
        return cells, keep & ~dep if self.drop else keep


@_register
@dataclass(frozen=True)
class FirstKeyOnlyFilter(Filter):
    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        cells, n = _named(cells, F.row_number().over(in_row()), "first")
        return cells, n == 1


@_register
@dataclass(frozen=True)
class ColumnCountGetFilter(Filter):
    limit: int

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        cells, n = _named(cells, F.row_number().over(in_row()), "count")
        return cells, n <= self.limit


@_register
@dataclass(frozen=True)
class ColumnPaginationFilter(Filter):
    limit: int
    offset: int

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        cells, n = _named(cells, F.row_number().over(in_row()), "page")
        return cells, (n > self.offset) & (n <= self.offset + self.limit)


@_register
@dataclass(frozen=True)
class KeyOnlyFilter(Filter):
    """Empties values, or replaces them by their length in 4 bytes."""

    length_as_value: bool = False

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        return cells, F.lit(True)

    def apply(self, cells: DataFrame) -> DataFrame:
        made = F.unhex(F.lpad(F.hex(F.octet_length("value")), 8, "0")) if self.length_as_value else F.lit(b"")
        return cells.withColumn("value", made)


@_register
@dataclass(frozen=True)
class PageFilter(Filter):
    """The first n rows in key order, found by a bounded top-n and not by a global window."""

    rows: int

    def has_row_stage(self) -> bool:
        return True

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        last = cells.select("row").distinct().orderBy("row").limit(self.rows).agg(F.max("row"))
        return cells, F.coalesce(F.col("row") <= last.scalar(), F.lit(False)) if self.rows > 0 else F.lit(False)


@_register
@dataclass(frozen=True)
class SkipFilter(Filter):
    """Drops a row if the inner filter drops any of its cells; row filters inside do nothing."""

    inner: Filter

    def has_row_stage(self) -> bool:
        return True

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        if isinstance(self.inner, RowFilter | PrefixFilter | InclusiveStopFilter | PageFilter | SingleColumnValueFilter):
            return cells, F.lit(True)
        cells, ok = self.inner.flags(cells)
        cells, ok = _named(cells, ok, "in")
        cells, all_ok = _named(cells, F.min(ok).over(whole_row()), "skip")
        return cells, all_ok


@_register
@dataclass(frozen=True)
class WhileMatchFilter(Filter):
    """Ends the scan at the first cell in key order that the inner filter drops."""

    inner: Filter

    def has_row_stage(self) -> bool:
        return self.inner.has_row_stage()

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        before = cells.columns
        marked, ok = self.inner.flags(cells)
        key = F.struct(F.col("row"), F.col("family"), F.col("qualifier"), (-F.col("ts")).alias("age"))
        first = marked.where(~ok).select(*before).agg(F.min(key))
        return cells, F.coalesce(key < first.scalar(), F.lit(True))


MUST_PASS_ALL, MUST_PASS_ONE = "MUST_PASS_ALL", "MUST_PASS_ONE"


@_register
@dataclass(frozen=True)
class FilterList(Filter):
    mode: str
    filters: tuple[Filter, ...] = field(default=())

    def predicate(self) -> Column | None:
        parts = [f.predicate() for f in self.filters]
        if not parts or any(p is None for p in parts):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.mode == MUST_PASS_ALL else out | p
        return out

    def has_row_stage(self) -> bool:
        return any(f.has_row_stage() for f in self.filters)

    def row_range(self) -> tuple[bytes, bytes | None] | None:
        ranges = [f.row_range() for f in self.filters]
        if self.mode == MUST_PASS_ALL:
            have = [r for r in ranges if r]
            highs = [h for _, h in have if h is not None]
            return (max(lo for lo, _ in have), min(highs) if highs else None) if have else None
        if not ranges or any(r is None for r in ranges):
            return None
        return min(lo for lo, _ in ranges), None if any(h is None for _, h in ranges) else max(h for _, h in ranges)

    def flags(self, cells: DataFrame) -> tuple[DataFrame, Column]:
        if not self.filters:
            return cells, F.lit(True)
        keep = None
        for f in self.filters:
            cells, k = f.flags(cells)
            cells, k = _named(cells, k, "list")
            keep = k if keep is None else keep & k if self.mode == MUST_PASS_ALL else keep | k
        return cells, keep

    def apply(self, cells: DataFrame) -> DataFrame:
        if self.mode == MUST_PASS_ONE:
            out = super().apply(cells)
            for f in self.filters:
                out = f.apply(out) if isinstance(f, KeyOnlyFilter) else out
            return out
        for f in in_effect(self.filters):
            cells = f.apply(cells)
        return cells


@_register
@dataclass(frozen=True)
class ColumnFilter(Filter):
    """A filter of one's own: any function that returns a column expression on a cell."""

    make: Callable[[], Column]

    def predicate(self) -> Column:
        return self.make()


def in_effect(filters: tuple[Filter, ...]) -> list[Filter]:
    """Members of an all-of list in the order they take effect.

    Row keys are judged first.  A row that they reject, or that single-cell predicates
    leave without cells, is never counted by a page, wherever that stands; members that
    judge whole rows keep their place towards pages.
    """
    keys = [f for f in filters if isinstance(f, RowFilter | PrefixFilter | InclusiveStopFilter)]
    out: list[Filter] = []
    for f in filters:
        if f in keys:
            continue
        at = len(out)
        while f.predicate() is not None and at and isinstance(out[at - 1], PageFilter):
            at -= 1
        out.insert(at, f)
    return keys + out


_own: dict[str, Callable[..., Filter]] = {}


def register_filter(name: str, make: Callable[..., Filter]) -> None:
    """Make a filter known by name to scans described as text."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a name of letters, digits and underscores")
    _own[name] = make


def named_filter(name: str, *args: Any, **more: Any) -> Filter:
    return (_own.get(name) or _KINDS[name])(*args, **more)


def split_stages(f: Filter | None) -> tuple[list[Column], list[Filter]]:
    """Predicates that run before versions are limited, and what runs after, in order."""
    if f is None:
        return [], []
    p = f.predicate()
    if p is not None:
        return [p], []
    if isinstance(f, FilterList) and f.mode == MUST_PASS_ALL:
        early, late = [], []
        for g in in_effect(f.filters):
            q = g.predicate()
            if q is not None and not late:
                early.append(q)
            else:
                late.append(g)
        return early, late
    return [], [f]

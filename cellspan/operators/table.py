"""The table interface: gets, scans, mutations and hooks over a catalog's table."""

from __future__ import annotations

import time
from collections.abc import Iterator

from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.model import CELL_SCHEMA, Scan
from ..plans.scan import in_order, of_rows, results, visible_cells
from ..sources.catalog import Catalog
from . import jobs, mutate


class Bypass(Exception):
    """Raised by a ``pre_`` hook to give the answer in place of the operation."""

    def __init__(self, answer: Any = None):
        super().__init__("bypassed")
        self.answer = answer


class CellTable:
    """A table opened by name.  Hooks are objects with ``pre_<step>`` and ``post_<step>``:
    get, exists, put, delete, check_and_put, check_and_delete, increment, scanner_open,
    scanner_next, scanner_close, get_closest_row_before, flush, compact."""

    def __init__(self, catalog: Catalog, name: str, hooks: list | None = None, clock=lambda: int(time.time() * 1000)):
        self.catalog, self.name, self.clock = catalog, name, clock
        self.hooks = sorted(hooks or [], key=lambda h: getattr(h, "priority", 1))
        self.spark = catalog.spark
        self.auto_flush, self.buffer = True, []

    def _step(self, step: str, args: tuple, run):
        try:
            for h in self.hooks:
                if (f := getattr(h, f"pre_{step}", None)) is not None:
                    f(*args)
            out = run()
        except Bypass as b:
            out = b.answer
        for h in self.hooks:
            if (f := getattr(h, f"post_{step}", None)) is not None:
                changed = f(*args, out)
                out = out if changed is None else changed
        return out

    @property
    def descriptor(self):
        return self.catalog.describe(self.name)

    def cells(self) -> DataFrame:
        return self.catalog.cells(self.name)

    # -- reads
    def scan_cells(self, scan: Scan = Scan()) -> DataFrame:
        """Visible cells of a scan, unordered."""
        d = self.descriptor
        for f in scan.columns:
            if f not in d.families:
                raise KeyError(f"no family {f} in {self.name}")
        return visible_cells(self.cells(), scan, self.clock(), d.ttl, d.caps)

    def scan(self, scan: Scan = Scan()) -> DataFrame:
        """Cells in key order."""
        return self._step("scanner_open", (scan,), lambda: in_order(self.scan_cells(scan)))

    def scanner(self, scan: Scan = Scan()) -> Iterator[Row]:
        """Results one after the other; ``scan.batch`` cells each where it is set."""
        found = self._step("scanner_open", (scan,), lambda: results(self.scan_cells(scan), scan.batch))
        for r in found.orderBy("row", "part").toLocalIterator():
            yield self._step("scanner_next", (scan,), lambda r=r: r)
        self._step("scanner_close", (scan,), lambda: None)

    def get(self, scan: Scan) -> list[Row]:
        if not scan.is_get:
            raise ValueError("a get names one row")
        return self._step("get", (scan,), lambda: in_order(self.scan_cells(scan)).collect())

    def multi_get(self, rows: list[bytes], scan: Scan = Scan()) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(rows)), "idx long, row binary")
        d = self.descriptor
        seen = visible_cells(of_rows(self.cells(), asked), scan, self.clock(), d.ttl, d.caps)
        return asked.join(seen, "row", "left").select("idx", "row", "family", "qualifier", "ts", "value").orderBy("idx", "family", "qualifier", F.desc("ts"))

    def exists(self, scan: Scan) -> bool:
        return self._step("exists", (scan,), lambda: not self.scan_cells(scan).limit(1).isEmpty())

    def row_or_before(self, row: bytes, family: str) -> list[Row]:
        return self._step("get_closest_row_before", (row, family), lambda: in_order(jobs.row_or_before(self.cells(), row, family)).collect())

    # -- writes
    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", seq long")

    def _check_families(self, names) -> None:
        for f in set(names) - set(self.descriptor.families):
            raise KeyError(f"no family {f} in {self.name}")

    def put(self, rows: list[tuple]) -> None:
        """(row, family, qualifier, value[, ts]); buffered unless ``auto_flush`` is on."""
        self._check_families(r[1] for r in rows)
        full = [(*r, None)[:5] for r in rows]
        self.buffer += full
        if self.auto_flush:
            self.flush_commits()

    def flush_commits(self) -> None:
        rows, self.buffer = self.buffer, []
        if rows:
            made = mutate.puts(self._frame([(r, f, q, v, t) for r, f, q, v, t in rows], "row binary, family string, qualifier binary, value binary, ts long"), self.clock())
            self._step("put", (rows,), lambda: self.catalog.append(self.name, made))

    def put_frame(self, rows: DataFrame) -> None:
        self.catalog.append(self.name, mutate.puts(rows, self.clock()))

    def delete(self, row: bytes, family: str | None = None, qualifier: bytes | None = None, ts: int | None = None, one_version: bool = False) -> None:
        now = self.clock()
        if family is not None:
            self._check_families([family])
        if family is None:
            made = mutate.delete_rows(self._frame([(row, ts)], "row binary, ts long"), list(self.descriptor.families), now)
        elif qualifier is None:
            made = mutate.delete_families(self._frame([(row, family, ts)], "row binary, family string, ts long"), now)
        else:
            rows = self._frame([(row, family, qualifier, ts)], "row binary, family string, qualifier binary, ts long")
            made = mutate.delete_versions(rows, self.cells(), now) if one_version else mutate.delete_columns(rows, now)
        self._step("delete", (row, family, qualifier, ts), lambda: self.catalog.append(self.name, made))

    def increment(self, row: bytes, amounts: dict[tuple[str, bytes], int]) -> dict[tuple[str, bytes], int]:
        self._check_families(f for f, _ in amounts)
        asked = self.spark.createDataFrame([(row, f, q, n) for (f, q), n in amounts.items()], "row binary, family string, qualifier binary, amount long")

        def run():
            self.catalog.append(self.name, mutate.increments(asked, self.cells(), self.clock()))
            now = self.scan_cells(Scan(start=row, stop=row))
            return {(r["family"], bytes(r["qualifier"])): int.from_bytes(r["value"], "big", signed=True) for r in now.collect() if (r["family"], bytes(r["qualifier"])) in amounts}

        return self._step("increment", (row, amounts), run)

    def increment_column_value(self, row: bytes, family: str, qualifier: bytes, amount: int = 1) -> int:
        return self.increment(row, {(family, qualifier): amount})[(family, qualifier)]

    def _check(self, step: str, row: bytes, family: str, qualifier: bytes, expected: bytes | None, cells: DataFrame) -> bool:
        checks = self.spark.createDataFrame([(0, row, family, qualifier, expected)], "check int, row binary, family string, qualifier binary, expected binary")

        def run() -> bool:
            made, passed = mutate.check_and_mutate(checks, cells.withColumn("check", F.lit(0)), self.cells())
            ok = passed.first()["passed"]
            if ok:
                self.catalog.append(self.name, made)
            return ok

        return self._step(step, (row, family, qualifier, expected), run)

    def check_and_put(self, row: bytes, family: str, qualifier: bytes, expected: bytes | None, put: tuple) -> bool:
        made = mutate.puts(self._frame([(*put, None)[:5]], "row binary, family string, qualifier binary, value binary, ts long"), self.clock())
        return self._check("check_and_put", row, family, qualifier, expected, made)

    def check_and_delete(self, row: bytes, family: str, qualifier: bytes, expected: bytes | None, column: tuple[str, bytes]) -> bool:
        made = mutate.delete_columns(self._frame([(row, *column)], "row binary, family string, qualifier binary"), self.clock())
        return self._check("check_and_delete", row, family, qualifier, expected, made)

    def batch(self, actions: list[tuple]) -> list[Any]:
        """("put", row...), ("delete", ...) and ("get", Scan): one answer each, in order."""
        out = []
        for kind, *args in actions:
            out.append(self.get(*args) if kind == "get" else self.delete(*args) if kind == "delete" else self.put([tuple(args)]))
        return out

    # -- upkeep
    def compact(self, major: bool = True) -> None:
        d = self.descriptor
        made = mutate.compact(self.cells(), major, d.caps, self.clock(), d.ttl)
        self._step("compact", (major,), lambda: self.catalog.rewrite(self.name, made))

    def count(self) -> int:
        return jobs.count_rows(self.cells()).first()["n"]

    def regions(self) -> list[tuple[bytes, bytes]]:
        keys = [b"", *self.descriptor.splits, b""]
        return list(zip(keys, keys[1:], strict=False))


def empty_cells(spark) -> DataFrame:
    return spark.createDataFrame([], CELL_SCHEMA)



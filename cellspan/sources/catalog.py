"""Table descriptors and their storage: Parquet batches of cells under one folder.

Each batch of mutations is one atomic append with its own number, the high bits of
``seq``.  One writer a table; readers see whole batches.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import split_keys
from ..plans.model import CELL_SCHEMA


@dataclass(frozen=True)
class Family:
    name: str
    versions: int = 3
    ttl: int | None = None
    bloom: str = "NONE"
    compression: str = "NONE"
    block_size: int = 65536
    block_cache: bool = True
    in_memory: bool = False
    replication_scope: int = 0

    def __post_init__(self):
        if not self.name or self.name.startswith(".") or any(ord(c) < 32 or c == ":" or ord(c) == 127 for c in self.name):
            raise ValueError(f"not a family name: {self.name!r}")
        if self.versions < 1 or self.bloom not in ("NONE", "ROW", "ROWCOL"):
            raise ValueError(f"not a family setting: {self}")


@dataclass(frozen=True)
class Table:
    name: str
    families: dict[str, Family]
    splits: tuple[bytes, ...] = ()
    enabled: bool = True
    attributes: dict[str, object] = field(default_factory=lambda: {"MAX_FILESIZE": 256 << 20, "READONLY": False, "MEMSTORE_FLUSHSIZE": 64 << 20, "DEFERRED_LOG_FLUSH": False})

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*", self.name):
            raise ValueError(f"not a table name: {self.name!r}")

    @property
    def caps(self) -> dict[str, int]:
        return {f.name: f.versions for f in self.families.values()}

    @property
    def ttl(self) -> dict[str, int]:
        return {f.name: f.ttl for f in self.families.values() if f.ttl is not None}


class TableDisabled(RuntimeError):
    pass


class Catalog:
    """DDL over a folder that Spark can read and write.  ``hooks`` see every step."""

    def __init__(self, spark: SparkSession, root: str, hooks: list | None = None):
        self.spark, self.root, self.hooks = spark, root.rstrip("/"), list(hooks or [])

    # -- files, through Spark's own file systems
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _call(self, when: str, what: str, *args) -> None:
        for h in sorted(self.hooks, key=lambda h: getattr(h, "priority", 1)):
            if (f := getattr(h, f"{when}_{what}", None)) is not None:
                f(*args)

    # -- descriptors
    def _meta(self, name: str) -> str:
        return f"{self.root}/{name}/table.json"

    def _save(self, t: Table) -> None:
        d = {"name": t.name, "families": [asdict(f) for f in t.families.values()], "splits": [s.hex() for s in t.splits], "enabled": t.enabled, "attributes": t.attributes}
        self._write(self._meta(t.name), json.dumps(d))

    def exists(self, name: str) -> bool:
        return self._exists(self._meta(name))

    def describe(self, name: str) -> Table:
        if not self.exists(name):
            raise KeyError(f"no table {name}")
        d = json.loads(self._read(self._meta(name)))
        return Table(d["name"], {f["name"]: Family(**f) for f in d["families"]}, tuple(bytes.fromhex(s) for s in d["splits"]), d["enabled"], d["attributes"])

    def list(self, pattern: str = ".*") -> list[str]:
        fs, p = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if self.exists(n) and re.fullmatch(pattern, n))

    def create(self, name: str, families: list[Family | str], splits: list[bytes] | None = None, start: bytes | None = None, end: bytes | None = None, regions: int = 0) -> Table:
        """With split keys, or with a number of regions (3 or more) between two keys."""
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        made = [Family(f) if isinstance(f, str) else f for f in families]
        if not made:
            raise ValueError("a table needs a family")
        if regions:
            if regions < 3 or start is None or end is None or start >= end:
                raise ValueError("three regions or more, between a start key and a larger end key")
            splits = [start, end] if regions == 3 else split_keys(start, end, regions - 3)
        keys = sorted(splits or [])
        if len(set(keys)) != len(keys) or b"" in keys:
            raise ValueError("split keys must be distinct and not empty")
        t = Table(name, {f.name: f for f in made}, tuple(keys))
        self._call("pre", "create_table", t)
        self._save(t)
        self._call("post", "create_table", t)
        return t

    def drop(self, name: str) -> None:
        if self.describe(name).enabled:
            raise ValueError(f"disable {name} first")
        self._call("pre", "delete_table", name)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
        self._call("post", "delete_table", name)

    def truncate(self, name: str) -> Table:
        t = self.describe(name)
        self.disable(name)
        self.drop(name)
        self._save(replace(t, enabled=True))
        return self.describe(name)

    def enable(self, name: str) -> None:
        self._call("pre", "enable_table", name)
        self._save(replace(self.describe(name), enabled=True))
        self._call("post", "enable_table", name)

    def disable(self, name: str) -> None:
        self._call("pre", "disable_table", name)
        self._save(replace(self.describe(name), enabled=False))
        self._call("post", "disable_table", name)

    def is_enabled(self, name: str) -> bool:
        return self.describe(name).enabled

    def is_disabled(self, name: str) -> bool:
        return not self.is_enabled(name)

    def is_available(self, name: str) -> bool:
        return self.exists(name)

    def _alter(self, name: str, step: str, *what, families=None, attributes=None) -> Table:
        t = self.describe(name)
        if t.enabled:
            raise ValueError(f"disable {name} first")
        self._call("pre", step, name, *what)
        t = replace(t, families=families(t.families) if families else t.families, attributes=t.attributes | (attributes or {}))
        if not t.families:
            raise ValueError("a table needs a family")
        self._save(t)
        self._call("post", step, name, *what)
        return t

    def add_family(self, name: str, family: Family) -> Table:
        if family.name in self.describe(name).families:
            raise ValueError(f"family {family.name} exists")
        return self._alter(name, "add_column", family, families=lambda fs: fs | {family.name: family})

    def modify_family(self, name: str, family: Family) -> Table:
        self._known(name, family.name)
        return self._alter(name, "modify_column", family, families=lambda fs: fs | {family.name: family})

    def delete_family(self, name: str, family: str) -> Table:
        self._known(name, family)
        t = self._alter(name, "delete_column", family, families=lambda fs: {k: v for k, v in fs.items() if k != family})
        self.rewrite(name, self.cells(name, any_state=True).where(F.col("family") != family))
        return t

    def modify_table(self, name: str, **attributes) -> Table:
        return self._alter(name, "modify_table", attributes, attributes=attributes)

    def _known(self, name: str, family: str) -> None:
        if family not in self.describe(name).families:
            raise KeyError(f"no family {family} in {name}")

    # -- storage
    def _current(self, name: str) -> str:
        pointer = f"{self.root}/{name}/current"
        return f"{self.root}/{name}/" + (self._read(pointer) if self._exists(pointer) else "v0")

    def batches(self, name: str) -> list[int]:
        fs, p = self._fs(self._current(name))
        if not fs.exists(p):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"batch=(\d+)", s.getPath().getName())) and fs.exists(self._fs(f"{p}/batch={m[1]}/_SUCCESS")[1]))

    def cells(self, name: str, any_state: bool = False) -> DataFrame:
        """All stored cells, tombstones included; a disabled table can't be read."""
        if not any_state and not self.is_enabled(name):
            raise TableDisabled(name)
        paths = [f"{self._current(name)}/batch={b}" for b in self.batches(name)]
        return self.spark.read.schema(CELL_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], CELL_SCHEMA)

    def next_batch(self, name: str) -> int:
        return max(self.batches(name), default=0) + 1

    def append(self, name: str, cells: DataFrame) -> None:
        """Add one batch; ``cells.seq`` holds positions inside it."""
        t = self.describe(name)
        if not t.enabled:
            raise TableDisabled(name)
        if t.attributes.get("READONLY"):
            raise PermissionError(f"{name} is read-only")
        n = self.next_batch(name)
        made = cells.withColumn("seq", F.lit(n << 40) + F.col("seq")).select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])
        self._store(made, f"{self._current(name)}/batch={n}", t)

    def _store(self, cells: DataFrame, path: str, t: Table) -> None:
        w = cells.write
        if any(f.bloom != "NONE" for f in t.families.values()):
            w = w.option("parquet.bloom.filter.enabled#row", "true")
        w.parquet(path)

    def adopt(self, name: str, path: str) -> None:
        """Bulk load: take over a folder of Parquet cell files as one batch."""
        self.append(name, self.spark.read.schema(CELL_SCHEMA).parquet(path))

    def rewrite(self, name: str, cells: DataFrame) -> None:
        """Replace the stored cells, sorted by key; readers switch by one small file."""
        t = self.describe(name)
        old = self._current(name)
        new = f"v{int(old.rsplit('/v', 1)[1]) + 1}"
        made = cells.select([F.col(f.name).cast(f.dataType) for f in CELL_SCHEMA])
        n = max(self.batches(name), default=1)
        self._store(made.repartitionByRange("row").sortWithinPartitions("row", "family", "qualifier", F.desc("ts"), F.desc("type"), F.desc("seq")), f"{self.root}/{name}/{new}/batch={n}", t)
        self._write(f"{self.root}/{name}/current", new)
        fs, p = self._fs(old)
        fs.delete(p, True)

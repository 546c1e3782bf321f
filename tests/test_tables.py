"""The table interface, visibility golden cases, jobs and gateways on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from cellspan.functions import codecs
from cellspan.operators import jobs, mutate
from cellspan.operators.gateways import Shell, json_filter, parse_rowspec
from cellspan.operators.table import Bypass, CellTable
from cellspan.plans import filters as fl
from cellspan.plans.model import CELL_SCHEMA, Scan, get
from cellspan.plans.scan import family_map, results, value_of, visible_cells, wide
from cellspan.sources.catalog import Catalog, Family, TableDisabled
from cellspan.sources.text import parse_tsv
from cellspan.streaming.replication import Replication

P, D, DC, DF = 4, 8, 12, 14


def cells(spark, rows):
    """(row, qualifier, ts, type[, value[, family]]) in order of writing."""
    full = [(r.encode(), (x + ["v", "cf"][len(x) :])[1] if len(x) > 1 else "cf", q.encode(), t, k, None if k != P else (x[0] if x else "v").encode(), i) for i, (r, q, t, k, *x) in enumerate(rows)]
    return spark.createDataFrame(full, CELL_SCHEMA)


def seen(df):
    return [(r["row"].decode(), bytes(r["qualifier"]).decode(), r["ts"]) for r in df.orderBy("row", "family", "qualifier", F.desc("ts")).collect()]


NOW = 100_000
GOLDEN = [
    ([("R", "a", t, P) for t in range(1, 6)], Scan(max_versions=None, time_max=6), ["a5", "a4", "a3", "a2", "a1"]),
    ([("R", "a", t, P) for t in range(1, 6)], Scan(max_versions=None, time_min=1, time_max=3), ["a2", "a1"]),
    ([("R", "a", t, P) for t in range(1, 6)], Scan(max_versions=3, time_max=10), ["a5", "a4", "a3"]),
    ([("R", "a", 1, P)] * 2, Scan(), ["a1"]),
    ([("R", "a", 1, P), ("R", "a", 1, D)], Scan(), []),
    ([("R", "a", NOW, P), ("R", "a", NOW, D), ("R", "a", NOW - 500, P), ("R", "a", NOW - 100, P), ("R", "a", NOW, P)], Scan(), [f"a{NOW - 100}"]),
    ([("R", "a", NOW, P), ("R", "a", NOW, D), ("R", "a", NOW - 500, P), ("R", "a", NOW + 500, P), ("R", "a", NOW, P)], Scan(max_versions=2), [f"a{NOW + 500}", f"a{NOW - 500}"]),
    ([("R", "a", 2, P), ("R", "b", 1, P), ("R", "a", 1, DC)], Scan(), ["a2", "b1"]),
    ([("R", "a", 2, P), ("R", "a", 1, P), ("R", "a", 1, DC), ("R", "b", 2, P), ("R", "b", 1, P), ("R", "c", 10, D), ("R", "c", 10, P), ("R", "c", 9, P), ("R", "d", 11, P), ("R", "d", 10, DC), ("R", "d", 9, P), ("R", "d", 8, P)], Scan(max_versions=2), ["a2", "b2", "b1", "c9", "d11"]),
    ([("R", "", 100, DF), *(("R", q, 11, P) for q in "bcdefghi"), ("S", "a", 11, P)], Scan(), ["a11"]),
    ([("R", "a", 5, P), ("R", "a", 9, DC)], Scan(max_versions=None, time_max=7), []),
]


@pytest.mark.parametrize("rows,scan,want", GOLDEN)
def test_visibility(spark, rows, scan, want):
    assert [f"{q}{t}" for _, q, t in seen(visible_cells(cells(spark, rows), scan))] == want


def test_ttl_keeps_the_border(spark):
    rows = [("1", "a", NOW - 1000, P), ("1", "b", NOW - 500, P), ("1", "c", NOW - 501, P), ("2", "a", NOW, P)]
    out = seen(visible_cells(cells(spark, rows), Scan(), NOW, {"cf": 1}))
    assert [x[1] for x in out] == ["a", "b", "c", "a"]
    with pytest.raises(ValueError):
        visible_cells(cells(spark, rows), Scan(), None, {"cf": 1})


def test_random_mutations_match_a_plain_store(spark):
    rng = random.Random(9)
    log = []
    for _ in range(600):
        k = rng.choice([P, P, P, D, DC, DF])
        log.append((rng.choice("xyz"), "" if k == DF else rng.choice("ab"), rng.randint(1, 9), k))
    want = []
    for r in "xyz":
        for q in "ab":
            n = 0
            for t in range(9, 0, -1):
                puts = any(x == (r, q, t, P) for x in log)
                dead = any(x[0] == r and ((x[3] == DF and x[2] >= t) or (x[1] == q and ((x[3] == DC and x[2] >= t) or (x[3] == D and x[2] == t)))) for x in log)
                if puts and not dead and n < 2:
                    want.append((r, q, t))
                    n += 1
    assert seen(visible_cells(cells(spark, log), Scan(max_versions=2))) == want


def test_comparators(spark):
    data = cells(spark, [("r", "q", 1, P, v) for v in ["abc"]])
    keep = lambda op, c: visible_cells(data, Scan(filter=fl.ValueFilter(op, c))).count() == 1
    for c, matches in ((fl.RegexComparator("B|bc"), True), (fl.RegexComparator("^b"), False), (fl.SubstringComparator("BC"), True), (fl.BitComparator(b"\x01\x00\x00", "AND"), True), (fl.BitComparator(b"\x01", "OR"), False), (fl.BitComparator(b"abc", "XOR"), False)):
        assert [keep(op, c) for op in (fl.EQUAL, fl.GREATER_OR_EQUAL, fl.NOT_EQUAL, fl.LESS, fl.LESS_OR_EQUAL, fl.GREATER)] == [matches, matches, not matches, not matches, True, False]
    assert keep(fl.EQUAL, fl.BinaryPrefixComparator(b"ab")) and keep(fl.NO_OP, b"zzz") and not keep(fl.LESS, b"abc")
    scan = Scan(filter=fl.FilterList(fl.MUST_PASS_ALL, (fl.PrefixFilter(b"r"), fl.SkipFilter(fl.ValueFilter(fl.EQUAL, b"abc")))), start=b"a").add_columns("cf:q cf")
    assert Scan.from_json(scan.to_json()).to_json() == scan.to_json() and visible_cells(data, Scan.from_json(scan.to_json())).count() == 1
    with pytest.raises(ValueError):
        fl.SingleColumnValueFilter("f", b"q", fl.NO_OP, b"")
    with pytest.raises(ValueError):
        Scan(filter=fl.PageFilter(1)).set_batch(2)


def test_codecs(spark):
    one = spark.range(1)
    made = {n: one.select(f(F.lit(v))).first()[0] for n, f, v in [("d", codecs.encode_double, 1.5), ("f", codecs.encode_float, -2.25), ("v", codecs.encode_vint, -300), ("b", codecs.encode_boolean, True)]}
    frame = spark.createDataFrame([tuple(made.values())], "d binary, f binary, v binary, b binary")
    assert tuple(frame.select(codecs.decode_double("d"), codecs.decode_float("f"), codecs.decode_vint("v"), codecs.decode_boolean("b")).first()) == (1.5, -2.25, -300, True)
    for n in (0, 127, -112, 128, -113, 1 << 40, -(1 << 40), (1 << 63) - 1):
        assert codecs.read_vint(codecs.vint(n)) == n
    assert codecs.from_printable(codecs.printable(b"a\x00\xff b")) == b"a\x00\xff b"
    assert codecs.succ(b"a\xff") == b"b" and codecs.succ(b"\xff") is None
    keys = codecs.split_keys(b"a", b"z", 4)
    assert keys == sorted(keys) and len(keys) == 6 and codecs.hex_splits(4, 2) == [b"40", b"80", b"c0"]
    assert codecs.parse_columns("a:b c d:") == [("a", b"b"), ("c", None), ("d", None)]


@pytest.fixture()
def table(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    catalog.create("t", [Family("x", replication_scope=1), "y"], splits=[b"m"])
    clock = iter(range(1000, 100_000, 10))
    return CellTable(catalog, "t", clock=lambda: next(clock))


def test_table_reads_and_writes(spark, table):
    table.put([(b"1", "x", b"a", b"v1", 5), (b"1", "y", b"b", b"v2", 5), (b"2", "x", b"a", b"v3")])
    table.put([(b"1", "x", b"a", b"v4", 6)])
    assert [(r["qualifier"], r["value"]) for r in table.get(get(b"1"))] == [(b"a", b"v4"), (b"b", b"v2")]
    assert len(table.get(get(b"1", max_versions=5))) == 3 and table.exists(get(b"2")) and not table.exists(get(b"3"))
    assert [r["idx"] for r in table.multi_get([b"2", b"9"]).collect()] == [0, 1]
    assert table.row_or_before(b"1z", "x")[0]["row"] == b"1" and table.count() == 2
    table.delete(b"1", "x", b"a", one_version=True)
    assert table.get(get(b"1").add_column("x", b"a"))[0]["value"] == b"v1"
    assert table.increment(b"3", {("x", b"n"): 2, ("x", b"m"): -1}) == {("x", b"n"): 2, ("x", b"m"): -1}
    assert table.increment_column_value(b"3", "x", b"n", 5) == 7
    assert not table.check_and_put(b"2", "x", b"a", b"no", (b"2", "x", b"z", b"1"))
    assert table.check_and_put(b"2", "x", b"z", None, (b"2", "x", b"z", b"1"))
    assert table.check_and_delete(b"2", "x", b"z", b"1", ("x", b"a")) and not table.exists(get(b"2").add_column("x", b"a"))
    before = seen(table.scan())
    table.compact(major=False)
    assert seen(table.scan()) == before
    table.compact(major=True)
    assert seen(table.scan()) == before and table.cells().where("type <> 4").count() == 0
    table.delete(b"3")
    assert [r["row"] for r in table.scanner()] == [b"1", b"2"] and table.regions() == [(b"", b"m"), (b"m", b"")]
    with pytest.raises(KeyError):
        table.put([(b"1", "no", b"a", b"v")])


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("a", ["f"], start=b"b", end=b"y", regions=5)
    assert c.list() == ["a"] and len(c.describe("a").splits) == 4
    for bad in (lambda: c.create("a", ["f"]), lambda: c.create("-x", ["f"]), lambda: c.create("b", ["f:"]), lambda: c.drop("a"), lambda: c.create("b", ["f"], splits=[b"1", b"1"])):
        with pytest.raises(ValueError):
            bad()
    c.disable("a")
    with pytest.raises(TableDisabled):
        c.cells("a")
    c.add_family("a", Family("g", versions=1))
    c.delete_family("a", "f")
    c.enable("a")
    assert list(c.describe("a").families) == ["g"]
    c.truncate("a")
    c.disable("a")
    c.drop("a")
    assert not c.exists("a")


def test_hooks(spark, table):
    class Guard:
        def pre_delete(self, *a):
            raise Bypass()

        def post_get(self, scan, out):
            return out[:1]

    table.put([(b"1", "x", b"a", b"1"), (b"1", "x", b"b", b"2")])
    table.hooks = [Guard()]
    table.delete(b"1")
    assert len(table.get(get(b"1"))) == 1


def test_results(spark):
    data = cells(spark, [("1", "a", 2, P, "new"), ("1", "a", 1, P, "old"), ("1", "b", 1, P, "b")])
    r = results(visible_cells(data, Scan(max_versions=None))).select(value_of("cf", b"a").alias("v"), family_map("cf").alias("m"), F.size("cells").alias("n")).first()
    assert r["v"] == b"new" and {bytes(k): bytes(v) for k, v in r["m"].items()} == {b"a": b"new", b"b": b"b"} and r["n"] == 3
    assert bytes(wide(visible_cells(data), [("cf", b"a"), ("cf", b"z")]).first()["cf:a"]) == b"new"


def test_tsv(spark):
    lines = spark.createDataFrame([("a\tb\tc\td",), ("only",), ("",), (None,), ("a\tb\tc\td\te",), ("a\tb",)], "value string")
    good, bad = parse_tsv(lines, "col_a,col_b:qual,KEY,col_d", 3, marker="KEY")
    assert sorted((r["family"], bytes(r["qualifier"]), bytes(r["value"])) for r in good.collect()) == [("col_a", b"", b"a"), ("col_b", b"qual", b"b"), ("col_d", b"", b"d")]
    assert bad.count() == 5
    strict, _ = parse_tsv(lines, "col_a,col_b:qual,ROW_KEY,col_d", 3, skip_bad_lines=False)
    with pytest.raises(Exception, match="bad line"):
        strict.collect()
    with pytest.raises(ValueError):
        parse_tsv(lines, "a,b", 3)


def test_endpoint_and_samples(spark):
    rows = [(f"testRow{i:02d}".encode(), "f", b"q", 1, P, i.to_bytes(4, "big"), i) for i in range(20)]
    data = spark.createDataFrame(rows, CELL_SCHEMA)
    splits = [b"testRow05", b"testRow12"]
    total = lambda **k: sum(r["total"] for r in jobs.endpoint_sum(data, "f", b"q", splits, **k).collect())
    assert total() == 190 and total(start=b"testRow05") == 180
    assert jobs.sample_keys(data, "split", 5).count() == 5 and jobs.range_bounds(data, 3).agg(F.count("*")).first()[0] <= 3
    assert jobs.row_or_before(data, b"testRow05x", "f").first()["row"] == b"testRow05"


def test_functions_on_regions_and_groups(spark):
    import pyarrow as pa

    rows = [(f"{i:02d}".encode(), "f", b"q", 1, P, b"%d" % (i % 3), i) for i in range(40)]
    data = spark.createDataFrame(rows, CELL_SCHEMA)

    def ends(batches):
        keys = [(b.column("region")[0].as_py(), k) for b in batches for k in b.column("row").to_pylist()]
        assert len({r for r, _ in keys}) == 1
        yield pa.RecordBatch.from_pylist([{"region": keys[0][0], "first": keys[0][1], "last": keys[-1][1], "n": len(keys)}])

    got = jobs.endpoint(data, [b"35", b"38"], ends, "region long, first binary, last binary, n long").orderBy("region").collect()
    assert [(r["region"], bytes(r["first"]), bytes(r["last"]), r["n"]) for r in got] == [(0, b"00", b"34", 35), (1, b"35", b"37", 3), (2, b"38", b"39", 2)]

    def count(batches):
        values = [v for b in batches for v in b.column("value").to_pylist()]
        yield pa.RecordBatch.from_pylist([{"value": values[0], "n": len(values)}])

    assert jobs.map_rows(data, None, "").count() == 40
    assert jobs.reduce_rows(data, ["value"], None, "").count() == 40
    groups = {bytes(r["value"]): r["n"] for r in jobs.reduce_rows(jobs.map_rows(data, lambda x: x, "row binary, family string, qualifier binary, ts long, value binary"), ["value"], count, "value binary, n long").collect()}
    assert groups == {b"0": 14, b"1": 13, b"2": 13}


def test_pages_count_rows_that_are_left(spark):
    from cellspan.plans import filters as fl

    data = spark.createDataFrame([(f"{i:02d}".encode(), "f", b"q", 1, P, b"%d" % (i % 2), i) for i in range(40)], CELL_SCHEMA)
    rows = lambda *f: [bytes(r["row"]).decode() for r in visible_cells(data, Scan().set_filter(fl.FilterList(fl.MUST_PASS_ALL, f))).orderBy("row").collect()]
    page, prefix = fl.PageFilter(3), fl.PrefixFilter(b"3")
    assert rows(page, prefix) == rows(prefix, page) == ["30", "31", "32"]
    assert rows(page, fl.RowFilter(fl.EQUAL, fl.RegexComparator("^3"))) == ["30", "31", "32"]
    odd = fl.ValueFilter(fl.EQUAL, b"1")
    assert rows(page, odd) == rows(odd, page) == ["01", "03", "05"]
    nested = fl.FilterList(fl.MUST_PASS_ALL, (page, odd))
    assert rows(nested, prefix) == rows(prefix, nested) == ["31", "33", "35"]


def test_few_rows_are_read_by_key(spark):
    data = spark.createDataFrame([(f"{i:02d}".encode(), "f", b"q", 1, P, i.to_bytes(8, "big"), i) for i in range(40)], CELL_SCHEMA)
    asked = spark.createDataFrame([(0, b"03"), (1, b"zz"), (2, b"03")], "idx long, row binary")
    got = jobs.multi_get(data, asked)
    assert sorted((r["idx"], r["value"]) for r in got.collect() if r["value"]) == [(0, (3).to_bytes(8, "big")), (2, (3).to_bytes(8, "big"))]
    gone = spark.createDataFrame([(f"{i:02d}".encode(), "f", b"", 9, 14, None, 100 + i) for i in range(5, 40)], CELL_SCHEMA)
    assert bytes(jobs.row_or_before(data.unionByName(gone), b"39", "f").first()["row"]) == b"04"
    assert jobs.row_or_before(data, b"0", "f").count() == 0


def test_import_renames(spark):
    data = spark.createDataFrame([(b"1", "f", b"q", 1, P, b"v", 0), (b"1", "g", b"q", 1, P, b"w", 0)], CELL_SCHEMA)
    out = jobs.import_cells(jobs.export_cells(data), {"f": "h"}, ["f"]).collect()
    assert [(r["family"], bytes(r["value"]), r["type"]) for r in out] == [("h", b"v", P)]


def test_increment_wraps(spark):
    state = spark.createDataFrame([(b"r", "f", b"q", 5, P, ((1 << 63) - 1).to_bytes(8, "big"), 0)], CELL_SCHEMA)
    one = spark.createDataFrame([(b"r", "f", b"q", 1)], "row binary, family string, qualifier binary, amount long")
    assert mutate.increments(one, state, 1).select(codecs.decode_number("value")).first()[0] == -(1 << 63)


def test_shell(spark, tmp_path):
    s = Shell(Catalog(spark, f"file://{tmp_path}/s"))
    s.create("t", {"NAME": "x", "VERSIONS": 5})
    s.put("t", "1", "x:a", "1")
    s.put("t", "1", "x:b", "2", 12345678)
    s.put("t", "2", "x:a", "11")
    assert [v for *_, v in s.get("t", "1", COLUMNS=["x:a", "x:b"])] == ["1", "2"] and s.count("t") == 2
    assert [r for r, *_ in s.scan("t", LIMIT=1)] == ["1", "1"] and s.get("t", "1", TIMESTAMP=12345678)[0][3] == "2"
    assert s.incr("t", "9", "x:n", 3) == 3 and s.get_counter("t", "9", "x:n") == 3
    s.deleteall("t", "1")
    assert s.get("t", "1") == []
    s.disable("t")
    s.alter("t", {"NAME": "y"}, {"NAME": "x", "METHOD": "delete"})
    s.enable("t")
    assert list(s.describe("t").families) == ["y"] and s.list() == ["t"]


def test_rowspec_and_json():
    assert parse_rowspec("a,b/f:q/5,9").time_max == 9 and parse_rowspec("a*").stop == b"b" and parse_rowspec("x").is_get
    f = json_filter({"type": "WhileMatchFilter", "filters": [{"type": "PageFilter", "value": "3"}]})
    assert isinstance(f.inner, fl.PageFilter)
    with pytest.raises(ValueError):
        json_filter({"type": "DependentColumnFilter"})


def test_replication_keeps_scope_and_order(spark, table, tmp_path):
    other = Catalog(spark, f"file://{tmp_path}/other")
    other.create("t", ["x", "y"])
    ship = Replication(table.catalog, f"file://{tmp_path}/at")
    ship.add_peer("b", other)
    table.put([(b"1", "x", b"a", b"1", 5), (b"1", "y", b"a", b"1", 5)])
    table.put([(b"1", "x", b"a", b"2", 5)])
    for _ in range(2):
        for q in ship.start("t", available_now=True):
            q.awaitTermination()
    got = visible_cells(other.cells("t")).collect()
    assert [(r["family"], bytes(r["value"])) for r in got] == [("x", b"2")] and other.cells("t").count() == 2

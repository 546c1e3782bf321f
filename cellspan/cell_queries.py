"""Registered queries on cell tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .operators import jobs, mutate
from .operators.encode import customer_cells, event_cells, shown
from .operators.gateways import json_filter, parse_rowspec, scanner_model
from .plans import filters as fl
from .plans.filters import EQUAL, GREATER, GREATER_OR_EQUAL, LESS, LESS_OR_EQUAL, NOT_EQUAL, FilterList
from .plans.model import Scan
from .plans.scan import results, visible_cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Days since the epoch and milliseconds, as DuckDB says them.
_MS, _DAY = "epoch_us(ts)//1000", "epoch_us(ts)//86400000000"
_CENTS = "CAST(round(value*100) AS BIGINT)"


def _n(cents: int) -> bytes:
    return cents.to_bytes(8, "big")


def kernel(days: bool = False, deletes: bool = True, props: bool = False, pre: str = "true", versions: int | None = 1, columns: str = "true", keep: str = "true", source: str = "events") -> str:
    """The SQL of a scan up to the version limit: WITH ... vis, one, vN."""
    t = _DAY if days else _MS
    r = "lpad(CAST(user_id AS VARCHAR),8,'0')"
    parts = [f"SELECT {r} r,'e' f,event_type q,{t} ts,4 ty,{_CENTS} v,event_id seq, CAST(NULL AS VARCHAR) s FROM {source}"]
    if props:
        parts.append(f"SELECT {r},'p',event_type,{t},4,NULL,event_id,props FROM {source}")
    if deletes:
        parts.append(f"SELECT {r},'e',event_type,{t},CASE WHEN event_id%97=0 THEN 12 ELSE 8 END,NULL,event_id+1000000000,NULL FROM {source} WHERE event_id%97=0 OR event_id%89=0")
        parts.append(f"SELECT {r},'e','',{t},14,NULL,event_id+2000000000,NULL FROM {source} WHERE event_id%499=0")
    limit = "true" if versions is None else f"n<={versions}"
    return (
        "WITH c AS (" + " UNION ALL ".join(parts) + f"), live AS (SELECT * FROM c WHERE {keep}), m AS (SELECT *, max(CASE WHEN ty=14 THEN ts END) OVER (PARTITION BY r,f) df, max(CASE WHEN ty=12 THEN ts END) OVER (PARTITION BY r,f,q) dc, "
        f"max(CASE WHEN ty=8 THEN 1 END) OVER (PARTITION BY r,f,q,ts) dv FROM live), vis AS (SELECT r,f,q,ts,v,seq,s FROM m WHERE ty=4 AND (df IS NULL OR ts>df) AND (dc IS NULL OR ts>dc) AND dv IS NULL AND ({pre}) AND ({columns})), "
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r,f,q,ts ORDER BY seq DESC) d FROM vis) a WHERE d=1), "
        f"vN AS (SELECT r,f,q,ts,v,s FROM (SELECT *, row_number() OVER (PARTITION BY r,f,q ORDER BY ts DESC) n FROM one) b WHERE {limit}) "
    )


OUT = "SELECT r,f,q,ts,v FROM vN"


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _scan(name: str, scan: Scan, sql: str, days: bool = False, deletes: bool = True, **more) -> None:
    _add(name, lambda spark, d: shown(visible_cells(event_cells(spark, d, days, deletes), scan, **more)), sql)


def _filter(name: str, f, tail: str = OUT, days: bool = False, scan: Scan = Scan(), **k) -> None:
    _scan(name, scan.set_filter(f), kernel(days, **k) + tail, days)


R20 = b"00000020"
_VERIFY = (
    "WITH a AS (" + kernel(days=True, pre="ts>=19730 AND ts<19745") + "SELECT * FROM vN), b AS (" + kernel(days=True, deletes=False, pre="ts>=19730 AND ts<19745") + "SELECT * FROM vN), "
    "x AS (SELECT r, string_agg(q||ts, ',' ORDER BY q, ts) k, string_agg(q||ts||'='||v, ',' ORDER BY q, ts) w FROM a GROUP BY r), y AS (SELECT r, string_agg(q||ts, ',' ORDER BY q, ts) k, string_agg(q||ts||'='||v, ',' ORDER BY q, ts) w FROM b GROUP BY r) "
    "SELECT CASE WHEN y.r IS NULL THEN 'left_only' WHEN x.r IS NULL THEN 'right_only' WHEN x.w=y.w THEN 'match' WHEN x.k=y.k THEN 'value_differs' ELSE 'keys_differ' END status, count(*) n FROM x FULL JOIN y ON x.r=y.r GROUP BY 1"
)
# -- scans ---------------------------------------------------------------------------
_scan("scan_full", Scan(), kernel() + OUT)
_scan("visible_with_deletes", Scan(max_versions=None), kernel(days=True, versions=None) + OUT, days=True)
_scan("scan_range", Scan(start=b"00000010", stop=b"00000030"), kernel(pre="r>='00000010' AND r<'00000030'") + OUT)
_scan("scan_columns", Scan().add_columns("e:click e:view"), kernel(pre="q IN ('click','view')") + OUT)
_scan("scan_timerange", Scan(max_versions=None).set_time_range(19_733, 19_745), kernel(days=True, versions=None, pre="ts>=19733 AND ts<19745") + OUT, days=True)
_scan("scan_timestamp", Scan().set_timestamp(19_738), kernel(days=True, pre="ts=19738") + OUT, days=True)
_scan("scan_versions_3", Scan(max_versions=3), kernel(versions=3) + OUT)
_scan("scan_family_cap", Scan(max_versions=None), kernel(versions=2) + OUT, caps={"e": 2})
_scan("scan_limit", Scan(limit=7), kernel() + "SELECT r,f,q,ts,v FROM vN WHERE r IN (SELECT r FROM (SELECT DISTINCT r FROM vN) t ORDER BY r LIMIT 7)")
_scan("scan_snapshot", Scan(), kernel(keep="seq<=500") + OUT, snapshot=500)
_scan("get_row", Scan(start=R20, stop=R20, max_versions=3), kernel(versions=3, pre="r='00000020'") + OUT)
_NOW = 19_760 * 86_400_000
_scan("ttl_scan", Scan(max_versions=None), kernel(versions=None, keep=f"ts>={_NOW - 30 * 86_400_000}") + OUT, now_ms=_NOW, ttl={"e": 30 * 86400})
_add("scan_family", lambda spark, d: shown(visible_cells(event_cells(spark, d, props=True), Scan().add_family("p")), False), kernel(props=True, pre="f='p'") + "SELECT r,f,q,ts,s v FROM vN")
_add(
    "scan_batch_2",
    lambda spark, d: results(visible_cells(event_cells(spark, d)), 2).select(F.col("row").cast("string").alias("r"), "part", F.size("cells").alias("n"), F.get(F.col("cells"), F.lit(0))["qualifier"].cast("string").alias("first_q")),
    kernel() + "SELECT r, CAST((k-1)//2 AS INTEGER) part, CAST(count(*) AS INTEGER) n, min(q) first_q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x GROUP BY 1,2",
)
_add("scan_raw", lambda spark, d: visible_cells(event_cells(spark, d), Scan(raw=True)).select(F.col("row").cast("string").alias("r"), F.col("qualifier").cast("string").alias("q"), "ts", F.col("type").cast("int").alias("ty"), "seq"), kernel() + "SELECT r,q,ts,ty,seq FROM c")


def _multi(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(0, b"00000030"), (1, b"missing"), (2, b"00000003"), (3, b"00000030")], "idx int, row binary")
    found = jobs.multi_get(event_cells(spark, d), asked)
    return found.select("idx", F.col("row").cast("string").alias("r"), F.col("qualifier").cast("string").alias("q"), "ts", codecs.decode_number("value").alias("v"))


_add("multi_get", _multi, kernel() + "SELECT i.idx, i.k r, q, ts, v FROM (VALUES (0,'00000030'),(1,'missing'),(2,'00000003'),(3,'00000030')) i(idx,k) LEFT JOIN vN ON vN.r=i.k")
_add("exists", lambda spark, d: spark.createDataFrame([(jobs.exists(event_cells(spark, d), Scan(start=R20, stop=R20)),)], "found boolean"), kernel(pre="r='00000020'") + "SELECT count(*)>0 AS found FROM vN")
_add("row_or_before", lambda spark, d: shown(jobs.row_or_before(event_cells(spark, d), b"00000050x", "e")), kernel() + "SELECT r,f,q,ts,v FROM vN WHERE r=(SELECT max(r) FROM vis WHERE r<='00000050x')")

# -- filters ---------------------------------------------------------------------------
for _op, _sign in ((LESS, "<"), (LESS_OR_EQUAL, "<="), (EQUAL, "="), (NOT_EQUAL, "<>"), (GREATER_OR_EQUAL, ">="), (GREATER, ">")):
    _short = {LESS: "lt", LESS_OR_EQUAL: "le", EQUAL: "eq", NOT_EQUAL: "ne", GREATER_OR_EQUAL: "ge", GREATER: "gt"}[_op]
    _filter(f"filter_row_{_short}", fl.RowFilter(_op, R20), pre=f"r {_sign} '00000020'")
_add("filter_family", lambda spark, d: shown(visible_cells(event_cells(spark, d, props=True), Scan(filter=fl.FamilyFilter(GREATER, b"e"))), False), kernel(props=True, pre="f>'e'") + "SELECT r,f,q,ts,s v FROM vN")
_filter("filter_qualifier", fl.QualifierFilter(LESS, b"purchase"), pre="q<'purchase'")
_filter("filter_value_binary", fl.ValueFilter(LESS, _n(10_000)), pre="v<10000")
_filter("filter_value_prefix", fl.ValueFilter(EQUAL, fl.BinaryPrefixComparator(_n(10_000)[:7])), pre="v//256=10000//256")
_filter("filter_row_regex", fl.RowFilter(EQUAL, fl.RegexComparator("1[0-3]$")), pre="regexp_matches(r,'1[0-3]$')")
_filter("filter_qualifier_substring", fl.QualifierFilter(NOT_EQUAL, fl.SubstringComparator("IC")), pre="NOT contains(q,'ic')")
_filter("filter_value_bit", fl.ValueFilter(EQUAL, fl.BitComparator((16).to_bytes(8, "big"), "AND")), pre="(v & 16)<>0")
_filter("filter_prefix", fl.PrefixFilter(b"0000001"), pre="starts_with(r,'0000001')")
_filter("filter_inclusive_stop", fl.InclusiveStopFilter(R20), pre="r<='00000020'")
_filter("filter_column_prefix", fl.ColumnPrefixFilter(b"p"), pre="starts_with(q,'p')")
_filter("filter_timestamps", fl.TimestampsFilter((19_730, 19_738, 19_750)), days=True, scan=Scan(max_versions=None), pre="ts IN (19730,19738,19750)", versions=None)
_filter("filter_first_key_only", fl.FirstKeyOnlyFilter(), "SELECT r,f,q,ts,v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x WHERE k=1")
_add("filter_key_only", lambda spark, d: visible_cells(event_cells(spark, d), Scan(filter=fl.KeyOnlyFilter(True))).select(F.col("row").cast("string").alias("r"), F.col("qualifier").cast("string").alias("q"), codecs.decode_number("value", "int").alias("n")), kernel() + "SELECT r,q,CAST(8 AS BIGINT) n FROM vN")
_filter("filter_column_count", fl.ColumnCountGetFilter(3), "SELECT r,f,q,ts,v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x WHERE k<=3")
_filter("filter_column_pagination", fl.ColumnPaginationFilter(2, 1), "SELECT r,f,q,ts,v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x WHERE k BETWEEN 2 AND 3")
_SCV = "SELECT r,f,q,ts,v FROM (SELECT *, max(CASE WHEN q='click' THEN CASE WHEN v<20000 THEN 1 ELSE 0 END END) OVER (PARTITION BY r) ok FROM vN) x WHERE "
_filter("filter_single_column_value", fl.SingleColumnValueFilter("e", b"click", LESS, _n(20_000)), _SCV + "ok IS NULL OR ok=1")
_filter("filter_single_column_value_if_missing", fl.SingleColumnValueFilter("e", b"click", LESS, _n(20_000), filter_if_missing=True), _SCV + "ok=1")
_filter("filter_single_column_value_exclude", fl.SingleColumnValueExcludeFilter("e", b"click", LESS, _n(20_000)), _SCV + "(ok IS NULL OR ok=1) AND q<>'click'")
_filter("filter_single_column_value_any_version", fl.SingleColumnValueFilter("e", b"click", LESS, _n(2_000), latest_only=False), _SCV.replace("20000", "2000") + "ok IS NULL OR ok=1", scan=Scan(max_versions=3), versions=3)
_DEP = "SELECT r,f,q,ts,v FROM vN WHERE EXISTS (SELECT 1 FROM vN d WHERE d.r=vN.r AND d.ts=vN.ts AND d.q='click')"
_filter("filter_dependent_column", fl.DependentColumnFilter("e", b"click"), _DEP, days=True)
_filter("filter_dependent_column_drop", fl.DependentColumnFilter("e", b"click", drop=True), _DEP + " AND q<>'click'", days=True)
_filter("filter_skip", fl.SkipFilter(fl.ValueFilter(LESS, _n(15_000))), "SELECT r,f,q,ts,v FROM (SELECT *, min(CASE WHEN v<15000 THEN 1 ELSE 0 END) OVER (PARTITION BY r) ok FROM vN) x WHERE ok=1")
_filter("filter_while_match", fl.WhileMatchFilter(fl.RowFilter(LESS_OR_EQUAL, R20)), "SELECT r,f,q,ts,v FROM vN WHERE r<coalesce((SELECT min(r) FROM vN WHERE NOT r<='00000020'),'~')")
_filter(
    "filter_while_match_value", fl.WhileMatchFilter(fl.ValueFilter(LESS, _n(15_000))),
    "SELECT r,f,q,ts,v FROM (SELECT *, row_number() OVER (ORDER BY r,f,q,ts DESC) k FROM vN) x WHERE k<coalesce((SELECT min(k) FROM (SELECT *, row_number() OVER (ORDER BY r,f,q,ts DESC) k FROM vN) y WHERE v>=15000), 1000000000)",
)
_PAGE = "SELECT r,f,q,ts,v FROM vN WHERE r IN (SELECT r FROM (SELECT DISTINCT r FROM vN) t ORDER BY r LIMIT 10)"
_filter("filter_page", fl.PageFilter(10), _PAGE)
_filter("filter_list_all", FilterList(fl.MUST_PASS_ALL, (fl.ValueFilter(LESS, _n(10_000)), fl.PageFilter(10))), _PAGE, pre="v<10000")
_filter("filter_list_page_then_value", FilterList(fl.MUST_PASS_ALL, (fl.PageFilter(10), fl.ValueFilter(LESS, _n(10_000)))), _PAGE, pre="v<10000")
_filter("filter_list_page_then_row", FilterList(fl.MUST_PASS_ALL, (fl.PageFilter(10), fl.RowFilter(GREATER, b"00000030"))), _PAGE, pre="r>'00000030'")
_filter(
    "filter_list_page_then_single_column", FilterList(fl.MUST_PASS_ALL, (fl.PageFilter(10), fl.SingleColumnValueFilter("e", b"click", LESS, _n(20_000), True))),
    "SELECT r,f,q,ts,v FROM vN WHERE r IN (SELECT r FROM (SELECT DISTINCT r FROM vN) t ORDER BY r LIMIT 10) AND r IN (SELECT r FROM vN WHERE q='click' AND v<20000)",
)
_filter("filter_list_one", FilterList(fl.MUST_PASS_ONE, (fl.RowFilter(EQUAL, R20), fl.QualifierFilter(EQUAL, b"view"))), pre="r='00000020' OR q='view'")
_filter(
    "filter_list_nested", FilterList(fl.MUST_PASS_ALL, (FilterList(fl.MUST_PASS_ONE, (fl.PrefixFilter(b"0000001"), fl.PrefixFilter(b"0000003"))), fl.SingleColumnValueFilter("e", b"click", LESS, _n(20_000), True))),
    _SCV + "ok=1", pre="starts_with(r,'0000001') OR starts_with(r,'0000003')",
)
_filter("filter_list_one_staged", FilterList(fl.MUST_PASS_ONE, (fl.FirstKeyOnlyFilter(), fl.ValueFilter(LESS, _n(2_000)))), "SELECT r,f,q,ts,v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x WHERE k=1 OR v<2000")
_filter("filter_custom", fl.ColumnFilter(lambda: F.octet_length("qualifier") == 4), pre="length(q)=4")

# -- gateways --------------------------------------------------------------------------
_JSON = '{"type":"FilterList","op":"MUST_PASS_ALL","filters":[{"type":"PrefixFilter","value":"MDAwMDAwMQ=="},{"type":"ValueFilter","op":"LESS","comparator":{"type":"BinaryComparator","value":"AAAAAAAAJxA="}}]}'
_filter("json_filter_scan", json_filter(_JSON), pre="starts_with(r,'0000001') AND v<10000")
_scan("scanner_model_scan", scanner_model({"startRow": "MDAwMDAwMTA=", "endRow": "MDAwMDAwMzA=", "column": ["ZTpjbGljaw=="], "maxVersions": 2}), kernel(versions=2, pre="r>='00000010' AND r<'00000030' AND q='click'") + OUT)
_scan("rowspec_glob", parse_rowspec("/0000001*/e:click,e:view", "?v=2"), kernel(versions=2, pre="starts_with(r,'0000001') AND q IN ('click','view')") + OUT)
_scan("shell_scan_limit", Scan(limit=5).add_columns(["e:view"]), kernel(pre="q='view'") + "SELECT r,f,q,ts,v FROM vN WHERE r IN (SELECT r FROM (SELECT DISTINCT r FROM vN) t ORDER BY r LIMIT 5)")


# -- mutations -------------------------------------------------------------------------
def _mutated(name: str, make, sql: str, days: bool = True) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cells = event_cells(spark, d, days, deletes=False)
        more = make(spark, cells).withColumn("seq", F.col("seq") + 4_000_000_000)
        return shown(visible_cells(cells.unionByName(more), Scan(max_versions=None)))

    _add(name, run, sql)


def _plain(extra: str, days: bool = True) -> str:
    """The kernel without tombstones of its own, with more cells."""
    k = kernel(days, deletes=False, versions=None)
    return k.replace("), live AS", f" UNION ALL {extra}), live AS", 1)


_ROWS = "00000010 00000020 00000030".split()
_IN = "('00000010','00000020','00000030')"
_keys = lambda spark: spark.createDataFrame([(r.encode(), i) for i, r in enumerate(_ROWS)], "row binary, seq long")
_cols = lambda spark: _keys(spark).withColumns({"family": F.lit("e"), "qualifier": F.lit(b"click")})
_mutated("put_overwrite", lambda spark, c: mutate.puts(_cols(spark).withColumns({"value": F.lit(_n(7)), "ts": F.lit(19_738).cast("long")}), 0), _plain(f"SELECT r,'e','click',19738,4,7,4000000000,NULL FROM (SELECT unnest(['00000010','00000020','00000030']) r)") + OUT)
_mutated("delete_row", lambda spark, c: mutate.delete_rows(_keys(spark), ["e", "p"], 19_738), _plain("SELECT r,'e','',19738,14,NULL,4000000000,NULL FROM (SELECT unnest(['00000010','00000020','00000030']) r)") + OUT)
_mutated("delete_family", lambda spark, c: mutate.delete_families(_keys(spark).withColumn("family", F.lit("e")), 19_743), _plain("SELECT r,'e','',19743,14,NULL,4000000000,NULL FROM (SELECT unnest(['00000010','00000020','00000030']) r)") + OUT)
_mutated("delete_columns", lambda spark, c: mutate.delete_columns(_cols(spark), 19_741), _plain("SELECT r,'e','click',19741,12,NULL,4000000000,NULL FROM (SELECT unnest(['00000010','00000020','00000030']) r)") + OUT)
_mutated("delete_column_latest", lambda spark, c: mutate.delete_versions(_cols(spark), c, 99_999), _plain(f"SELECT lpad(CAST(user_id AS VARCHAR),8,'0'),'e','click',max({_DAY}),8,NULL,4000000000,NULL FROM events WHERE event_type='click' AND lpad(CAST(user_id AS VARCHAR),8,'0') IN {_IN} GROUP BY 1") + OUT)


def _counts(spark: SparkSession, d: str, more: bool) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.lpad(F.col("user_id").cast("string"), 8, "0").cast("binary").alias("row"), F.lit("n").alias("family"), F.col("event_type").cast("binary").alias("qualifier"), F.lit(1).cast("long").alias("amount"))
    state = mutate.increments(ev, event_cells(spark, d).limit(0), 10)
    if more:
        again = mutate.increments(ev.where(F.col("qualifier") == F.lit(b"click")).withColumn("amount", F.lit(10).cast("long")), state, 20)
        state = state.unionByName(again.withColumn("seq", F.col("seq") + 1))
    return shown(visible_cells(state)).select("r", "q", "ts", "v")


_add("increment", lambda spark, d: _counts(spark, d, False), "SELECT lpad(CAST(user_id AS VARCHAR),8,'0') r, event_type q, CAST(10 AS BIGINT) ts, count(*) v FROM events GROUP BY 1,2")
_add("increment_multi", lambda spark, d: _counts(spark, d, True), "SELECT lpad(CAST(user_id AS VARCHAR),8,'0') r, event_type q, CAST(CASE WHEN event_type='click' THEN 20 ELSE 10 END AS BIGINT) ts, count(*)*CASE WHEN event_type='click' THEN 11 ELSE 1 END v FROM events GROUP BY 1,2")


def _checked(spark: SparkSession, d: str, delete: bool) -> DataFrame:
    cells = customer_cells(spark, d)
    rows = cells.select("row").distinct()
    checks = rows.select(F.col("row").alias("check"), "row", F.lit("c").alias("family"), F.lit(b"segment").alias("qualifier"), F.lit(b"BUILDING").alias("expected"))
    base = rows.select(F.col("row").alias("check"), "row", F.lit("c").alias("family"), F.lit(b"nation" if delete else b"mark").alias("qualifier"), F.lit(0).cast("long").alias("seq"), F.lit(b"x").alias("value"))
    made = (mutate.delete_columns(base, 5) if delete else mutate.puts(base, 5)).withColumn("check", F.col("row"))
    more, _ = mutate.check_and_mutate(checks, made, cells)
    return shown(visible_cells(cells.unionByName(more)), False)


_CU = "SELECT lpad(CAST(c_custkey AS VARCHAR),8,'0') r,'c' f,{q} q,CAST({t} AS BIGINT) ts,{v} v FROM customer"
_three = [_CU.format(q="'name'", t=1, v="c_name"), _CU.format(q="'segment'", t=1, v="c_mktsegment")]
_nation = _CU.format(q="'nation'", t=1, v="CAST(c_nationkey AS VARCHAR)")
_add("check_and_put", lambda spark, d: _checked(spark, d, False), " UNION ALL ".join([*_three, _nation, _CU.format(q="'mark'", t=5, v="'x'") + " WHERE c_mktsegment='BUILDING'"]))
_add("check_and_delete", lambda spark, d: _checked(spark, d, True), " UNION ALL ".join([*_three, _nation + " WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'"]))
_add("major_compact", lambda spark, d: shown(visible_cells(mutate.compact(event_cells(spark, d, True), True, {"e": 3}), Scan(raw=True))), kernel(days=True, versions=3) + OUT)
_add(
    "minor_compact_keeps_tombstones",
    lambda spark, d: mutate.compact(event_cells(spark, d, True), False, {"e": 3}).select(F.col("row").cast("string").alias("r"), F.col("qualifier").cast("string").alias("q"), "ts", F.col("type").cast("int").alias("ty"), "seq"),
    kernel(days=True) + "SELECT r,q,ts,ty,max(seq) seq FROM c GROUP BY r,f,q,ts,ty",
)

# -- jobs ------------------------------------------------------------------------------
_add("row_count", lambda spark, d: jobs.count_rows(event_cells(spark, d)), kernel() + "SELECT count(DISTINCT r) n FROM vN")
_add("row_counter_job", lambda spark, d: jobs.row_counter(event_cells(spark, d, props=True), Scan().add_family("p")), kernel(props=True, pre="f='p'") + "SELECT count(*) n FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f,q,ts DESC) k FROM vN) x WHERE k=1 AND length(s)>0")
_add("import_exported", lambda spark, d: shown(visible_cells(jobs.import_cells(jobs.export_cells(event_cells(spark, d, True), 2, 19_730, 19_745), {"e": "n"}), Scan(max_versions=None))), kernel(days=True, versions=2, pre="ts>=19730 AND ts<19745") + "SELECT r,'n' f,q,ts,v FROM vN")
_add("verify_time_range", lambda spark, d: jobs.verify_copy(event_cells(spark, d, True), event_cells(spark, d, True, False), 19_730, 19_745, ["e"]).groupBy("status").agg(F.count("*").alias("n")), _VERIFY)
_add("export_versions", lambda spark, d: shown(visible_cells(jobs.export_cells(event_cells(spark, d, True), 2, 19_730, 19_745), Scan(raw=True))), kernel(days=True, versions=2, pre="ts>=19730 AND ts<19745") + OUT)
_add("copy_table_range", lambda spark, d: shown(jobs.copy_cells(event_cells(spark, d, True), 19_730, 19_745, ["e:copy"])), kernel(days=True, pre="ts>=19730 AND ts<19745") + "SELECT r,'copy' f,q,ts,v FROM vN")


def _tsv(spark: SparkSession, d: str, bad: bool) -> DataFrame:
    from .sources.text import parse_tsv

    na = spark.read.parquet(f"{d}/nation.parquet")
    text = F.when(F.col("n_nationkey") % 7 == 3, F.col("n_name")).when(F.col("n_nationkey") % 7 == 5, F.concat_ws("\t", "n_name", F.lit("a"), F.lit("b"), F.lit("c"))).when(F.col("n_nationkey") % 7 == 6, F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"))).otherwise(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")))
    cells, wrong = parse_tsv(na.select(text.alias("value")), "f:name,ROW_KEY,g", 77)
    return wrong.agg(F.count("*").alias("bad_lines")) if bad else shown(cells, False)


_add("import_tsv", lambda spark, d: _tsv(spark, d, False), "SELECT CAST(n_nationkey AS VARCHAR) r,'f' f,'name' q,CAST(77 AS BIGINT) ts,n_name v FROM nation WHERE n_nationkey%7 NOT IN (3,5) UNION ALL SELECT CAST(n_nationkey AS VARCHAR),'g','',77,CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey%7 NOT IN (3,5,6)")
_add("import_tsv_bad_lines", lambda spark, d: _tsv(spark, d, True), "SELECT count(*) bad_lines FROM nation WHERE n_nationkey%7 IN (3,5)")


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    from .sources.text import parse_uploads

    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.lit("f"), "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string"))).alias("value"))
    return shown(parse_uploads(lines, 9), False)


_add("sample_upload", _uploads, "SELECT CAST(n_nationkey AS VARCHAR) r,'f' f,n_name q,CAST(9 AS BIGINT) ts,CAST(n_regionkey AS VARCHAR) v FROM nation WHERE n_regionkey>1")
_add(
    "group_columns",
    lambda spark, d: jobs.group_key(visible_cells(customer_cells(spark, d)), [("c", b"segment"), ("c", b"nation")]).groupBy("key").agg(F.count("*").alias("n")),
    "SELECT CAST(c_nationkey AS VARCHAR)||' '||c_mktsegment AS key, count(*) n FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1",
)
_add(
    "index_build",
    lambda spark, d: jobs.build_index(customer_cells(spark, d), "c", [b"segment", b"nation"], 3).select(F.col("index").cast("string").alias("idx"), F.col("row").cast("string").alias("r"), F.col("value").cast("string").alias("v"), "ts"),
    "SELECT 'segment' idx, c_mktsegment r, lpad(CAST(c_custkey AS VARCHAR),8,'0') v, CAST(3 AS BIGINT) ts FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), lpad(CAST(c_custkey AS VARCHAR),8,'0'), 3 FROM customer",
)
_add(
    "index_lookup",
    lambda spark, d: shown(jobs.index_lookup(jobs.build_index(customer_cells(spark, d), "c", [b"nation"], 3), visible_cells(customer_cells(spark, d)), b"7"), False),
    "SELECT * FROM (" + " UNION ALL ".join([*_three, _nation]) + ") x WHERE r IN (SELECT lpad(CAST(c_custkey AS VARCHAR),8,'0') FROM customer WHERE c_nationkey=7)",
)


def _verify(spark: SparkSession, d: str) -> DataFrame:
    a = visible_cells(event_cells(spark, d, deletes=False))
    num = F.col("row").cast("string").cast("long")
    b = a.where(num % 11 != 0).withColumn("value", F.when(num % 7 == 0, F.lit(b"x")).otherwise(F.col("value")))
    b = b.where(~((num % 13 == 0) & (F.col("qualifier") == F.lit(b"click")))).unionByName(a.where(num == 1).withColumn("row", F.lit(b"extra")))
    return jobs.good_and_bad(jobs.compare_tables(a, b))


_add("verify_tables", _verify, kernel(deletes=False) + "SELECT count(*) FILTER (WHERE NOT bad) goodrows, count(*) FILTER (WHERE bad) badrows FROM (SELECT r, (CAST(r AS BIGINT)%11=0 OR (CAST(r AS BIGINT)%13=0 AND max(CASE WHEN q='click' THEN 1 ELSE 0 END)=1)) bad FROM vN GROUP BY r) x")
_SPLITS = [b"00000050", b"00000100"]
_add("endpoint_sum_per_region", lambda spark, d: jobs.endpoint_sum(event_cells(spark, d), "e", b"click", _SPLITS, kind="long"), kernel(pre="q='click'") + "SELECT CASE WHEN r>='00000100' THEN 2 WHEN r>='00000050' THEN 1 ELSE 0 END region, CAST(sum(v) AS BIGINT) total FROM vN GROUP BY 1")
def _per_region(batches):
    """region, cells and rows of one region, however many batches it has."""
    import pyarrow as pa

    region, cells, rows, last = None, 0, 0, None
    for b in batches:
        keys = b.column("row").to_pylist()
        region, cells = b.column("region")[0].as_py(), cells + len(keys)
        rows, last = rows + sum(x != y for x, y in zip(keys, [last, *keys], strict=False)), keys[-1]
    yield pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), pa.array([cells], pa.int64()), pa.array([rows], pa.int64())], ["region", "cells", "n_rows"])


_add("endpoint_custom", lambda spark, d: jobs.endpoint(visible_cells(event_cells(spark, d)), _SPLITS, _per_region, "region int, cells long, n_rows long"), kernel() + "SELECT CAST(CASE WHEN r>='00000100' THEN 2 WHEN r>='00000050' THEN 1 ELSE 0 END AS INTEGER) region, count(*) cells, count(DISTINCT r) n_rows FROM vN GROUP BY 1")
_add("endpoint_sum", lambda spark, d: jobs.endpoint_sum(event_cells(spark, d), "e", b"click", _SPLITS, start=b"00000060", kind="long").agg(F.sum("total").alias("total")), kernel(pre="q='click' AND r>='00000050'") + "SELECT CAST(sum(v) AS BIGINT) total FROM vN")

# -- functions -------------------------------------------------------------------------
_add(
    "codecs_round_trip",
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), codecs.decode_number(codecs.encode_number(F.col("o_orderkey") - 500)).alias("l"), codecs.decode_number(codecs.encode_number(F.col("o_custkey") - 700, "int"), "int").alias("i"), codecs.decode_number(codecs.encode_number(F.col("o_orderkey") % 60000 - 30000, "short"), "short").alias("s"), codecs.decode_string(codecs.format_row("o_orderkey")).alias("r")),
    "SELECT o_orderkey k, o_orderkey-500 l, o_custkey-700 i, o_orderkey%60000-30000 s, lpad(CAST(o_orderkey AS VARCHAR),10,'0') r FROM orders",
)
_add("url_keys", lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", codecs.url_key("url").alias("key"), (codecs.url_of_key(codecs.url_key("url")) == F.col("url")).alias("back")), r"SELECT page_id, 'r:'||regexp_extract(url,'^([a-z]+://)',1)||array_to_string(list_reverse(string_split(regexp_extract(url,'^[a-z]+://([^:/?#]+)',1),'.')),'.')||regexp_extract(url,'^[a-z]+://[^:/?#]+(.*)$',1) AS key, true AS back FROM pages")
_add("increment_bytes", lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", codecs.decode_number(codecs.increment_bytes(codecs.encode_number("n_nationkey"), -3)).alias("n")), "SELECT n_nationkey, CAST(n_nationkey-3 AS BIGINT) n FROM nation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three newest visible versions of every column, of the rows that pass a value filter."""
    scan = Scan(max_versions=3, filter=fl.SingleColumnValueFilter("e", b"click", LESS, _n(20_000)))
    return shown(visible_cells(event_cells(spark, sf_dir), scan))


_add(
    "flagship", flagship,
    kernel(versions=3) + "SELECT r,f,q,ts,v FROM (SELECT *, max(CASE WHEN k=1 THEN CASE WHEN v<20000 THEN 1 ELSE 0 END END) OVER (PARTITION BY r) ok FROM (SELECT *, CASE WHEN q='click' THEN row_number() OVER (PARTITION BY r,f,q ORDER BY ts DESC) END k FROM vN) y) x WHERE ok IS NULL OR ok=1",
)


def _replicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: a table's batches shipped to a second catalog by a stream."""
    import tempfile
    import uuid

    from .sources.catalog import Catalog, Family
    from .streaming.replication import Replication

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir() + "/checkpoints"
    root = f"{base.rstrip('/')}/replicate-{uuid.uuid4().hex}"
    a, b = Catalog(spark, f"{root}/a"), Catalog(spark, f"{root}/b")
    for c in (a, b):
        c.create("ev", [Family("e", replication_scope=1)])
    cells = event_cells(spark, d)
    a.append("ev", cells.where("type = 4"))
    a.append("ev", cells.where("type <> 4"))
    ship = Replication(a, f"{root}/at")
    ship.add_peer("b", b)
    for q in ship.start("ev", available_now=True):
        q.awaitTermination()
    return shown(visible_cells(b.cells("ev")))


_add("replicate_batch", _replicate, kernel() + OUT)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""A query for each operator of the engine over the driver's tables, with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.plans import spec
from spillway.plans.dag import compile_job
from spillway.plans.jobs import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}



class T(str):
    """A table of the driver, as a source: T("orders")."""


def source(table: str, sf_dir: str, order: Any = None) -> dict[str, Any]:
    return {"kind": "parquet", "url": f"{sf_dir}/{table}.parquet", "order": order}


def node(name: str, src: Mapping[str, Any] | str, steps: list | None = None, reduce: Mapping | None = None, depends: list | None = None, sinks: list | None = None) -> dict[str, Any]:
    given = {"kind": "ref", "node": src} if isinstance(src, str) and not isinstance(src, T) else src
    return {"id": name, "depends": depends or ([src] if isinstance(src, str) and not isinstance(src, T) else []), "pipeline": {"source": given, "steps": steps or [], "reduce": reduce, "sinks": sinks or []}}


def add(name: str, sql: str | None, *nodes: dict[str, Any], order: Any = None) -> None:
    """A job whose last node is the result; sources given as T(table) read that table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = []
        for n in nodes:
            src = n["pipeline"]["source"]
            own.append(n | {"pipeline": n["pipeline"] | {"source": source(src, sf_dir, order) if isinstance(src, T) else source(src["table"], sf_dir, src["order"]) if "table" in src else src}})
        return compile_job(spec.job_of({"job": name, "nodes": own}), spark)[own[-1]["id"]]

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def steps(name: str, table: str, sql: str, *given: dict[str, Any], reduce: Mapping | None = None, order: Any = None) -> None:
    add(name, sql, node("n", T(table), list(given), reduce), order=order)


def f(expr: str) -> dict[str, Any]:
    return {"kind": "filter", "expr": expr}


def p(*cols: str) -> dict[str, Any]:
    return {"kind": "project", "cols": list(cols)}


def x(keep: bool = False, **fields: str) -> dict[str, Any]:
    return {"kind": "expr-map", "fields": fields, "keep": keep}


def typed(*fields: tuple[str, str], passthrough: bool = False) -> dict[str, Any]:
    return {"kind": "to-typed", "passthrough": passthrough, "fields": [{"name": n, "type": t} for n, t in fields]}


def agg(by: list[str], *aggs: tuple[str, ...], **more: Any) -> dict[str, Any]:
    return {"group-by": by, "aggs": [{"name": a[0], "kind": a[1], "of": a[2] if len(a) > 2 else None} for a in aggs], **more}


# Filters.
steps("filter_gt", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30", f("l_quantity > 30"), p("l_orderkey", "l_linenumber", "l_quantity"))
steps("filter_ge", "part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 40", f("p_size >= 40"), p("p_partkey", "p_size"))
steps("filter_lt", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0", f("c_acctbal < 0"), p("c_custkey", "c_acctbal"))
steps("filter_le", "customer", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <= 3", f("c_nationkey <= 3"), p("c_custkey", "c_nationkey"))
steps("filter_eq_text", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", f("o_orderstatus == 'F'"), p("o_orderkey", "o_orderstatus"))
steps("filter_eq_number", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey = 7", f("c_nationkey == '7.0'"), p("c_custkey"))
steps("filter_ne_text", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'", f('c_mktsegment != "BUILDING"'), p("c_custkey", "c_mktsegment"))
steps("filter_like", "customer", "SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '.*00.', 'i')", f("c_name LIKE '%00_'"), p("c_custkey", "c_name"))
steps("filter_like_multiline", "documents", "SELECT doc_id FROM documents WHERE regexp_full_match(text, '.*en.*', 'i')", f("text LIKE '%en%'"), p("doc_id"))
steps("filter_like_case", "customer", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'build%'", f("c_mktsegment like 'build%'"), p("c_custkey"))
MAYBE = x(True, v="CASE WHEN event_id % 2 = 0 THEN value END", t="CASE WHEN event_id % 3 = 0 THEN event_type END")
EVENTS = "(SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v, CASE WHEN event_id % 3 = 0 THEN event_type END AS t FROM events)"
steps("filter_ne_null", "events", f"SELECT event_id FROM {EVENTS} WHERE t IS DISTINCT FROM 'click'", MAYBE, f("t != 'click'"), p("event_id"))
steps("filter_lt_null", "events", f"SELECT event_id FROM {EVENTS} WHERE coalesce(v < 50, true)", MAYBE, f("v < 50"), p("event_id"))
steps("filter_gt_null", "events", f"SELECT event_id FROM {EVENTS} WHERE v > 50", MAYBE, f("v > 50"), p("event_id"))
steps("filter_eq_null", "events", f"SELECT event_id FROM {EVENTS} WHERE v IS NULL", MAYBE, f("v == null"), p("event_id"))
steps("filter_lt_text", "orders", "SELECT o_orderkey FROM orders", f("o_orderpriority < '1995-01-01'"), p("o_orderkey"))
steps("filter_gt_text", "orders", "SELECT o_orderkey FROM orders WHERE false", f("o_orderpriority > '1995-01-01'"), p("o_orderkey"))
steps("filter_gt_text_digits", "orders", "SELECT o_orderkey FROM orders WHERE try_cast(right(o_orderkey::VARCHAR, 1) AS double) > 5", x(True, d="right(cast(o_orderkey AS string), 1)"), f("d > 5"), p("o_orderkey"))
steps("filter_text_equals_digits", "orders", "SELECT o_orderkey FROM orders WHERE right(o_orderkey::VARCHAR, 1) = '3'", x(True, d="right(cast(o_orderkey AS string), 1)"), f("d == 3"), p("o_orderkey"))
steps("filter_text_as_number", "orders", "SELECT o_orderkey FROM orders WHERE coalesce(try_cast(substr(o_orderpriority, 1, 1) AS double), 0) >= 3", x(True, d="substr(o_orderpriority, 1, 1)"), f("d >= 3"), p("o_orderkey"))
steps("filter_text_not_number", "orders", "SELECT o_orderkey FROM orders WHERE false", x(True, d="concat(substr(o_orderpriority, 1, 1), '.0')"), f("d == 3"), p("o_orderkey"))
steps("filter_missing_field", "region", "SELECT r_regionkey FROM region", f("nowhere < 5"), f("nowhere == null"), p("r_regionkey"))
steps("filter_nested", "events", "SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS double) > 50", x(True, j="from_json(props, 'k double')"), f("j.k > 50"), p("event_id"))

# Projection, renaming, constants.
steps("project", "nation", "SELECT n_name, n_nationkey FROM nation", p("n_name", "n_nationkey", "nowhere"))
steps("rename", "nation", "SELECT n_name AS name, n_nationkey, n_regionkey FROM nation", {"kind": "rename", "from": "n_name", "to": "name"})
steps("rename_over", "nation", "SELECT n_name, n_nationkey AS n_regionkey FROM nation", {"kind": "rename", "from": "n_nationkey", "to": "n_regionkey"})
steps("rename_missing", "region", "SELECT r_regionkey, r_name FROM region", {"kind": "rename", "from": "nowhere", "to": "r_name"})
steps("set_field", "region", "SELECT r_regionkey, 'x' AS r_name, 7 AS seven, 1.5::DOUBLE AS half, true AS yes FROM region", *({"kind": "set-field", "name": n, "value": v} for n, v in (("r_name", "x"), ("seven", 7), ("half", 1.5), ("yes", True))))
steps("set_field_nested", "region", "SELECT r_regionkey, 'b' AS ab, 2 AS n FROM region", {"kind": "set-field", "name": "o", "value": {"a": "b", "c": [1, 2]}}, x(r_regionkey="r_regionkey", ab="o.a", n="cast(size(o.c) as int)"))

# Coercions.
steps("totyped_long", "orders", "SELECT o_orderkey, try_cast(d AS BIGINT) AS d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE substr(o_orderpriority, 1, 1) END AS d FROM orders) WHERE d <> 'x'", x(True, d="CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE concat(' ', substr(o_orderpriority, 1, 1), ' ') END"), typed(("o_orderkey", "core_long"), ("d", "core_long")))
steps("totyped_long_number", "customer", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS c_acctbal FROM customer", typed(("c_custkey", "core_long"), ("c_acctbal", "core_long")))
steps("totyped_double", "orders", "SELECT o_orderkey, o_orderkey / 4 AS d FROM orders", x(True, d="concat(cast(o_orderkey div 4 as string), CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END)"), typed(("o_orderkey", "core_long"), ("d", "core_double")))
steps("totyped_bool", "customer", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS b FROM customer WHERE c_custkey % 4 <> 2", x(True, b="CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 't' END"), typed(("c_custkey", "core_long"), ("b", "core_boolean")))
steps("totyped_string", "nation", "SELECT n_nationkey::VARCHAR AS n_nationkey FROM nation", typed(("n_nationkey", "core_string")))
steps("totyped_timestamp", "orders", "SELECT o_orderkey, epoch_ms(o_orderdate) AS o_orderdate FROM orders", typed(("o_orderkey", "core_long"), ("o_orderdate", "core_timestamp")))
steps("totyped_instant", "events", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS t FROM events WHERE event_id % 2 = 0", x(True, t="CASE WHEN event_id % 2 = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE date_format(ts, 'yyyy-MM-dd') END"), typed(("event_id", "core_long"), ("t", "core_timestamp")))
steps("totyped_array", "customer", "SELECT c_custkey, 3 AS n, 'b' AS second, c_custkey AS last FROM customer", x(True, a="concat('1, 2, ', c_custkey, ',,')", b="'a, b,c'"), typed(("c_custkey", "core_long"), ("a", "array<core_long>"), ("b", "array<core_string>")), x(c_custkey="c_custkey", n="size(a)", second="b[1]", last="a[2]"))
steps("totyped_array_bad_element", "region", "SELECT r_regionkey, NULL::BIGINT AS bad, 2::BIGINT AS good FROM region", x(True, a="'x,2'"), typed(("r_regionkey", "core_long"), ("a", "array<core_long>")), x(r_regionkey="r_regionkey", bad="a[0]", good="a[1]"))
steps("totyped_null_kept", "events", f"SELECT event_id, v FROM {EVENTS}", MAYBE, typed(("event_id", "core_long"), ("v", "core_double")))
steps("totyped_passthrough", "region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region", typed(("r_regionkey", "core_long"), passthrough=True))
steps("totyped_path", "events", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", x(True, j="from_json(props, 'k string')"), typed(("event_id", "core_long"), ("j.k", "core_long")), x(event_id="event_id", k="j.k"))
steps("totyped_unknown_type", "region", "SELECT r_regionkey, r_name FROM region", typed(("r_regionkey", "core_strange"), ("r_name", "core_string")))

# Lookups.
LOOK = {"kind": "lookup", "from": "nations", "onField": "n_nationkey", "withKey": "c_nationkey", "adds": ["n_name", "n_regionkey"]}
FEW = node("few", T("nation"), [f("n_regionkey < 3")], sinks=[{"kind": "memory-table", "name": "nations"}])
add("lookup_left", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey", FEW, node("n", T("customer"), [LOOK, p("c_custkey", "n_name", "n_regionkey")], depends=["few"]))
add("lookup_overwrite", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey", node("few", T("nation"), [f("n_regionkey < 3"), {"kind": "rename", "from": "n_name", "to": "c_name"}]), node("n", T("customer"), [LOOK | {"from": "few", "adds": ["c_name"]}, p("c_custkey", "c_name")], depends=["few"]))
add("lookup_first_wins", "SELECT n_nationkey, first AS o_orderkey FROM nation LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) ON n_nationkey = o_custkey", node("all", {"kind": "parquet", "table": "orders", "order": "o_orderkey"}), node("n", T("nation"), [{"kind": "lookup", "from": "all", "onField": "o_custkey", "withKey": "n_nationkey", "adds": ["o_orderkey"]}, p("n_nationkey", "o_orderkey")], depends=["all"]))
add("lookup_missing_table", "SELECT r_regionkey, r_name FROM region", node("n", T("region"), [{"kind": "lookup", "from": "nowhere", "onField": "a", "withKey": "r_regionkey", "adds": ["b"]}]))

# Reductions.
steps("reduce_count", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1", reduce=agg(["l_returnflag"], ("n", "COUNT")))
steps("reduce_sum", "lineitem", "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1", reduce=agg(["l_returnflag"], ("s", "SUM", "l_quantity")))
steps("reduce_avg_all_rows", "events", f"SELECT event_type, coalesce(sum(floor(v)), 0)::DOUBLE / count(*) AS a FROM {EVENTS} GROUP BY 1", MAYBE, x(event_type="event_type", v="floor(v)"), reduce=agg(["event_type"], ("a", "AVG", "v")))
steps("reduce_min_max", "orders", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1", reduce=agg(["o_orderpriority"], ("lo", "MIN", "o_totalprice"), ("hi", "MAX", "o_totalprice")))
steps("reduce_no_numbers", "orders", "SELECT o_orderstatus, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi FROM orders GROUP BY 1", reduce=agg(["o_orderstatus"], ("s", "SUM", "o_orderpriority"), ("a", "AVG", "o_orderpriority"), ("lo", "MIN", "o_orderpriority"), ("hi", "MAX", "nowhere")))
steps("reduce_distinct", "events", f"SELECT user_id % 10 || '' AS u, count(DISTINCT t) AS d FROM {EVENTS} GROUP BY 1", MAYBE, x(u="user_id % 10", t="t"), reduce=agg(["u"], ("d", "DISTINCT_COUNT", "t")))
steps("reduce_first_last", "events", f"SELECT event_type, arg_min(v, event_id) AS first, max_by(event_id, event_id) AS last FROM {EVENTS} WHERE event_id >= 0 GROUP BY 1", MAYBE, reduce=agg(["event_type"], ("first", "FIRST", "v"), ("last", "LAST", "event_id")), order="event_id")
steps("reduce_last_null", "events", f"SELECT event_type, (list(v ORDER BY event_id))[-1] AS last FROM {EVENTS} GROUP BY 1", MAYBE, reduce=agg(["event_type"], ("last", "LAST", "v")), order="event_id")
add("reduce_collect", "SELECT n_regionkey::VARCHAR AS n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS names, len(list(n_nationkey)) AS n FROM nation GROUP BY n_regionkey", node("a", T("nation"), None, agg(["n_regionkey"], ("names", "COLLECT", "n_name"), ("keys", "COLLECT", "n_nationkey"))), node("n", "a", [x(n_regionkey="n_regionkey", names="array_join(names, ';')", n="cast(size(keys) as bigint)")]), order="n_nationkey")
steps("reduce_null_key", "events", f"SELECT coalesce(t, '<null>') AS t, count(*) AS n FROM {EVENTS} GROUP BY 1", MAYBE, reduce=agg(["t"], ("n", "COUNT")))
steps("reduce_two_keys", "lineitem", "SELECT l_returnflag, l_linenumber::VARCHAR AS l_linenumber, count(*) AS n, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2", reduce=agg(["l_returnflag", "l_linenumber"], ("n", "COUNT"), ("m", "MAX", "l_quantity")))
steps("reduce_all", "lineitem", "SELECT count(*) AS n, max(l_quantity) AS m FROM lineitem", reduce=agg([], ("n", "COUNT"), ("m", "MAX", "l_quantity")))
steps("reduce_all_of_nothing", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE false HAVING count(*) > 0", f("l_quantity > 1000000"), reduce=agg([], ("n", "COUNT")))
steps("reduce_all_of_some", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 49", f("l_quantity > 49"), reduce=agg([], ("n", "COUNT")))
steps("reduce_shuffle_hint", "lineitem", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1", reduce=agg(["l_linestatus"], ("n", "COUNT"), shuffle=True, buckets=4))
steps("reduce_named_like_key", "lineitem", "SELECT count(*) AS l_linestatus FROM lineitem GROUP BY lineitem.l_linestatus", reduce=agg(["l_linestatus"], ("l_linestatus", "COUNT")))
steps("reduce_missing_key", "region", "SELECT '<null>' AS nowhere, count(*) AS n FROM region", reduce=agg(["nowhere"], ("n", "COUNT")))

# Graphs, SQL, expressions.
add("dag_fanout", "SELECT 'flag' AS branch, l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus", node("a", T("lineitem"), [f("l_quantity > 10")]), node("b", "a", None, agg(["l_linestatus"], ("n", "COUNT"))), node("c", "a", None, agg(["l_returnflag"], ("n", "COUNT"))), node("n", {"kind": "sql", "sql": "SELECT 'flag' AS branch, l_returnflag AS k, n FROM c UNION ALL SELECT 'status', l_linestatus, n FROM b"}, depends=["b", "c"]))
add("dag_diamond", "SELECT c_mktsegment, n, poor FROM (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 1000) AS poor FROM customer GROUP BY 1) WHERE poor > 0", node("a", T("customer")), node("b", "a", None, agg(["c_mktsegment"], ("n", "COUNT"))), node("c", "a", [f("c_acctbal < 1000")], agg(["c_mktsegment"], ("poor", "COUNT"))), node("n", "b", [{"kind": "lookup", "from": "c", "onField": "c_mktsegment", "withKey": "c_mktsegment", "adds": ["poor"]}, f("poor > 0")], depends=["b", "c"]))
add("ref_unknown", "SELECT 1 AS k, 'x' AS made FROM region WHERE false", node("n", {"kind": "ref", "node": "nowhere"}, [x(k="1"), {"kind": "set-field", "name": "made", "value": "x"}]))
add("sql_source", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", node("c", T("customer")), node("the-nations", T("nation")), node("n", {"kind": "sql", "sql": "SELECT c_mktsegment, count(*) AS n FROM c JOIN the_nations ON c_nationkey = n_nationkey GROUP BY 1"}, depends=["c", "the-nations"]))
steps("sql_step", "orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 5", {"kind": "jvssql", "sql": "SELECT o_orderkey, r FROM (SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS r FROM input) WHERE r <= 5"})
steps("expr_map_bucket", "part", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 15 THEN 'middle' ELSE 'small' END AS size FROM part", x(p_partkey="p_partkey", size="CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 15 THEN 'middle' ELSE 'small' END"))
steps("expr_map_text", "nation", "SELECT lower(n_name) AS lower, replace(n_name, 'A', 'o') AS r, left(n_name, 3) AS start, coalesce(nullif(n_name, 'CHINA'), 'none') AS n FROM nation", x(lower="lower(n_name)", r="replace(n_name, 'A', 'o')", start="substring(n_name, 1, 3)", n="coalesce(nullif(n_name, 'CHINA'), 'none')"))
steps("expr_map_words", "customer", "SELECT c_custkey, len(list_distinct(string_split(c_name || ' x x', ' ')))::INT AS n FROM customer", x(c_custkey="c_custkey", n="size(array_distinct(split(concat(c_name, ' x x'), ' ')))"))
steps("gen_sequence", "orders", "SELECT count(*) AS n, count(*) AS different, 1::BIGINT AS lo, count(*) AS hi FROM orders", x(n="gen.next('n')"), {"kind": "jvssql", "sql": "SELECT count(*) AS n, count(DISTINCT n) AS different, min(n) AS lo, max(n) AS hi FROM input"})
steps("gen_ranges", "orders", "SELECT count(*) AS n, true AS inside, true AS picked, true AS ids FROM orders", x(r="gen.randomInt(3, 6)", p="gen.pick(array('a', 'b'))", u="gen.uuid()", q="gen.random()", t="gen.nowMillis()", s="gen.now()"), {"kind": "jvssql", "sql": "SELECT count(*) AS n, min(r) >= 3 AND max(r) <= 5 AND min(q) >= 0 AND max(q) < 1 AS inside, bool_and(p IN ('a', 'b')) AS picked, count(DISTINCT u) = count(*) AND min(length(s)) = 27 AND min(t) > 0 AS ids FROM input"})
add("inline_source", "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, 2.0::DOUBLE)) t(k, s, d)", node("n", {"kind": "inline", "rows": [{"k": 1, "s": "a", "d": 1.5}, {"k": 2, "d": 2.0}]}))
add("inline_mixed", "SELECT 'a' AS g, 30.0::DOUBLE AS s, 10.0::DOUBLE AS a, 3::BIGINT AS d", node("n", {"kind": "inline", "rows": [{"g": "a", "v": 10}, {"g": "a", "v": "bogus"}, {"g": "a", "v": 20}]}, None, agg(["g"], ("s", "SUM", "v"), ("a", "AVG", "v"), ("d", "DISTINCT_COUNT", "v"))))

# Files, stores, an index, a database, a stream: written by a run of the engine, then read back.


def _home(spark: SparkSession) -> str:
    """A new folder of its own in the shared one; where none is set (tests), on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/spillway-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spillway-")


def _run(spark: SparkSession, home: str, *nodes: dict[str, Any]) -> DataFrame:
    run = Engine(spark, home).run(spec.job_of({"job": "round-trip", "nodes": list(nodes)}))
    if run.status.state != "SUCCEEDED":
        raise RuntimeError(run.status.error)
    return run.table(nodes[-1]["id"])


def round_trip(name: str, table: str, sql: str, sink: dict[str, Any], back: dict[str, Any], *then: dict[str, Any], first: tuple[dict[str, Any], ...] = (), order: Any = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = _home(spark)
        put = lambda given: {k: v.replace("HOME", home) if isinstance(v, str) else v for k, v in given.items()}
        _run(spark, home, node("w", source(table, sf_dir, order), list(first), sinks=[put(sink)]))
        return compile_job(spec.job_of({"job": name, "nodes": [node("n", put(back), list(then))]}), spark, home)["n"]

    QUERIES[name], ORACLE_SQL[name] = run, sql


CUSTOMER = p("c_custkey", "c_name", "c_nationkey", "c_acctbal")
round_trip("ndjson_round_trip", "customer", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer", {"kind": "ndjson-file", "url": "HOME/a.ndjson"}, {"kind": "ndjson-file", "url": "HOME/a.ndjson"}, first=(CUSTOMER,))
round_trip("ndjson_gzip_round_trip", "nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", {"kind": "ndjson-file", "url": "HOME/a.ndjson.gz"}, {"kind": "ndjson-file", "url": "HOME/a.ndjson.gz"})
round_trip("json_round_trip", "nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", {"kind": "json-file", "url": "HOME/a.json", "pretty": True}, {"kind": "json-file", "url": "HOME/a.json"})
round_trip("csv_round_trip", "customer", "SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', \"x\"' AS c_name, '' AS nothing FROM customer", {"kind": "csv-file", "url": "HOME/a.csv", "cols": ["c_custkey", "c_name", "nothing"]}, {"kind": "csv-file", "url": "HOME/a.csv"}, first=(x(c_custkey="c_custkey", c_name="concat(c_name, ', \"x\"')"),))
round_trip("csv_folder_typed", "customer", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer", {"kind": "csv-file", "url": "HOME/c/", "cols": ["c_custkey", "c_nationkey"]}, {"kind": "csv-file", "url": "HOME/c/"}, typed(("c_custkey", "core_long"), ("c_nationkey", "core_long")), first=({"kind": "jvssql", "sql": "SELECT /*+ REPARTITION(3) */ c_custkey, c_nationkey FROM input"},))
round_trip("kv_round_trip", "orders", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", {"kind": "kvstore", "name": "k", "keyExpr": "o_custkey"}, {"kind": "kvstore", "name": "k"}, first=({"kind": "jvssql", "sql": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM input GROUP BY 1"},))
round_trip("kv_last_write_wins", "orders", "SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1", {"kind": "kvstore", "name": "k", "keyExpr": "o_custkey"}, {"kind": "kvstore", "name": "k"}, first=(p("o_custkey", "o_orderkey", "o_orderpriority"),), order="o_orderkey")
round_trip("csv_folder_round_trip", "orders", "SELECT o_orderkey::VARCHAR AS o_orderkey, 'no. ' || o_orderkey || ', \"' || o_orderpriority || '\"' AS note FROM orders", {"kind": "csv-file", "url": "HOME/c/", "cols": ["o_orderkey", "note"]}, {"kind": "csv-file", "url": "HOME/c/"}, first=({"kind": "jvssql", "sql": "SELECT /*+ REPARTITION(5) */ o_orderkey, concat('no. ', o_orderkey, ', \"', o_orderpriority, '\"') AS note FROM input"},))
round_trip("ndjson_typed", "customer", "SELECT c_custkey::INTEGER AS c_custkey, c_acctbal FROM customer", {"kind": "ndjson-file", "url": "HOME/j/"}, {"kind": "ndjson-file", "url": "HOME/j/", "schema": "c_custkey int, c_acctbal double"}, first=(p("c_custkey", "c_acctbal"),))
round_trip("index_search", "part", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_brand), '#'), 'brand') AND p_size = 7", {"kind": "lucene", "name": "i"}, {"kind": "lucene", "name": "i", "query": "+p_brand:brand +p_size:7"}, p("p_partkey"))


def sqlite_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sqlite3

    home = tempfile.mkdtemp(prefix="spillway-", dir=shared.removeprefix("file://") if (shared := spark.conf.get("spark.checkpoint.dir", None) or "").startswith(("/", "file:")) else None)
    with sqlite3.connect(f"{home}/a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, half REAL, raw BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, None if i % 5 == 0 else f"n{i}", i / 2, b"\x00\x01") for i in range(100)])
    job = spec.job_of({"job": "sqlite", "nodes": [node("n", {"kind": "sqlite", "path": f"{home}/a.db", "query": "SELECT * FROM t WHERE id >= ? AND name IS NOT ?", "params": [10, None]})]})
    return compile_job(job, spark)["n"]


QUERIES["sqlite_source"] = sqlite_source
ORACLE_SQL["sqlite_source"] = "SELECT i AS id, 'n' || i AS name, i / 2 AS half, 'AAE=' AS raw FROM range(10, 100) t(i) WHERE i % 5 <> 0"


def stream_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream reduced in micro-batches, from a checkpoint."""
    src = {"kind": "file-stream", "format": "parquet", "url": f"{sf_dir}/event[s].parquet", "schema": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"}
    return _run(spark, _home(spark), node("n", src, [f("value > 10")], agg(["event_type"], ("n", "COUNT"), ("m", "MAX", "value"))))


QUERIES["stream_reduce"] = stream_reduce
ORACLE_SQL["stream_reduce"] = "SELECT event_type, count(*) AS n, max(value) AS m FROM events WHERE value > 10 GROUP BY 1"


def kv_two_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the customers, then the other half and a few of the first again, changed."""
    home = _home(spark)
    sink = [{"kind": "kvstore", "name": "k", "keyExpr": "c_custkey"}]
    _run(spark, home, node("w", source("customer", sf_dir), [f("c_nationkey < 12"), p("c_custkey", "c_nationkey"), {"kind": "set-field", "name": "write", "value": 1}], sinks=sink))
    _run(spark, home, node("w", source("customer", sf_dir), [f("c_nationkey >= 10"), p("c_custkey", "c_nationkey"), {"kind": "set-field", "name": "write", "value": 2}], sinks=sink))
    return compile_job(spec.job_of({"job": "read", "nodes": [node("n", {"kind": "kvstore", "name": "k"})]}), spark, home)["n"]


QUERIES["kv_two_writes"] = kv_two_writes
ORACLE_SQL["kv_two_writes"] = "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey >= 10 THEN 2 ELSE 1 END AS write FROM customer"


def stream_two_batches_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of several batches into one file and into a keyed store: both hold the rows of all batches."""
    home = _home(spark)
    _run(spark, home, node("w", source("orders", sf_dir), [p("o_orderkey", "o_custkey"), {"kind": "jvssql", "sql": "SELECT /*+ REPARTITION(3) */ * FROM input"}], sinks=[{"kind": "ndjson-file", "url": f"{home}/in/"}]))
    src = {"kind": "file-stream", "format": "json", "url": f"{home}/in", "schema": "o_orderkey long, o_custkey long", "maxFilesPerTrigger": 1}
    _run(spark, home, node("s", src, [f("o_orderkey > 10")], sinks=[{"kind": "ndjson-file", "url": f"{home}/out.ndjson"}, {"kind": "kvstore", "name": "orders", "keyExpr": "o_orderkey"}]))
    nodes = [node("file", {"kind": "ndjson-file", "url": f"{home}/out.ndjson"}), node("stored", {"kind": "kvstore", "name": "orders"}), node("n", {"kind": "sql", "sql": "SELECT 'file' AS kept, o_orderkey, o_custkey FROM file UNION ALL SELECT 'store', o_orderkey, o_custkey FROM stored"}, depends=["file", "stored"])]
    return compile_job(spec.job_of({"job": "read", "nodes": nodes}), spark, home)["n"]


QUERIES["stream_two_batches_file"] = stream_two_batches_file
ORACLE_SQL["stream_two_batches_file"] = "SELECT kept, o_orderkey, o_custkey FROM orders, (VALUES ('file'), ('store')) v(kept) WHERE o_orderkey > 10"

# Typed steps: a declared transformation, texts in several languages.
GROOVY = {"kind": "jvs-groovy", "script": {"copy": {"id": "p_partkey"}, "set": {"brand": "lower(p_brand)"}, "mls": {"title": {"lang": "en", "text": "p_name"}}, "append": {"kinds": "p_type"}, "loop": {"words": {"over": "split(p_name, ' ')", "as": "w", "each": "upper(w)"}}, "times": {"squares": {"n": "p_size % 4", "as": "i", "each": "i * i"}}, "when": [{"if": "p_size >= 40", "set": {"size": "'large'"}}, {"if": "p_size >= 15", "set": {"size": "'middle'"}}], "where": "p_size > 3"}}
steps("typed_transform", "part", "SELECT p_partkey AS id, lower(p_brand) AS brand, p_name AS title, p_type AS kind, replace(upper(p_name), ' ', ';') AS words, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0;1' ELSE '0;1;4' END AS squares, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 15 THEN 'middle' END AS size FROM part WHERE p_size > 3", GROOVY, x(id="id", brand="brand", title="title.mls[0].text", kind="kinds[0]", words="array_join(words, ';')", squares="array_join(squares, ';')", size="size"))
steps("typed_enrich", "part", "SELECT p_partkey AS id, lower(p_name) AS clean, 2 AS sentences FROM part", {"kind": "jvs-groovy", "script": {"set": {"id": "p_partkey"}, "mls": {"title": {"text": "concat(p_name, '. ', upper(p_name), '!')"}}}}, {"kind": "jvs-enrich"}, x(id="id", clean="substring(title.mls[0].clean, 1, length(title.mls[0].clean) div 2)", sentences="size(title.mls[0].segmented)"))


def typed_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a translator that turns texts round."""
    from spillway.plugins import TRANSLATORS, register_translator

    if "turned" not in TRANSLATORS:
        register_translator("turned")(lambda texts, source, target: [f"{target}:{t[::-1]}" for t in texts])
    given = [{"kind": "jvs-groovy", "script": {"set": {"k": "n_nationkey"}, "mls": {"name": [{"lang": "en", "text": "n_name"}, {"lang": "nl", "text": "lower(n_name)"}]}}}, {"kind": "jvs-translate", "targetLangs": ["fr", "nl"], "sourceLang": "en", "model": "turned"}]
    return compile_job(spec.job_of({"job": "t", "nodes": [node("n", source("nation", sf_dir), [*given, x(k="k", n="size(name.mls)", fr="name.mls[2].text", nl="name.mls[1].text")])]}), spark)["n"]


QUERIES["typed_translate"] = typed_translate
ORACLE_SQL["typed_translate"] = "SELECT n_nationkey AS k, 3 AS n, 'fr:' || reverse(n_name) AS fr, lower(n_name) AS nl FROM nation"
round_trip("typed_index_search", "nation", "SELECT n_nationkey AS id FROM nation WHERE n_name IN ('FRANCE', 'PERU')", {"kind": "jvs-lucene", "name": "i"}, {"kind": "lucene", "name": "i", "query": "title.en:france title.en:peru"}, p("id"), first=({"kind": "jvs-groovy", "script": {"copy": {"id": "n_nationkey"}, "mls": {"title": {"text": "n_name"}}}},))


def bundled(name: str, table: str, sql: str | None, columns: str, before: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _home(spark))
        for job in (*before, name):
            done = engine.run_bundled(job)
            if done.status.state != "SUCCEEDED":
                raise RuntimeError(done.status.error)
        return done.table(table).select(*(F.expr(c.strip()) for c in columns.split(",")))

    QUERIES[f"bundled_{name.replace('-', '_')}"] = run
    if sql:
        ORACLE_SQL[f"bundled_{name.replace('-', '_')}"] = sql


bundled("harbour-rollup", "zone-summary", "SELECT * FROM (VALUES ('North Sea', 4, 24.0::DOUBLE), ('Mediterranean', 3, 18.0::DOUBLE), ('Baltic', 1, 17.0::DOUBLE), ('<null>', 2, 15.0::DOUBLE)) t(zone, n, deepest)", "zone, n, deepest")
bundled("harbour-classes", "harbour-classes", "SELECT * FROM (VALUES ('RTM', 'deep'), ('PIR', 'deep'), ('TRS', 'deep'), ('HAM', 'middle'), ('ANR', 'middle'), ('GDN', 'middle'), ('VLC', 'middle'), ('LEH', 'middle'), ('ODS', 'shallow'), ('OSL', 'shallow')) t(code, class)", "code, class")
bundled("store-and-search", "harbour-notes", "SELECT * FROM (VALUES ('n1'), ('n3')) t(id)", "id")
bundled("diamond", "heavy-loads", "SELECT * FROM (VALUES ('RTM', 40, 50.0::DOUBLE), ('HAM', 25, 25.0::DOUBLE)) t(port, tons, total)", "port, tons, total")
bundled("berth-plan", "quay-plan", "SELECT * FROM (VALUES ('Q1', 2, 10.0::DOUBLE, 6.0::DOUBLE), ('Q2', 2, 21.0::DOUBLE, 12.0::DOUBLE), ('Q3', 1, 5.0::DOUBLE, 5.0::DOUBLE), ('<null>', 1, 20.0::DOUBLE, 20.0::DOUBLE)) t(quay, ships, hours, longest)", "quay, ships, hours, longest")
bundled("cargo-by-kind", "cargo", "SELECT * FROM (VALUES ('grain', 42.0::DOUBLE, 2.0::DOUBLE), ('ore', 135.0::DOUBLE, 3.0::DOUBLE), ('timber', 32.0::DOUBLE, 2.0::DOUBLE)) t(kind, tons, loads)", "kind, tons, loads")
bundled("harbour-store-read", "deep-harbours", "SELECT * FROM (VALUES ('RTM', 24), ('PIR', 18), ('TRS', 18), ('GOT', 19)) t(code, depth_m)", "code, depth_m", before=("harbour-store",))
bundled("harbour-three-sinks", "deep-water", "SELECT * FROM (VALUES ('RTM'), ('HAM')) t(code)", "code")
bundled("harbour-news", "news", "SELECT * FROM (VALUES ('h1', 'NL', true, 'storm quay closed', 2, 2), ('h2', 'DE', false, 'new pilot boat it is fast', 2, 1)) t(id, country, urgent, clean, sentences, tags)", "id, country, urgent, title.mls[0].clean AS clean, size(title.mls[0].segmented) AS sentences, size(tags) AS tags")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items above 30 pieces, summed up by return flag."""
    by = agg(["l_returnflag"], ("n", "COUNT"), ("quantity", "SUM", "l_quantity"), ("price", "MAX", "l_extendedprice"))
    job = spec.job_of({"job": "flagship", "nodes": [node("big", source("lineitem", sf_dir), [f("l_quantity > 30"), p("l_returnflag", "l_quantity", "l_extendedprice")]), node("by-flag", "big", None, by)]})
    return compile_job(job, spark)["by-flag"]


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity > 30 GROUP BY 1"

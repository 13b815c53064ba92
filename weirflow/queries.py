"""The registered queries, one or more per operator, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import checkpoint, oplog, reports
from weirflow.operators.evaluate import bucket_rows, lookup_rows, resolve_buckets, source_rows
from weirflow.plans.compile import compile_stream
from weirflow.plans.config import load
from weirflow.plans.model import Plan
from weirflow.sources import sinks
from weirflow.sources.shared import written
from weirflow.sources.tables import parquet_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str, sql: str, *names: str, extra: dict[str, DataFrame] | None = None, name: str = "s", **options) -> DataFrame:
    """The rows of a stream of one query and one bucket."""
    s = compile_stream(name, [sql], **options)
    tables = parquet_tables(spark, sf_dir, *names) | (extra or {})
    return source_rows(s, s.buckets[0], s.buckets[0].evaluators[0], tables)


def _requests(df: DataFrame, request_id, auth, connection=None, subscription=None, stream=None) -> DataFrame:
    """One request per row of a table."""
    text = lambda c: F.to_json(F.struct(*c)) if c else F.lit("{}")
    return df.select(request_id.cast("string").alias("request_id"), text(auth).alias("auth"), text(connection).alias("connection"), text(subscription).alias("subscription"), F.lit(stream).cast("string").alias("stream"), F.lit(None).cast("int").alias("priority"))


def _resolved(spark: SparkSession, tables: dict[str, DataFrame], queries: list[str], requests: DataFrame, name: str = "s", **options) -> DataFrame:
    plan = Plan(3, [compile_stream(name, queries, auto_subscribe=True, **options)])
    return resolve_buckets(plan, tables, requests).select("request_id", "bucket", F.col("priority").cast("bigint").alias("priority"))


# --- rows


@register("SELECT 'orders_by_customer|0[' || o_custkey || ']' AS bucket, 'orders' AS object_type, CAST(o_orderkey AS VARCHAR) AS object_id, o_orderkey AS id, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL")
def q1_orders_by_customer(spark, sf_dir):
    return _rows(spark, sf_dir, "SELECT o_orderkey AS id, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey = auth.parameter('custkey')", "orders", name="orders_by_customer")


@register("SELECT 's|0[]' AS bucket, 'orders_' || o_orderstatus AS object_type, CAST(o_orderkey AS VARCHAR) AS object_id, o_orderkey AS id, o_orderstatus AS suffix, 'orders_' || o_orderstatus AS name, 'public' AS sch, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def q2_wildcard_tables(spark, sf_dir):
    orders = parquet_tables(spark, sf_dir, "orders")["orders"]
    parts = {f"orders_{k}": orders.filter(F.col("o_orderstatus") == k) for k in "FOP"} | {"other": orders}
    s = compile_stream("s", ["""SELECT o_orderkey AS id, "orders_%".table_suffix() AS suffix, "orders_%".table_name() AS name, "orders_%".schema() AS sch, o_totalprice FROM "orders_%" """])
    return source_rows(s, s.buckets[0], s.buckets[0].evaluators[0], parts)


@register("SELECT 's|0[]' AS bucket, 'parts' AS object_type, CAST(p_partkey AS VARCHAR) AS object_id, p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_partkey AS id FROM part")
def q3_star_and_rename(spark, sf_dir):
    part = parquet_tables(spark, sf_dir, "part")["part"].withColumn("raw", F.col("p_name").cast("binary"))
    s = compile_stream("s", ["SELECT *, p_partkey AS id FROM part AS parts"])
    return source_rows(s, s.buckets[0], s.buckets[0].evaluators[0], {"part": part})


def _nullable(spark, sf_dir) -> DataFrame:
    e = parquet_tables(spark, sf_dir, "events")["events"]
    return e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2).alias("a"), F.when(F.col("event_id") % 5 != 0, F.concat(F.col("event_id") % 2, F.lit("x"))).alias("t"), "event_type", "value")


_N = "(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 END AS a, CASE WHEN event_id % 5 <> 0 THEN (event_id % 2) || 'x' END AS t, event_type, value FROM events)"


@register(f"""SELECT event_id AS id, CAST(coalesce(a, 0) = 0 AS BIGINT) AS not_a, CAST(coalesce(a, 0) <> 0 AND coalesce(t, '0x') = '1x' AS BIGINT) AS both_, CAST(coalesce(a, 0) <> 0 OR coalesce(t, '0x') = '1x' AS BIGINT) AS either,
  CAST(a IS NULL AS BIGINT) AS a_null, CAST(coalesce(a = 1, false) AS BIGINT) AS a_is_one, CAST(coalesce(a <> 0, false) AS BIGINT) AS a_true, CASE WHEN a IS NULL THEN NULL ELSE 0 END AS mixed FROM {_N}""")
def q4_truth(spark, sf_dir):
    sql = "SELECT event_id AS id, NOT a AS not_a, a AND t AS both_, a OR t AS either, a IS NULL AS a_null, a IS 1 AS a_is_one, a IS TRUE AS a_true, a = '1' AS mixed FROM n"
    return _rows(spark, sf_dir, sql, extra={"n": _nullable(spark, sf_dir)}).drop("bucket", "object_type", "object_id")


@register(f"""SELECT event_id AS id, event_id + 2 AS plus, event_id * 3 - 1 AS times, event_id // 7 AS whole, event_id / 4.0 AS part, a + 1 AS with_null, CASE WHEN a <> 0 THEN event_id // a END AS by_a, value * 2.0 AS twice,
  event_type || ':' || event_id AS label, CASE WHEN event_type IS NULL THEN NULL ELSE event_id + 12 END AS prefix FROM {_N}""")
def q5_arithmetic(spark, sf_dir):
    sql = "SELECT event_id AS id, event_id + 2 AS plus, event_id * 3 - 1 AS times, event_id / 7 AS whole, event_id / 4.0 AS part, a + 1 AS with_null, event_id / a AS by_a, value * 2 AS twice, event_type || ':' || event_id AS label, event_id + CAST('12 apples' AS integer) AS prefix FROM n"
    return _rows(spark, sf_dir, sql, extra={"n": _nullable(spark, sf_dir)}).drop("bucket", "object_type", "object_id")


@register("SELECT event_id AS id, event_id & 12 AS b_and, event_id | 3 AS b_or, event_id << 2 AS l, event_id >> 1 AS r, event_id % 7 AS m FROM events")
def q6_bit_operators(spark, sf_dir):
    sql = "SELECT event_id AS id, event_id & 12 AS b_and, event_id | 3 AS b_or, event_id << 2 AS l, event_id >> 1 AS r, event_id % 7 AS m FROM events"
    return _rows(spark, sf_dir, sql, "events", semantics="sqlite").drop("bucket", "object_type", "object_id")


@register("SELECT 's|0[]' AS bucket, 'lineitem' AS object_type, CAST(l_orderkey AS VARCHAR) AS object_id, l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'N') AND NOT (l_discount BETWEEN 0.02 AND 0.04)")
def q7_between_and_lists(spark, sf_dir):
    return _rows(spark, sf_dir, "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ARRAY['A', 'N'] AND l_discount NOT BETWEEN 0.02 AND 0.04", "lineitem")


def _tagged(spark, sf_dir) -> DataFrame:
    e = parquet_tables(spark, sf_dir, "events")["events"]
    return e.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set("event_type"))).alias("tags"), F.to_json(F.sort_array(F.collect_set(F.col("event_id") % 10))).alias("digits"))


_TAGGED = "SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags, list_sort(list(DISTINCT event_id % 10)) AS digits FROM events GROUP BY user_id"


@register(f"""SELECT user_id AS id, CAST(list_contains(tags, 'click') AS BIGINT) AS has_click, CAST(NOT list_contains(tags, 'view') AS BIGINT) AS no_view, CAST(list_contains(digits, 3) AS BIGINT) AS has_3, 0 :: BIGINT AS text_3,
  CAST(list_has_any(tags, ['error', 'none']) AS BIGINT) AS overlap, CAST(len(tags) AS BIGINT) AS n FROM ({_TAGGED})""")
def q8_json_membership(spark, sf_dir):
    sql = """SELECT user_id AS id, 'click' IN tags AS has_click, 'view' NOT IN tags AS no_view, 3 IN digits AS has_3, '3' IN digits AS text_3, tags && '["error","none"]' AS overlap, json_array_length(tags) AS n FROM u"""
    return _rows(spark, sf_dir, sql, extra={"u": _tagged(spark, sf_dir)}).drop("bucket", "object_type", "object_id")


@register(f"""SELECT event_id AS id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END :: BIGINT AS code, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' END AS band, coalesce(t, 'none') AS t, CASE WHEN coalesce(a, 0) <> 0 THEN 'odd' ELSE 'other' END AS parity FROM {_N}""")
def q9_conditionals(spark, sf_dir):
    sql = "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' END AS band, ifnull(t, 'none') AS t, iif(a, 'odd', 'other') AS parity FROM n"
    return _rows(spark, sf_dir, sql, extra={"n": _nullable(spark, sf_dir)}).drop("bucket", "object_type", "object_id")


@register("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.k') AS j, 'integer' AS kind, CAST(NULL AS VARCHAR) AS missing, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events")
def q10_json_access(spark, sf_dir):
    sql = "SELECT event_id AS id, props ->> '$.k' AS k, props -> 'k' AS j, typeof(json_extract(props, '$.k')) AS kind, props ->> '$.none.x' AS missing, CAST(props ->> 'k' AS integer) + 1 AS k1 FROM events"
    return _rows(spark, sf_dir, sql, "events").drop("bucket", "object_type", "object_id")


@register("SELECT p_partkey AS id, upper(p_name) AS u, lower(p_brand) AS l, substr(p_name, 2, 3) AS s, right(p_name, 2) AS tail, length(p_name) AS n, CAST(instr(p_name, 'e') AS BIGINT) AS at, substr(p_name, 1, 1) AS zero FROM part")
def q11_text_functions(spark, sf_dir):
    sql = "SELECT p_partkey AS id, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 2, 3) AS s, substring(p_name, -2) AS tail, length(p_name) AS n, instr(p_name, 'e') AS at, substring(p_name FROM 0 FOR 2) AS zero FROM part"
    return _rows(spark, sf_dir, sql, "part").drop("bucket", "object_type", "object_id")


_UUID = "lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '-e29b-41d4-a716-' || lpad(CAST(p_size AS VARCHAR), 12, 'aF')"


@register(f"SELECT p_partkey AS id, hex(p_name) AS h, base64(encode(p_name)) AS b, upper(replace({_UUID}, '-', '')) AS u, '' AS none FROM part")
def q12_encodings(spark, sf_dir):
    part = parquet_tables(spark, sf_dir, "part")["part"]
    uuid = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-e29b-41d4-a716-"), F.lpad(F.col("p_size").cast("string"), 12, "aF"))
    sql = "SELECT p_partkey AS id, hex(p_name) AS h, base64(p_name) AS b, hex(uuid_blob(u)) AS u, hex(NULL) AS none FROM p"
    return _rows(spark, sf_dir, sql, extra={"p": part.withColumn("u", uuid)}).drop("bucket", "object_type", "object_id")


@register(f"""SELECT 's|0["' || tag || '"]' AS bucket, 'u' AS object_type, CAST(user_id AS VARCHAR) AS object_id, user_id AS id, CAST(len(tags) AS BIGINT) AS n, '["k"]' AS keys FROM ({_TAGGED}), unnest(tags) AS x(tag)""")
def q13_json_each(spark, sf_dir):
    sql = """SELECT u.user_id AS id, json_array_length(u.tags) AS n, json_keys('{"k": 1}') AS keys FROM u, json_each(u.tags) AS t WHERE t.value = auth.parameter('tag')"""
    return _rows(spark, sf_dir, sql, extra={"u": _tagged(spark, sf_dir)})


@register("SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, CAST(epoch(o_orderdate) AS BIGINT) AS again FROM orders")
def q14_dates(spark, sf_dir):
    return _rows(spark, sf_dir, "SELECT o_orderkey AS id, unixepoch(o_orderdate) AS seconds, datetime(o_orderdate) AS at, unixepoch(unixepoch(o_orderdate), 'unixepoch') AS again FROM orders", "orders").drop("bucket", "object_type", "object_id")


@register("""SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS brand, CAST(p_partkey AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS r, CAST(floor(p_retailprice) AS BIGINT) AS i,
  CAST(0 AS BIGINT) AS none, p_partkey || 'x' AS numbered, 'real' AS kind, hex(CAST(p_partkey AS VARCHAR)) AS b FROM part""")
def q15_casts(spark, sf_dir):
    sql = "SELECT p_partkey AS id, CAST(substring(p_brand, 7) || 'abc' AS integer) AS brand, CAST(p_partkey AS text) AS t, CAST(p_size AS real) AS r, p_retailprice::integer AS i, CAST(p_name AS integer) AS none, p_partkey || 'x' AS numbered, typeof(CAST(p_size || '.5e1z' AS numeric)) AS kind, hex(CAST(p_partkey AS blob)) AS b FROM part"
    return _rows(spark, sf_dir, sql, "part").drop("bucket", "object_type", "object_id")


def _double_hex(x):
    """A double's eight bytes, the lowest first, as hex digits; for numbers of few binary digits."""
    a = F.abs(x)
    e = F.floor(F.log2(F.when(a > 0, a).otherwise(1.0)))
    mantissa = F.when(a > 0, ((a / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    top = F.when(a > 0, (e + 1023).cast("bigint")).otherwise(F.lit(0).cast("bigint")) + F.when(x < 0, 2048).otherwise(0)
    h = F.concat(F.lpad(F.hex(top), 3, "0"), F.lpad(F.hex(mantissa), 13, "0"))
    return F.concat(*[F.substring(h, k, 2) for k in range(15, 0, -2)])


@register("""SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) AS x, s_nationkey - 10.5 :: DOUBLE AS y, 'POINT(' || s_suppkey || ' ' || CAST(s_nationkey - 10.5 :: DOUBLE AS VARCHAR) || ')' AS wkt,
  '{"type":"Point","coordinates":[' || s_suppkey || ',' || CAST(s_nationkey - 10.5 :: DOUBLE AS VARCHAR) || ']}' AS geojson, CAST(NULL AS DOUBLE) AS none FROM supplier""")
def q16_geometry(spark, sf_dir):
    """Points of two coordinates, in the binary form that databases send, one per supplier."""
    s = parquet_tables(spark, sf_dir, "supplier")["supplier"]
    line = "010200000002000000000000000000000000000000000000000000000000000840000000000000F03F"
    points = s.select("s_suppkey", F.concat(F.lit("0101000000"), _double_hex(F.col("s_suppkey").cast("double")), _double_hex(F.col("s_nationkey").cast("double") - 10.5)).alias("p"))
    sql = f"SELECT s_suppkey AS id, st_x(p) AS x, st_y(p) AS y, st_astext(p) AS wkt, st_asgeojson(p) AS geojson, st_x('{line}') AS none FROM s"
    return _rows(spark, sf_dir, sql, extra={"s": points}).drop("bucket", "object_type", "object_id")


# --- requests


@register("""SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS request_id, 's|0[' || c_custkey || ']' AS bucket, CAST(3 AS BIGINT) AS priority FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def q17_one_lookup(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "orders", "customer", "nation")
    r = _requests(t["nation"], F.col("n_nationkey"), [F.col("n_nationkey").alias("nation")])
    return _resolved(spark, t, ["SELECT o.o_orderkey AS id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = auth.parameter('nation')"], r)


@register("""SELECT DISTINCT CAST(r_regionkey AS VARCHAR) AS request_id, 's|0[' || o_orderkey || ']' AS bucket, CAST(3 AS BIGINT) AS priority FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def q18_lookup_chain(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    r = _requests(t["region"], F.col("r_regionkey"), [F.col("r_regionkey").alias("region")])
    sql = "SELECT l.l_orderkey AS id FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = auth.parameter('region') AND o.o_orderstatus = 'P'"
    return _resolved(spark, t, [sql], r)


@register("""SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS request_id, 's|0[' || s_nationkey || ',' || s_suppkey || ']' AS bucket, CAST(3 AS BIGINT) AS priority FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def q19_composite_key(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "supplier", "nation")
    t["grants"] = t["supplier"].select(F.col("s_suppkey").alias("g_supp"), F.col("s_nationkey").alias("g_nation"))
    r = _requests(t["nation"], F.col("n_nationkey"), [F.col("n_nationkey").alias("sub")])
    return _resolved(spark, t, ["SELECT s.s_suppkey AS id FROM supplier s, grants g WHERE s.s_suppkey = g.g_supp AND s.s_nationkey = g.g_nation AND g.g_nation = auth.user_id()"], r)


@register("""SELECT DISTINCT CAST(a.c_custkey AS VARCHAR) AS request_id, 's|0[' || a.c_custkey || ']' AS bucket, CAST(3 AS BIGINT) AS priority FROM customer a JOIN orders ON o_custkey = a.c_custkey WHERE o_orderstatus = 'O'""")
def q20_intersection(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "orders", "customer")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")])
    return _resolved(spark, t, ["SELECT c.c_custkey AS id FROM customer c, orders o WHERE c.c_custkey = auth.user_id() AND c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O'"], r)


@register("""SELECT CAST(n_nationkey AS VARCHAR) AS request_id, 's|0[' || n_nationkey || ']' AS bucket, CAST(3 AS BIGINT) AS priority FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def q21_semi_joins(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "customer", "supplier", "nation")
    r = _requests(t["nation"], F.col("n_nationkey"), [F.col("n_nationkey").alias("nation")])
    sql = "SELECT c_custkey AS id FROM customer WHERE c_nationkey = auth.parameter('nation') AND auth.parameter('nation') IN (SELECT s_nationkey FROM supplier) AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')"
    return _resolved(spark, t, [sql], r)


@register(f"""SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS request_id, 's|0["' || tag || '"]' AS bucket, CAST(3 AS BIGINT) AS priority FROM nation, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['click', 'view'] ELSE ['error'] END) AS x(tag)""")
def q22_json_requests(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "nation") | {"u": _tagged(spark, sf_dir)}
    wanted = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("click"), F.lit("view"))).otherwise(F.array(F.lit("error")))
    r = _requests(t["nation"], F.col("n_nationkey"), [F.col("n_nationkey").alias("sub")], connection=[wanted.alias("tags")])
    return _resolved(spark, t, ["SELECT u.user_id AS id FROM u, json_each(u.tags) AS t, json_each(connection.parameter('tags')) AS w WHERE t.value = w.value"], r)


@register("""SELECT bucket, object_type, object_id FROM (
  SELECT 's|0[' || c_nationkey || ']' AS bucket, 'customer' AS object_type, CAST(c_custkey AS VARCHAR) AS object_id FROM customer
  UNION ALL SELECT 's|1[' || c_custkey || ']', 'customer', CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 's|0[' || s_nationkey || ']', 's', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)""")
def q23_unions_and_ctes(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "customer", "supplier", "nation")
    queries = [
        "SELECT c_custkey AS id FROM customer WHERE c_nationkey IN mine OR c_custkey = auth.user_id()",
        "SELECT s.s_suppkey AS id FROM supplier s, (SELECT n_nationkey, n_regionkey FROM nation) AS x(key, region) WHERE s.s_nationkey = x.key AND x.region = auth.parameter('region') AND s.s_acctbal > 0",
    ]
    s = compile_stream("s", queries, {"mine": "SELECT n_nationkey FROM nation WHERE n_regionkey = auth.parameter('region')"})
    return bucket_rows(Plan(3, [s]), t).drop("data")


@register("""SELECT request_id, bucket, min(priority) AS priority, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'mine|0[' || c_custkey || ']' AS bucket, 1 :: BIGINT AS priority, 'mine' AS reason FROM customer
  UNION ALL SELECT DISTINCT CAST(a.c_custkey AS VARCHAR), 'near|0[' || b.s_suppkey || ']', 2, 'near' FROM customer a JOIN nation ON n_nationkey = a.c_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey) GROUP BY request_id, bucket""")
def q24_request_resolution(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "orders", "customer", "nation", "supplier")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub"), F.col("c_nationkey").alias("nation")])
    mine = compile_stream("mine", ["SELECT o_orderkey AS id FROM orders WHERE o_custkey = auth.user_id()"], auto_subscribe=True, priority=1)
    near = compile_stream("near", ["SELECT s.s_suppkey AS id FROM supplier s, supplier s2, nation n WHERE s.s_suppkey = s2.s_suppkey AND s2.s_nationkey = n.n_nationkey AND n.n_nationkey = auth.parameter('nation')"], auto_subscribe=True, priority=2)
    out = resolve_buckets(Plan(3, [mine, near]), t, r)
    return out.select("request_id", "bucket", F.col("priority").cast("bigint").alias("priority"), F.array_join("reasons", ",").alias("reasons"))


@register("""SELECT 'near|0|0|0' AS lookup, '[' || s_nationkey || ']' AS key, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey""")
def q24b_lookup_rows(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "supplier")
    near = compile_stream("near", ["SELECT s.s_suppkey AS id FROM supplier s, supplier s2 WHERE s.s_suppkey = s2.s_suppkey AND s2.s_nationkey = auth.parameter('nation')"])
    return lookup_rows(Plan(3, [near]), t).groupBy("lookup", "key").agg(F.count("*").alias("n"))


# --- logs

_LOGS: dict[tuple[str, str], DataFrame] = {}
GONE = "error"


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a change of its user's row, which is in the bucket of its type; one type deletes it."""
    e = parquet_tables(spark, sf_dir, "events")["events"]
    in_one = F.array(F.struct(F.col("event_type").alias("bucket"), F.concat(F.lit('{"v":'), F.col("event_id"), F.lit("}")).alias("data")))
    return e.select(
        F.lit("users").alias("object_type"), F.col("user_id").cast("string").alias("object_id"), oplog.subkey_of(F.lit("users"), F.col("user_id").cast("string")).alias("subkey"),
        F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 15, "0")).alias("seq"),
        F.when(F.col("event_type") != GONE, in_one).otherwise(F.expr("cast(array() as array<struct<bucket:string,data:string>>)")).alias("buckets"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all events, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOGS:
        _LOGS[key] = written(oplog.changes_to_ops(event_states(spark, sf_dir)), "log")
    return _LOGS[key]


def _h(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 7, 2) || substr(sha256({text}), 5, 2) || substr(sha256({text}), 3, 2) || substr(sha256({text}), 1, 2) AS BIGINT)"


def _wrap(total: str) -> str:
    return f"CAST(((CAST({total} AS HUGEINT) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 AS BIGINT)"


_OPS = f"""st AS (SELECT *, CASE WHEN event_type <> '{GONE}' THEN event_type END AS b, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
h AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY seq) AS pb FROM st),
o AS (SELECT seq, 0 AS kind, b AS bucket, 'PUT' AS op, user_id, '{{"v":' || event_id || '}}' AS data FROM h WHERE b IS NOT NULL
  UNION ALL SELECT seq, 1, pb, 'REMOVE', user_id, NULL FROM h WHERE pb IS NOT NULL AND pb IS DISTINCT FROM b),
log AS (SELECT row_number() OVER (ORDER BY seq, kind, bucket) AS op_id, bucket, op, 'users' AS object_type, CAST(user_id AS VARCHAR) AS object_id, 'users/' || user_id AS subkey, data,
  CASE WHEN op = 'PUT' THEN {_h("'put.users.' || user_id || '.' || data")} ELSE {_h("'delete.users/' || user_id")} END AS checksum, CAST(NULL AS BIGINT) AS target_op FROM o)"""


def _compaction(log: str, last: str = "") -> str:
    """CTEs moved and compacted of a log; ``last``: appended to their names."""
    return f"""moved{last} AS (SELECT op_id, bucket, checksum, CASE WHEN n > op_id THEN 'MOVE' ELSE op END AS op, CASE WHEN n > op_id THEN NULL ELSE object_id END AS object_id, CASE WHEN n > op_id THEN NULL ELSE data END AS data, CASE WHEN n > op_id THEN n END AS target_op
  FROM (SELECT *, max(op_id) OVER (PARTITION BY bucket, subkey) AS n FROM {log})),
pre{last} AS (SELECT *, min(CASE WHEN op = 'PUT' THEN op_id END) OVER (PARTITION BY bucket) AS p FROM moved{last}),
cut{last} AS (SELECT *, p IS NULL OR op_id < p AS inside, sum(CASE WHEN (p IS NULL OR op_id < p) AND op <> 'CLEAR' THEN 1 ELSE 0 END) OVER (PARTITION BY bucket) AS k FROM pre{last}),
compacted{last} AS (SELECT bucket, op_id, op, object_id, data, checksum, target_op FROM cut{last} WHERE NOT (inside AND k > 1)
  UNION ALL SELECT bucket, max(op_id), 'CLEAR', NULL, NULL, {_wrap("sum(checksum)")}, max(target_op) FROM cut{last} WHERE inside AND k > 1 GROUP BY bucket)"""


_LOG = f"{_OPS},\n{_compaction('log')}"
#: The log with a bucket for each user.
_USERS = f"{_OPS}, ulog AS (SELECT op_id, object_id AS bucket, op, object_type, object_id, subkey, data, checksum, target_op FROM log)"
#: Checkpoints are shares of the last op, or of the last event.
_MID, _MID_EVENT = "(SELECT max(op_id) // 2 FROM log)", "(SELECT max(event_id) // 2 FROM events)"


def _middle(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0] // 2


def _user_log(spark, sf_dir) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("bucket", F.col("object_id"))


@register(f"WITH {_LOG} SELECT op, object_id, data, checksum FROM log")
def q25_hashes(spark, sf_dir):
    return event_log(spark, sf_dir).select("op", "object_id", "data", "checksum")


@register(f"WITH {_LOG} SELECT bucket, {_wrap('sum(checksum)')} AS checksum, count(*) AS n_ops, false AS cleared FROM log GROUP BY bucket")
def q26_checksums(spark, sf_dir):
    return checkpoint.checksums(event_log(spark, sf_dir))


@register(f"""WITH {_USERS}, {_compaction("ulog", "_u")}, a AS (SELECT bucket, sum(checksum) AS s, count(*) AS n FROM ulog WHERE op_id <= {_MID} GROUP BY 1),
b AS (SELECT bucket, sum(checksum) AS s, count(*) AS n, bool_or(op = 'CLEAR') AS c FROM compacted_u WHERE op_id > {_MID} GROUP BY 1)
SELECT coalesce(a.bucket, b.bucket) AS bucket, {_wrap("(CASE WHEN c THEN 0 ELSE coalesce(a.s, 0) END + coalesce(b.s, 0))")} AS checksum, CAST(CASE WHEN c THEN 0 ELSE coalesce(a.n, 0) END + coalesce(b.n, 0) AS BIGINT) AS n_ops, coalesce(c, false) AS cleared FROM a FULL JOIN b ON a.bucket = b.bucket""")
def q27_incremental_checksums(spark, sf_dir):
    """A checksum stored before a compaction, and what the compacted log has since: a CLEAR makes the stored one void."""
    log = _user_log(spark, sf_dir)
    mid = _middle(log, "op_id")
    return checkpoint.add_checksums(checkpoint.checksums(log, upto=mid), checkpoint.checksums(oplog.compact(log), after=mid))


@register(f"""SELECT lookup, source_key, id, CAST(1 AS BIGINT) AS n FROM (SELECT user_id % 10 || '' AS lookup, CAST(user_id AS VARCHAR) AS source_key, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= {_MID_EVENT}) WHERE rn = 1 AND event_type <> '{GONE}'""")
def q28_latest_lookups(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return oplog.latest_lookups(entries, _middle(entries, "id")).select("lookup", "source_key", "id", F.size("outputs").cast("bigint").alias("n"))


def _entries(spark, sf_dir) -> DataFrame:
    e = parquet_tables(spark, sf_dir, "events")["events"]
    return e.select((F.col("user_id") % 10).cast("string").alias("lookup"), F.col("user_id").cast("string").alias("source_key"), F.col("event_id").alias("id"), F.when(F.col("event_type") != GONE, F.array("event_type")).otherwise(F.expr("cast(array() as array<string>)")).alias("outputs"))


@register(f"WITH {_LOG} SELECT op_id, bucket, op, object_type, object_id, subkey, data, checksum FROM log")
def q29_change_apply(spark, sf_dir):
    # built anew, not the log that other queries share
    return oplog.changes_to_ops(event_states(spark, sf_dir)).select("op_id", "bucket", "op", "object_type", "object_id", "subkey", "data", "checksum")


@register("SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 2 = 1 THEN 'new' WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice AS price, o_orderkey % 2 = 1 OR o_orderstatus <> 'P' AS complete FROM orders")
def q30_unchanged_columns(spark, sf_dir):
    """Half of the changes didn't send the status; where there is no stored row either, it is missing and the row incomplete."""
    o = parquet_tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changes = o.select("id", "cust", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise("new").alias("status"), "price", F.when(F.col("id") % 2 == 0, F.array(F.lit("status"))).otherwise(F.expr("cast(array() as array<string>)")).alias("unchanged"))
    state = o.filter((F.col("status") != "P") | (F.col("id") % 2 == 1))
    return oplog.merge_unchanged(changes, state, "id", ["cust", "status", "price"])


@register(f"SELECT 'c' || c_nationkey AS bucket, 'REMOVE' AS op, 'customer' AS object_type, CAST(c_custkey AS VARCHAR) AS object_id, 'customer/' || c_custkey AS subkey, CAST(NULL AS VARCHAR) AS data, {_h(chr(39) + 'delete.customer/' + chr(39) + ' || c_custkey')} AS checksum FROM customer")
def q31_truncate(spark, sf_dir):
    c = parquet_tables(spark, sf_dir, "customer")["customer"]
    current = c.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("bucket"), F.lit("customer").alias("object_type"), F.col("c_custkey").cast("string").alias("object_id"), oplog.subkey_of(F.lit("customer"), F.col("c_custkey").cast("string")).alias("subkey"))
    return oplog.truncate_ops(current)


@register(f"WITH {_LOG} SELECT op_id, bucket, op, object_id, data, checksum, target_op FROM moved")
def q32_compact_moves(spark, sf_dir):
    return oplog.compact_moves(event_log(spark, sf_dir)).select("op_id", "bucket", "op", "object_id", "data", "checksum", "target_op")


@register(f"WITH {_LOG} SELECT op_id, bucket, op, object_id, data, checksum, target_op FROM compacted")
def q33_compact_clear(spark, sf_dir):
    return oplog.compact(event_log(spark, sf_dir)).select("op_id", "bucket", "op", "object_id", "data", "checksum", "target_op")


@register(f"""WITH {_LOG}, last AS (SELECT *, op = 'PUT' AND op_id = max(op_id) OVER (PARTITION BY bucket, subkey) AS kept FROM log)
SELECT bucket, op_id, op, object_id, data, checksum FROM last WHERE kept UNION ALL SELECT bucket, 0, 'CLEAR', NULL, NULL, {_wrap('sum(CASE WHEN kept THEN 0 ELSE checksum END)')} FROM last GROUP BY bucket""")
def q34_reduce(spark, sf_dir):
    return oplog.reduce_log(event_log(spark, sf_dir)).select("bucket", "op_id", "op", "object_id", "data", "checksum")


@register(f"WITH {_LOG} SELECT bucket, max(target_op) AS target_op FROM moved WHERE op_id <= {_MID} GROUP BY bucket HAVING max(target_op) > {_MID}")
def q35_invalidated(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return checkpoint.invalidated(oplog.compact_moves(log), _middle(log, "op_id"))


@register(f"""SELECT lookup, source_key, id FROM (SELECT user_id % 10 || '' AS lookup, CAST(user_id AS VARCHAR) AS source_key, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> '{GONE}'""")
def q36_compact_parameters(spark, sf_dir):
    return oplog.compact_parameters(_entries(spark, sf_dir)).select("lookup", "source_key", "id")


@register(f"""WITH {_USERS}, a AS (SELECT bucket, {_wrap('sum(checksum)')} AS checksum, count(*) AS n_ops FROM ulog WHERE op_id <= {_MID} GROUP BY 1), b AS (SELECT bucket, {_wrap('sum(checksum)')} AS checksum, count(*) AS n_ops FROM ulog WHERE op_id <= {_MID} + {_MID} // 50 AND bucket <> '7' GROUP BY 1)
SELECT coalesce(a.bucket, b.bucket) AS bucket, CASE WHEN b.bucket IS NULL THEN 'removed' WHEN a.bucket IS NULL THEN 'added' WHEN a.checksum = b.checksum AND a.n_ops = b.n_ops THEN 'unchanged' ELSE 'changed' END AS status, b.checksum, b.n_ops FROM a FULL JOIN b ON a.bucket = b.bucket""")
def q37_checkpoint_diff(spark, sf_dir):
    log = _user_log(spark, sf_dir)
    mid = _middle(log, "op_id")
    return checkpoint.checkpoint_diff(checkpoint.checksums(log, upto=mid), checkpoint.checksums(log.filter("bucket != '7'"), upto=mid + mid // 50))


@register(f"WITH {_USERS} SELECT CAST(c_custkey AS VARCHAR) AS request_id, CAST(c_custkey AS VARCHAR) AS bucket FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT bucket FROM ulog WHERE op_id > {_MID} AND op_id <= {_MID} + {_MID} // 50)")
def q38_changed_subscriptions(spark, sf_dir):
    log = _user_log(spark, sf_dir)
    mid = _middle(log, "op_id")
    resolved = parquet_tables(spark, sf_dir, "customer")["customer"].select(F.col("c_custkey").cast("string").alias("request_id"), F.col("c_custkey").cast("string").alias("bucket"))
    return checkpoint.changed_subscriptions(log, resolved, mid, mid + mid // 50)


@register(f"""WITH {_LOG}, w AS (SELECT DISTINCT bucket, CASE WHEN bucket < 'm' THEN 1 ELSE 2 END :: BIGINT AS priority, CASE WHEN bucket < 'm' THEN 100 ELSE 0 END AS after FROM log),
ops AS (SELECT log.*, priority, row_number() OVER (PARTITION BY log.bucket ORDER BY op_id) AS rn, count(*) OVER (PARTITION BY log.bucket) AS n FROM log JOIN w ON w.bucket = log.bucket WHERE op_id > after AND op_id <= {_MID}),
top AS (SELECT * FROM ops WHERE rn <= 1500 ORDER BY priority, bucket, op_id LIMIT 1500)
SELECT priority, bucket, op_id, op, (rn - 1) // 400 AS chunk, n > max(rn) OVER (PARTITION BY bucket) AS has_more FROM top""")
def q39_data_batch(spark, sf_dir):
    log = event_log(spark, sf_dir)
    low = F.col("bucket") < "m"
    wanted = log.select("bucket").distinct().select("bucket", F.when(low, 1).otherwise(2).cast("bigint").alias("priority"), F.when(low, 100).otherwise(0).alias("after"))
    return checkpoint.data_batch(log, wanted, _middle(log, "op_id"), limit=1500, chunk_ops=400).select("priority", "bucket", "op_id", "op", "chunk", "has_more")


@register(f"SELECT CAST(user_id AS VARCHAR) AS user_id, max(event_id) AS checkpoint FROM events WHERE event_id <= {_MID_EVENT} GROUP BY user_id")
def q40_write_checkpoints(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"]
    writes = e.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("checkpoint"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("lsn"))
    return checkpoint.write_checkpoints(writes, f"{_middle(e, 'event_id'):010d}")


def _connections(spark, sf_dir) -> DataFrame:
    return parquet_tables(spark, sf_dir, "events")["events"].select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 7).alias("client_id"), F.col("event_type").alias("sdk"), F.col("ts").alias("connected_at"))


_DAYS = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'"


@register(f"SELECT event_type AS sdk, count(DISTINCT event_id % 7) AS clients, count(DISTINCT user_id) AS users FROM events WHERE {_DAYS} GROUP BY event_type")
def q41_sdk_report(spark, sf_dir):
    return reports.sdk_usage(_connections(spark, sf_dir), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


@register(f"SELECT event_id AS id, user_id, true AS more FROM (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50)")
def q42_report_page(spark, sf_dir):
    return reports.page(_connections(spark, sf_dir), 50, F.lit("2024-01-20").cast("timestamp_ntz"), F.lit(0)).select("id", "user_id", "more")


@register(f"WITH {_LOG} SELECT op, count(*) AS n, CAST(sum(coalesce(strlen(data), 0)) AS BIGINT) AS data_bytes FROM compacted GROUP BY op")
def q43_op_counts(spark, sf_dir):
    return checkpoint.op_counts(oplog.compact(event_log(spark, sf_dir)))


LEGACY = {
    "bucket_definitions": {
        "by_nation": {
            "parameters": "SELECT c_nationkey AS nation FROM customer WHERE c_custkey = token_parameters.user_id",
            "data": ["SELECT s_suppkey AS id, s_name FROM supplier WHERE s_nationkey = bucket.nation", "SELECT n_nationkey AS id, n_name FROM nation WHERE n_nationkey = bucket.nation"],
        },
        "everyone": {"data": ["SELECT r_regionkey AS id, r_name FROM region"]},
    }
}


@register("""SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'by_nation[' || c_nationkey || ']' AS bucket FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'everyone[]' FROM customer""")
def q44_bucket_definitions(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "customer", "supplier", "nation", "region")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")])
    return resolve_buckets(load(LEGACY), t, r).select("request_id", "bucket")


@register("""SELECT 'by_nation[' || s_nationkey || ']' AS bucket, 'supplier' AS object_type, CAST(s_suppkey AS VARCHAR) AS object_id FROM supplier UNION ALL SELECT 'by_nation[' || n_nationkey || ']', 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'everyone[]', 'region', CAST(r_regionkey AS VARCHAR) FROM region""")
def q44b_legacy_rows(spark, sf_dir):
    return bucket_rows(load(LEGACY), parquet_tables(spark, sf_dir, "customer", "supplier", "nation", "region")).drop("data")


ALPHA = {"config": {"edition": 2}, "streams": {"near": {"auto_subscribe": True, "query": "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = auth.user_id())"}}}


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'near|0[' || c_nationkey || ']' AS bucket FROM customer")
def q44c_alpha_stream(spark, sf_dir):
    t = parquet_tables(spark, sf_dir, "customer", "supplier")
    return resolve_buckets(load(ALPHA), t, _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")])).select("request_id", "bucket")


@register("SELECT event_id AS id, user_id AS who, value FROM events WHERE event_type = 'purchase'")
def q45_event_payloads(spark, sf_dir):
    plan = load({"config": {"edition": 3}, "streams": {"s": {"query": "SELECT event_id AS id FROM events"}}, "event_definitions": {"bought": {"payloads": ["SELECT event_id AS id, user_id AS who, value FROM events WHERE event_type = 'purchase'"]}}})
    return sinks.event_payloads(plan, parquet_tables(spark, sf_dir, "events"))["bought"]


@register("SELECT 'CREATE TABLE part (id TEXT PRIMARY KEY, p_name TEXT, p_size INTEGER, p_retailprice REAL);' AS line")
def q45b_client_schema(spark, sf_dir):
    plan = load({"config": {"edition": 3}, "streams": {"s": {"query": "SELECT p_partkey AS id, p_name, p_size, p_retailprice FROM part"}}})
    lines = sinks.client_schema(plan, parquet_tables(spark, sf_dir, "part")).split("\n")
    return spark.sql("SELECT explode(:lines) AS line", {"lines": F.array(*map(F.lit, lines))})


@register("SELECT 's|0[' || c_nationkey || ']' AS bucket, CAST(c_custkey AS VARCHAR) AS object_id FROM customer")
def q46_distinct(spark, sf_dir):
    return _rows(spark, sf_dir, "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_nationkey = auth.parameter('n')", "customer").select("bucket", "object_id")


def _all() -> None:
    from weirflow import queries_protocol  # noqa: F401  (registers its own)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)

"""More registered queries: sources of changes, options, lookups, the protocol's lines, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import checkpoint, oplog, reports
from weirflow.operators.evaluate import bucket_rows, resolve_buckets, within_limits
from weirflow.plans.compile import compile_stream
from weirflow.plans.config import load
from weirflow.plans.model import Plan
from weirflow.queries import _LOG, _MID, _OPS, _USERS, GONE, _connections, _h, _middle, _requests, _rows, _user_log, _wrap, event_log, register
from weirflow.sources import changes, convert, sinks
from weirflow.sources.shared import folder
from weirflow.sources.tables import parquet_tables

USERS = "SELECT user_id AS id, event_id AS v FROM users WHERE event_type = auth.parameter('kind')"


def _users_plan() -> Plan:
    return Plan(3, [compile_stream("s", [USERS])])


def _events(spark, sf_dir) -> DataFrame:
    return parquet_tables(spark, sf_dir, "events")["events"].withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)"))


def _image(*columns: str):
    return F.struct(*columns) if columns else F.struct("user_id", "event_type", "event_id")


def _ops(plan: Plan, found: DataFrame) -> DataFrame:
    return oplog.changes_to_ops(changes.row_states(plan, found)).select("bucket", "op", "object_type", "object_id", "data", "checksum")


_ST = f"""st AS (SELECT epoch_us(ts) * 2 + 1 AS seq, user_id, event_id, CASE WHEN event_type <> '{GONE}' THEN 's|0["' || event_type || '"]' END AS b FROM events)"""


def _ops_sql(st: str = _ST) -> str:
    return f"""WITH {st}, h AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY seq) AS pb FROM st),
o AS (SELECT b AS bucket, 'PUT' AS op, user_id, '{{"id":' || user_id || ',"v":' || event_id || '}}' AS data FROM h WHERE b IS NOT NULL UNION ALL SELECT pb, 'REMOVE', user_id, NULL FROM h WHERE pb IS NOT NULL AND pb IS DISTINCT FROM b)
SELECT bucket, op, 'users' AS object_type, CAST(user_id AS VARCHAR) AS object_id, data, CASE WHEN op = 'PUT' THEN {_h("'put.users.' || user_id || '.' || data")} ELSE {_h("'delete.users/' || user_id")} END AS checksum FROM o"""


# --- sources


def _postgres(e: DataFrame, truncated=None) -> DataFrame:
    gone = F.col("event_type") == GONE
    cut = F.lit(False) if truncated is None else truncated
    return e.select(
        F.concat(F.hex(F.floor(F.col("us") / 1_000_000).cast("bigint")), F.lit("/"), F.hex((F.col("us") % 1_000_000).cast("bigint"))).alias("lsn"), F.lit(1).alias("place"), F.when(cut, "truncate").when(gone, "delete").when(F.col("event_id") % 4 == 0, "insert").otherwise("update").alias("tag"),
        F.lit("users").alias("relation"), F.when(gone & ~cut, _image()).alias("before"), F.when(~gone & ~cut, _image()).alias("after"), F.lit(None).cast("array<string>").alias("unchanged"),
    )


@register(_ops_sql())
def q47_postgres_changes(spark, sf_dir):
    return _ops(_users_plan(), changes.postgres_changes(_postgres(_events(spark, sf_dir)), ["user_id"]))


@register(_ops_sql(f"""ch AS (SELECT * FROM events WHERE event_id % 500 <> 99), cuts AS (SELECT epoch_us(ts) * 2 + 1 AS seq FROM events WHERE event_id % 500 = 99),
st AS (SELECT epoch_us(ts) * 2 + 1 AS seq, user_id, event_id, CASE WHEN event_type <> '{GONE}' THEN 's|0["' || event_type || '"]' END AS b FROM ch UNION ALL SELECT seq, user_id, NULL, NULL FROM cuts, (SELECT DISTINCT user_id FROM ch))"""))
def q48_truncates(spark, sf_dir):
    """Every five hundredth change empties the table."""
    return _ops(_users_plan(), changes.postgres_changes(_postgres(_events(spark, sf_dir), F.col("event_id") % 500 == 99), ["user_id"]))


@register(_ops_sql(f"""st AS (SELECT epoch_us(ts) * 2 + 1 AS seq, user_id + CASE WHEN event_type = 'signup' THEN 1000000 ELSE 0 END AS user_id, event_id, CASE WHEN event_type <> '{GONE}' THEN 's|0["' || event_type || '"]' END AS b FROM events
  UNION ALL SELECT epoch_us(ts) * 2, user_id, NULL, NULL FROM events WHERE event_type = 'signup')"""))
def q49_mysql_changes(spark, sf_dir):
    """One type of change moves the row to another key."""
    e = _events(spark, sf_dir)
    moved = F.col("event_type") == "signup"
    after = F.struct((F.col("user_id") + F.when(moved, 1_000_000).otherwise(0)).alias("user_id"), "event_type", "event_id")
    # the rows of an hour stand in one event each, and two at a time in one where they follow each other
    events = e.select(
        F.concat(F.lit("log."), F.lpad(F.floor(F.col("us") / 3_600_000_000).cast("string"), 9, "0")).alias("file"), (F.col("us") % 3_600_000_000).alias("position"),
        F.when(F.col("event_type") == GONE, "delete").when(moved, "update").otherwise("write").alias("event"), F.lit("users").alias("table"),
        F.array(after).alias("rows"), F.when(moved, F.array(_image())).alias("rows_before"),
    )
    return _ops(_users_plan(), changes.mysql_changes(events, ["user_id"]))


@register(_ops_sql())
def q50_mongodb_changes(spark, sf_dir):
    """Deletes come as such, or as updates whose document is gone."""
    e = _events(spark, sf_dir)
    gone = F.col("event_type") == GONE
    kind = F.when(gone, F.when(F.col("event_id") % 2 == 0, "delete").otherwise("update")).otherwise(F.when(F.col("event_id") % 3 == 0, "replace").otherwise("insert"))
    events = e.select(
        F.struct(F.floor(F.col("us") / 1_000_000).cast("bigint").alias("seconds"), (F.col("us") % 1_000_000).alias("increment")).alias("clusterTime"), kind.alias("operationType"), F.struct(F.lit("app").alias("db"), F.lit("users").alias("coll")).alias("ns"),
        F.struct(F.col("user_id").cast("string").alias("_id")).alias("documentKey"), F.when(~gone, _image()).alias("fullDocument"),
    )
    return _ops(_users_plan(), changes.mongodb_changes(events))


@register(_ops_sql())
def q51_mssql_changes(spark, sf_dir):
    """Updates as two images, before and after, of one place in the log."""
    e = _events(spark, sf_dir)
    op = F.when(F.col("event_type") == GONE, F.array(F.lit(1))).when(F.col("event_id") % 4 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(4), F.lit(3)))
    each = e.withColumn("op", F.explode(op))
    before = F.col("op") == 3
    lsn = F.unhex(F.lpad(F.hex("us"), 20, "0"))
    events = each.select(lsn.alias("__$start_lsn"), lsn.alias("__$seqval"), F.col("op").alias("__$operation"), "user_id", F.when(before, "view").otherwise(F.col("event_type")).alias("event_type"), F.when(before, -1).otherwise(F.col("event_id")).alias("event_id"))
    return _ops(_users_plan(), changes.mssql_changes(events, ["user_id"], "users"))


@register(_ops_sql())
def q52_convex_changes(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.lit("users").alias("_table"), F.col("us").alias("_ts"), F.col("user_id").cast("string").alias("_id"), (F.col("event_type") == GONE).alias("_deleted"), "user_id", "event_type", "event_id")
    return _ops(_users_plan(), changes.convex_changes(events))


@register(f"""WITH s AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT s.user_id, 's|0["' || event_type || '"]' AS b, s.event_id FROM s JOIN events e ON e.event_id = s.event_id WHERE s.user_id NOT IN (SELECT user_id FROM events WHERE event_id < 5))
SELECT b AS bucket, 'users' AS object_type, CAST(user_id AS VARCHAR) AS object_id, '{{"id":' || user_id || ',"v":' || event_id || '}}' AS data FROM n""")
def q53_snapshot_overlap(spark, sf_dir):
    """A snapshot passes over rows that changes have brought already."""
    e = _events(spark, sf_dir)
    last = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e")).select("user_id", "e.event_type", "e.event_id")
    known = e.filter("event_id < 5").select(F.col("user_id").cast("string").alias("key"))
    found = changes.snapshot_changes(last, "users", ["user_id"], "0", known)
    return changes.row_states(_users_plan(), found).select(F.explode("buckets").alias("b"), "object_type", "object_id").select("b.bucket", "object_type", "object_id", "b.data")


@register("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 700) UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 700)")
def q54_snapshot_chunks(spark, sf_dir):
    """Two chunks by key, the second after the first one's last key, and then rows by their ids: what a resumed snapshot reads."""
    t = parquet_tables(spark, sf_dir, "orders", "lineitem")
    o = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    first = convert.key_chunks(o, "id", limit=400)
    at = convert.resume_key(first, "id")
    second = convert.key_chunks(o, "id", at, limit=300)
    end = convert.resume_key(second, "id")
    rest = convert.by_ids(o, t["lineitem"].filter("l_quantity > 45").select(F.col("l_orderkey").alias("id")), "id")
    return first.union(second).union(rest if end is None else rest.filter(F.col("id") > end))


_NEAR = "SELECT o.o_orderkey AS id FROM orders o, users u WHERE o.o_custkey = u.event_id AND u.event_type = auth.parameter('kind')"
_ENTRIES = f"""WITH st AS (SELECT epoch_us(ts) AS seq, user_id, event_id, CASE WHEN event_type <> '{GONE}' THEN 'near|0|0|0["' || event_type || '"]' END AS b FROM events),
h AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY seq) AS pb FROM st),
o AS (SELECT seq, b AS lookup, user_id, '[' || event_id || ']' AS output FROM h WHERE b IS NOT NULL UNION ALL SELECT seq, pb, user_id, NULL FROM h WHERE pb IS NOT NULL AND pb IS DISTINCT FROM b)"""


def _entries_of(spark, sf_dir) -> DataFrame:
    found = changes.postgres_changes(_postgres(_events(spark, sf_dir)), ["user_id"])
    return oplog.changes_to_lookups(changes.lookup_states(Plan(3, [compile_stream("near", [_NEAR])]), found))


@register(f"{_ENTRIES} SELECT lookup, 'users/' || user_id AS source_key, output, row_number() OVER (ORDER BY seq, lookup) AS id FROM o")
def q55_lookup_changes(spark, sf_dir):
    """Entries of lookups from changes; one without outputs takes the earlier ones back."""
    return _entries_of(spark, sf_dir).select("lookup", "source_key", F.try_element_at("outputs", F.lit(1)).alias("output"), "id")


@register(f"{_ENTRIES} SELECT lookup, 'users/' || user_id AS source_key, output FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lookup ORDER BY seq DESC) AS rn FROM o) WHERE rn = 1 AND output IS NOT NULL")
def q56_lookups_after_changes(spark, sf_dir):
    return oplog.compact_parameters(_entries_of(spark, sf_dir)).select("lookup", "source_key", F.col("outputs")[0].alias("output"))


# --- options


_VERSIONED = {"config": {"edition": 2, "timestamp_max_precision": "milliseconds"}, "streams": {"e": {"auto_subscribe": True, "query": "SELECT event_id AS id, ts, event_type FROM events WHERE event_type = auth.parameter('kind')"}}}


@register("""SELECT '4#e|0["' || event_type || '"]' AS bucket, CAST(event_id AS VARCHAR) AS object_id, '{"id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || '","event_type":"' || event_type || '"}' AS data FROM events""")
def q57_versions_and_precision(spark, sf_dir):
    return bucket_rows(load(_VERSIONED, version=4), parquet_tables(spark, sf_dir, "events")).select("bucket", "object_id", "data")


@register("""SELECT 'e[]' AS bucket, CAST(event_id AS VARCHAR) AS object_id, '{"id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '"}' AS data FROM events""")
def q58_old_time_stamps(spark, sf_dir):
    spec = {"bucket_definitions": {"e": {"data": ["SELECT event_id AS id, ts FROM events"]}}}
    return bucket_rows(load(spec, version=4), parquet_tables(spark, sf_dir, "events")).select("bucket", "object_id", "data")


@register("""SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'mine[' || c_nationkey || ']' AS bucket, 1 :: BIGINT AS priority FROM customer WHERE c_acctbal > 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'mine[' || c_nationkey || ']', 2 :: BIGINT FROM customer WHERE c_acctbal <= 0""")
def q59_priorities_of_queries(spark, sf_dir):
    spec = {
        "bucket_definitions": {
            "mine": {
                "priority": 3,
                "parameters": [
                    "SELECT c_nationkey AS n, 1 AS _priority FROM customer WHERE c_custkey = token_parameters.user_id AND c_acctbal > 0",
                    "SELECT c_nationkey AS n, 2 AS _priority FROM customer WHERE c_custkey = token_parameters.user_id AND NOT (c_acctbal > 0)",
                ],
                "data": ["SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = bucket.n"],
            }
        }
    }
    t = parquet_tables(spark, sf_dir, "customer", "supplier")
    out = resolve_buckets(load(spec), t, _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")]))
    return out.select("request_id", "bucket", F.col("priority").cast("bigint").alias("priority"))


@register("""SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'd|0[' || c_nationkey || ']' AS bucket, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END :: BIGINT AS priority FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'p|0[' || (c_custkey % 5) || ']', 3 :: BIGINT FROM customer WHERE c_custkey % 2 = 0""")
def q60_subscriptions(spark, sf_dir):
    """A third of the requests name the default stream with a priority of their own, which stands for the default one; half take another stream with parameters."""
    t = parquet_tables(spark, sf_dir, "customer", "supplier")
    c = t["customer"]
    base = _requests(c, F.col("c_custkey"), [F.col("c_custkey").alias("sub"), F.col("c_nationkey").alias("n")])
    explicit = base.filter(F.col("request_id").cast("bigint") % 3 == 0).withColumn("stream", F.lit("d")).withColumn("subscription", F.lit(None).cast("string")).withColumn("priority", F.lit(0))
    with_parameters = base.filter(F.col("request_id").cast("bigint") % 2 == 0).withColumn("stream", F.lit("p")).withColumn("subscription", F.to_json(F.struct((F.col("request_id").cast("bigint") % 5).alias("k"))))
    d = compile_stream("d", ["SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = auth.parameter('n')"], auto_subscribe=True, priority=2)
    p = compile_stream("p", ["SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = subscription.parameter('k')"])
    out = resolve_buckets(Plan(3, [d, p]), t, base.unionByName(explicit).unionByName(with_parameters))
    return out.select("request_id", "bucket", F.col("priority").cast("bigint").alias("priority"))


@register("""SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS request_id, 's|0[' || c_custkey || ']' AS bucket FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) <= (SELECT count(*) // 25 FROM customer))""")
def q61_limits(spark, sf_dir):
    """Requests with more buckets than an even share read nothing."""
    t = parquet_tables(spark, sf_dir, "customer", "nation")
    r = _requests(t["nation"], F.col("n_nationkey"), [F.col("n_nationkey").alias("nation")])
    s = compile_stream("s", ["SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = auth.parameter('nation'))"], auto_subscribe=True)
    most = t["customer"].count() // 25
    return within_limits(resolve_buckets(Plan(3, [s]), t, r), buckets=most, per_definition=most)[0].select("request_id", "bucket")


# --- rows and requests


@register("SELECT 's|0[' || a || ',' || b || ']' AS bucket, CAST(c_custkey AS VARCHAR) AS object_id FROM customer, (VALUES (1), (2), (3)) x(a), (VALUES (4), (5)) y(b)")
def q62_two_arrays(spark, sf_dir):
    c = parquet_tables(spark, sf_dir, "customer")["customer"].withColumn("xs", F.lit("[1,2,3]")).withColumn("ys", F.lit("[4,5]"))
    sql = "SELECT c.c_custkey AS id FROM c, json_each(c.xs) AS x, json_each(c.ys) AS y WHERE x.value = auth.parameter('x') AND y.value = auth.parameter('y')"
    return _rows(spark, sf_dir, sql, extra={"c": c}).select("bucket", "object_id")


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, 's|0[' || c_custkey || ',\"' || c_mktsegment || '\"]' AS bucket FROM customer")
def q63_request_documents(spark, sf_dir):
    """Whole documents of a request, and paths into them."""
    t = parquet_tables(spark, sf_dir, "customer")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub"), F.struct(F.col("c_mktsegment").alias("segment")).alias("about")])
    sql = "SELECT c_custkey AS id FROM customer WHERE c_custkey = request.user_id() AND c_mktsegment = auth.parameters() ->> '$.about.segment'"
    return resolve_buckets(Plan(3, [compile_stream("s", [sql], auto_subscribe=True)]), t, r).select("request_id", "bucket")


@register("""SELECT 'd[]' AS bucket, 'e' AS object_type, CAST(event_id AS VARCHAR) AS object_id, '{"id":' || event_id || CASE WHEN event_id % 3 = 0 THEN ',"good":1,"k":' || event_id ELSE ',"good":0,"k":null' END || '}' AS data FROM events WHERE event_id % 3 <> 1""")
def q64_invalid_json(spark, sf_dir):
    """A text that is no JSON makes its row an error, and leaves the others alone."""
    e = parquet_tables(spark, sf_dir, "events")["events"]
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), F.col("event_id"), F.lit("}"))).when(F.col("event_id") % 3 == 1, "{broken")
    spec = {"bucket_definitions": {"d": {"data": ["SELECT event_id AS id, json_valid(doc) AS good, json_extract(doc, '$.k') AS k FROM e"]}}}
    return bucket_rows(load(spec), {"e": e.select("event_id", doc.alias("doc"))})


@register("SELECT 'by[' || s_nationkey || ']' AS bucket, 'supplier' AS object_type, CAST(s_suppkey AS VARCHAR) AS object_id, '{\"id\":' || s_suppkey || ',\"_table_suffix\":\"er\"}' AS data FROM supplier")
def q65_table_suffix(spark, sf_dir):
    """The older column with what a wildcard stood for."""
    spec = {"bucket_definitions": {"by": {"parameters": ["SELECT token_parameters.n AS n"], "data": ["SELECT s_suppkey AS id, _table_suffix FROM \"suppli%\" WHERE s_nationkey = bucket.n"]}}}
    return bucket_rows(load(spec), parquet_tables(spark, sf_dir, "supplier"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'seg[\"' || c_mktsegment || '\"]' AS bucket FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'each[' || k || ']' FROM customer, (VALUES (1), (2)) x(k)")
def q66_static_parameters(spark, sf_dir):
    """Parameters from the token alone, and from each element of one of its arrays."""
    spec = {
        "bucket_definitions": {
            "seg": {"parameters": ["SELECT token_parameters.segment AS s"], "data": ["SELECT c_custkey AS id FROM customer WHERE c_mktsegment = bucket.s"]},
            "each": {"parameters": ["SELECT value AS v FROM json_each(token_parameters.list)"], "data": ["SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = bucket.v"]},
        }
    }
    t = parquet_tables(spark, sf_dir, "customer", "supplier")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub"), F.col("c_mktsegment").alias("segment"), F.array(F.lit(1), F.lit(2)).alias("list")])
    return resolve_buckets(load(spec), t, r).select("request_id", "bucket")


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, bucket FROM customer, (VALUES ('f|0[\"F\"]'), ('f|0[\"O\"]')) x(bucket) WHERE c_acctbal > 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'f|1[' || c_custkey || ']' FROM customer")
def q67_alpha_variants(spark, sf_dir):
    """An older stream with alternatives: an array of the request that must hold the row's value, or the row's own column."""
    spec = {"config": {"edition": 2}, "streams": {"f": {"auto_subscribe": True, "query": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN connection.parameter('states') OR o_custkey = auth.user_id()"}}}
    t = parquet_tables(spark, sf_dir, "customer", "orders")
    states = F.when(F.col("c_acctbal") > 0, F.array(F.lit("F"), F.lit("O"))).otherwise(F.expr("cast(array() as array<string>)"))
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")], connection=[states.alias("states")])
    return resolve_buckets(load(spec), t, r).select("request_id", "bucket")


# --- the protocol


def _resolved(spark, sf_dir) -> DataFrame:
    c = parquet_tables(spark, sf_dir, "customer")["customer"]
    return c.select(F.col("c_custkey").cast("string").alias("request_id"), F.col("c_custkey").cast("string").alias("bucket"), (F.col("c_custkey") % 4).cast("int").alias("priority"))


@register(f"""WITH {_USERS}, top AS (SELECT max(op_id) AS m FROM log), ev AS (SELECT max(event_id) AS m FROM events), changed AS (SELECT DISTINCT bucket FROM ulog, top WHERE op_id > m - 20), looked AS (SELECT DISTINCT user_id % 10 AS lookup FROM events, ev WHERE event_id > m - 3)
SELECT CAST(c_custkey AS VARCHAR) AS request_id, c_custkey % 10 IN (SELECT lookup FROM looked) AS invalidate_all, CASE WHEN c_custkey % 10 NOT IN (SELECT lookup FROM looked) THEN CASE WHEN CAST(c_custkey AS VARCHAR) IN (SELECT bucket FROM changed) THEN '1' ELSE '0' END END AS n FROM customer""")
def q68_checkpoint_update(spark, sf_dir):
    """What requests look at again after the last ops: all buckets where a lookup changed, else the changed ones."""
    log = _user_log(spark, sf_dir)
    upto = log.agg(F.max("op_id")).first()[0]
    e = parquet_tables(spark, sf_dir, "events")["events"]
    last = e.agg(F.max("event_id")).first()[0]
    # ids of entries and ops are of one order: the last three events stand for the last ops
    entries = e.select((F.col("user_id") % 10).cast("string").alias("lookup"), (F.when(F.col("event_id") > last - 3, F.lit(upto)).otherwise(0)).alias("id"))
    resolved = _resolved(spark, sf_dir)
    used = resolved.select("request_id", (F.col("request_id").cast("bigint") % 10).cast("string").alias("lookup"))
    found = checkpoint.checkpoint_update(log, entries, resolved, used, upto - 20, upto)
    return found.select("request_id", "invalidate_all", F.size("buckets").cast("string").alias("n"))


@register(f"""WITH {_USERS}, a AS (SELECT bucket, {_wrap('sum(checksum)')} AS checksum, count(*) AS n FROM ulog WHERE op_id <= {_MID} GROUP BY 1), b AS (SELECT bucket, {_wrap('sum(checksum)')} AS checksum, count(*) AS n FROM ulog WHERE op_id <= {_MID} + 50 GROUP BY 1),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, CAST(c_custkey AS VARCHAR) AS bucket, c_custkey % 4 AS priority FROM customer),
d AS (SELECT r.*, coalesce(b.checksum, 0) AS c, coalesce(b.n, 0) AS n, a.checksum IS DISTINCT FROM b.checksum OR a.n IS DISTINCT FROM b.n OR r.priority = 0 AS updated FROM r LEFT JOIN a USING (bucket) LEFT JOIN b USING (bucket))
SELECT request_id, '{{"checkpoint_diff":{{"last_op_id":"' || ({_MID} + 50) || '","removed_buckets":[' || CASE WHEN priority = 1 THEN '"gone"' ELSE '' END || '],"updated_buckets":[' || CASE WHEN updated THEN '{{"bucket":"' || bucket || '","checksum":' || c || ',"count":' || n || ',"priority":' || priority || '}}' ELSE '' END || ']}}}}' AS line FROM d""")
def q69_diff_lines(spark, sf_dir):
    """Buckets of priority 0 are new to their requests, and those of priority 1 had another one before."""
    log = _user_log(spark, sf_dir)
    mid = _middle(log, "op_id")
    resolved = _resolved(spark, sf_dir)
    before = resolved.filter("priority != 0").unionByName(resolved.filter("priority = 1").withColumn("bucket", F.lit("gone")))
    return checkpoint.diff_line(checkpoint.checksums(log, upto=mid), checkpoint.checksums(log, upto=mid + 50), before, resolved, mid + 50)


@register(f"""WITH {_LOG}, w AS (SELECT DISTINCT bucket, CASE WHEN bucket < 'm' THEN 1 ELSE 2 END :: BIGINT AS priority FROM log)
SELECT 1 :: BIGINT AS priority, '{{"partial_checkpoint_complete":{{"last_op_id":"' || max(op_id) || '","priority":1}}}}' AS line FROM log UNION ALL SELECT 2, '{{"checkpoint_complete":{{"last_op_id":"' || max(op_id) || '"}}}}' FROM log""")
def q70_completions(spark, sf_dir):
    """All data of both priorities is in one batch."""
    log = event_log(spark, sf_dir)
    n = log.count()
    wanted = log.select("bucket").distinct().select("bucket", F.when(F.col("bucket") < "m", 1).otherwise(2).cast("bigint").alias("priority"), F.lit(0).alias("after"))
    return checkpoint.completion_lines(checkpoint.data_batch(log, wanted, n, limit=n), wanted, n)


@register(f"""WITH {_OPS}, w AS (SELECT log.*, row_number() OVER (PARTITION BY bucket ORDER BY op_id) AS rn FROM log), t AS (SELECT * FROM w WHERE rn <= 2500 ORDER BY bucket, op_id LIMIT 2500), c AS (SELECT bucket, (rn - 1) // 400 AS chunk, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT *, sum(n) OVER (ORDER BY bucket, chunk) - n AS before FROM c)
SELECT t.bucket, t.op_id FROM t JOIN s ON s.bucket = t.bucket AND s.chunk = (t.rn - 1) // 400 WHERE before < 1000""")
def q71_superseded(spark, sf_dir):
    """A newer checkpoint ends a batch with the chunk in which it has sent a thousand ops."""
    log = event_log(spark, sf_dir)
    wanted = log.select("bucket").distinct().select("bucket", F.lit(1).alias("priority"), F.lit(0).alias("after"))
    batch = checkpoint.data_batch(log, wanted, log.count(), limit=2500, chunk_ops=400)
    return checkpoint.until_superseded(batch, True, 1000).select("bucket", "op_id")


_ATTEMPTS = """SELECT event_type AS stream, event_id AS "at", CASE WHEN event_id % 5 = 0 THEN 'keepalive' ELSE 'commit' END AS kind, lpad(CAST(event_id * 10 - (event_id % 7) * (event_id % 13) AS VARCHAR), 12, '0') AS lsn, event_id AS op_id, event_id > 40 AS snapshot_done, CASE WHEN event_id % 11 = 3 THEN lpad(CAST(event_id * 10 - 20 AS VARCHAR), 12, '0') END AS no_checkpoint_before FROM events"""


@register(f"""WITH a AS ({_ATTEMPTS}), b AS (SELECT *, snapshot_done AND (no_checkpoint_before IS NULL OR lsn >= no_checkpoint_before) AS may FROM a),
c AS (SELECT *, max(CASE WHEN may THEN lsn END) OVER (PARTITION BY stream ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM b), d AS (SELECT *, may AND (high IS NULL OR lsn >= high) AS ok FROM c)
SELECT stream, "at", CASE WHEN ok AND kind = 'commit' THEN max(op_id) OVER w END AS checkpoint, max(CASE WHEN ok THEN lsn END) OVER w AS resume_lsn FROM d WINDOW w AS (PARTITION BY stream ORDER BY "at")""")
def q72_commits(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"]
    n = F.col("event_id")
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    attempts = e.select(F.col("event_type").alias("stream"), n.alias("at"), F.when(n % 5 == 0, "keepalive").otherwise("commit").alias("kind"), pad(n * 10 - (n % 7) * (n % 13)).alias("lsn"), n.alias("op_id"), (n > 40).alias("snapshot_done"), F.when(n % 11 == 3, pad(n * 10 - 20)).alias("no_checkpoint_before"))
    return checkpoint.commits(attempts).select("stream", "at", "checkpoint", "resume_lsn")


@register("SELECT event_type AS stream, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY event_type")
def q73_replication_lag(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"].select(F.col("event_type").alias("stream"), F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")).alias("changed_at"))
    return checkpoint.replication_lag(e, F.timestamp_micros(F.lit(1_706_745_600_000_000)))


@register("""SELECT CAST(event_id AS VARCHAR) AS request_id, '{"token_expires_in":' || CAST(greatest(0, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 1e6)) AS BIGINT) || '}' AS line FROM events""")
def q74_token_lines(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"].select(F.col("event_id").cast("string").alias("request_id"), F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")).alias("expires_at"))
    return checkpoint.token_lines(e, F.timestamp_micros(F.lit(1_705_276_800_000_000)))


# --- storage


@register(f"""WITH {_OPS}, z AS (SELECT *, op_id // 3000 AS span, coalesce(strlen(data), 0) AS size FROM log), p AS (SELECT *, (sum(size) OVER (PARTITION BY bucket, span ORDER BY op_id) - size) // 2000 AS part FROM z)
SELECT bucket, min(op_id) AS min_op, max(op_id) AS max_op, count(*) AS n_ops, {_wrap('sum(checksum)')} AS checksum, CAST(sum(size) AS BIGINT) AS data_bytes FROM p GROUP BY bucket, span, part""")
def q75_chunk_documents(spark, sf_dir):
    return oplog.chunk_documents(event_log(spark, sf_dir), max_bytes=2000, span=3000).drop("ops")


@register(f"""WITH {_OPS} SELECT op_id, bucket, op, object_id, data, checksum FROM log""")
def q76_unpacked_documents(spark, sf_dir):
    """Packed and unpacked again, the log is as it was."""
    return oplog.unpacked(oplog.chunk_documents(event_log(spark, sf_dir), max_bytes=5000, span=10_000)).select("op_id", "bucket", "op", "object_id", "data", "checksum")


@register("""WITH n AS (SELECT event_id, strlen(props) AS size, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, (n - 1) // 300 AS stretch FROM n)
SELECT event_id, stretch, CAST((sum(size) OVER (PARTITION BY stretch ORDER BY n) - size) // 1000 AS BIGINT) AS part FROM g""")
def q77_flush_groups(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"].select("event_id", "ts", "props")
    return oplog.flush_groups(e, ["ts", "event_id"], F.octet_length("props"), max_rows=300, max_bytes=1000).select("event_id", "flush.stretch", "flush.part")


@register(f"""WITH {_USERS}, a AS (SELECT bucket, count(*) AS before FROM ulog WHERE op_id <= {_MID} GROUP BY 1), b AS (SELECT bucket, count(*) AS n_ops FROM ulog GROUP BY 1)
SELECT bucket, n_ops, n_ops - coalesce(before, 0) AS new_ops FROM b LEFT JOIN a USING (bucket) WHERE n_ops - coalesce(before, 0) >= 10 AND n_ops - coalesce(before, 0) >= 0.5 * n_ops""")
def q78_compaction_due(spark, sf_dir):
    log = _user_log(spark, sf_dir)
    return oplog.compaction_due(checkpoint.checksums(log).select("bucket", "n_ops"), checkpoint.checksums(log, upto=_middle(log, "op_id")), least_share=0.5)


@register(f"""WITH {_OPS}, l AS (SELECT *, max(op_id) OVER (PARTITION BY bucket, subkey) AS last FROM log) SELECT (SELECT max(op_id) FROM log) + row_number() OVER (ORDER BY bucket, object_id, subkey) AS op_id, bucket, 'PUT' AS op, object_id, data, checksum FROM l WHERE op_id = last AND op = 'PUT'""")
def q79_touched(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return oplog.touched(log, log.count()).select("op_id", "bucket", "op", "object_id", "data", "checksum")


@register(f"WITH {_OPS} SELECT bucket, op_id, data FROM log WHERE bucket = 'click'")
def q80_bucket_of_a_log(spark, sf_dir):
    """One bucket read from a log on disk: one of its partitions."""
    import uuid

    path = f"{folder(spark)}/log-{uuid.uuid4().hex}"
    sinks.append_log(event_log(spark, sf_dir), path, parts=8)
    return sinks.read_bucket(spark, path, "click", parts=8).select("bucket", "op_id", "data")


@register(f"""WITH {_OPS}, n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY op_id) AS rn, count(*) OVER (PARTITION BY bucket) AS c FROM log), t AS (SELECT * FROM n WHERE bucket = 'click')
SELECT (rn - 1) // 500 AS chunk, '{{"data":{{"bucket":"click","after":"' || (min(op_id) - 1) || '","next_after":"' || max(op_id) || '","has_more":false,"data":[' || string_agg('{{"op_id":"' || op_id || '","op":"' || op || '","object_type":"users","object_id":"' || object_id || '","subkey":"' || subkey || '"' || CASE WHEN data IS NULL THEN '' ELSE ',"data":"' || replace(data, '"', '\\"') || '"' END || ',"checksum":' || checksum || '}}', ',' ORDER BY op_id) || ']}}}}' AS line FROM t GROUP BY 1""")
def q81_data_lines(spark, sf_dir):
    log = event_log(spark, sf_dir).filter("bucket = 'click'")
    n = log.count()
    wanted = spark.sql("SELECT 'click' AS bucket, 1 AS priority, 0 AS after")
    return checkpoint.data_lines(checkpoint.data_batch(log, wanted, 1 << 62, limit=n, chunk_ops=500)).select("chunk", "line")


@register("""SELECT event_id AS id, 12 + 8 + 8 + 12 + 10 + length(event_type) + 12 + 1 + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 8 END AS bytes, CASE WHEN length(props) > 9 THEN NULL ELSE props END AS data, length(props) > 9 AS oversized FROM events""")
def q82_row_sizes(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"]
    sized = e.select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    rows = e.join(sized.select(F.col("event_id").alias("k"), oplog.row_bytes(sized).alias("bytes")), F.col("event_id") == F.col("k"))
    return oplog.limited(rows.select(F.col("event_id").alias("id"), "bytes", F.col("props").alias("data")), limit=9)


def _le32(n: str) -> str:
    h = f"lpad(printf('%x', CAST({n} AS BIGINT)), 8, '0')"
    return f"(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"


_DOC = f"'02' || lower(hex('table')) || '00' || {_le32('length(t) + 1')} || lower(hex(t)) || '00' || '02' || lower(hex('id')) || '00' || {_le32('length(i) + 1')} || lower(hex(i)) || '00'"


@register(f"""WITH k AS (SELECT 'p' || p_size AS t, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '-E29B-41d4-a716-446655440000' END AS i FROM part), d AS (SELECT t, i, {_DOC} AS body FROM k),
s AS (SELECT t, i, sha1(unhex('a396dd9109fc4017a28d3df722f651e9' || {_le32('length(body) // 2 + 5')} || body || '00')) AS h FROM d)
SELECT t, i, CASE WHEN i LIKE '%-%' THEN t || '/' || lower(i) ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS subkey FROM s""")
def q83_subkeys(spark, sf_dir):
    part = parquet_tables(spark, sf_dir, "part")["part"]
    key = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-E29B-41d4-a716-446655440000")))
    return part.select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("t"), key.alias("i")).withColumn("subkey", oplog.hashed_subkey(F.col("t"), F.col("i")))


@register("SELECT o_orderkey AS id, upper(lpad(printf('%x', o_orderkey), 8, '0')) || '/' || upper(lpad(printf('%x', o_custkey), 8, '0')) AS lsn FROM orders")
def q84_log_positions(spark, sf_dir):
    o = parquet_tables(spark, sf_dir, "orders")["orders"]
    return o.select(F.col("o_orderkey").alias("id"), checkpoint.lsn_key(F.lower(F.hex("o_orderkey")), F.lower(F.hex("o_custkey"))).alias("lsn"))


# --- reports


@register("""WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'), s AS (SELECT event_type AS sdk, count(DISTINCT event_id % 7) AS clients, count(DISTINCT user_id) AS users FROM e GROUP BY 1)
SELECT (SELECT count(DISTINCT user_id) FROM e) AS users, '[' || string_agg('{"sdk":"' || sdk || '","clients":' || clients || ',"users":' || users || '}', ',' ORDER BY sdk) || ']' AS sdks FROM s""")
def q85_sdk_report_json(spark, sf_dir):
    return reports.sdk_report(_connections(spark, sf_dir), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


@register("""WITH w AS (SELECT epoch_us(ts) AS us, value, unnest(range(0, 6)) AS k FROM events), b AS (SELECT (us // 5000000 - k) * 5000000 AS start, value FROM w)
SELECT start, start + 30000000 AS "end", max(value) AS value FROM b GROUP BY start""")
def q86_rolling_max(spark, sf_dir):
    e = parquet_tables(spark, sf_dir, "events")["events"]
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    return reports.rolling_max(e.select("ts", "value")).select(us("start").alias("start"), us("end").alias("end"), "value")


@register(f"WITH {_OPS} SELECT CAST(sum(coalesce(strlen(data), 0)) AS BIGINT) AS data_bytes, count(*) AS ops FROM log")
def q87_storage_sizes(spark, sf_dir):
    return reports.storage_sizes(event_log(spark, sf_dir))


_KINDS = {"js": "const part = new Table({ p_name: column.text, p_size: column.integer, p_retailprice: column.real });", "dart": "Schema([Table('part', [Column.text('p_name'), Column.integer('p_size'), Column.real('p_retailprice')])]);", "kotlin": 'val schema = Schema(Table(name = "part", columns = listOf(Column.text("p_name"), Column.integer("p_size"), Column.real("p_retailprice"))))', "kotlin-room": '@Entity(tableName = "part") data class Part(@PrimaryKey val id: String, @ColumnInfo("p_name") val pName: String, @ColumnInfo("p_size") val pSize: Long, @ColumnInfo("p_retailprice") val pRetailprice: Double)', "swift": 'let schema = Schema(Table(name: "part", columns: [.text("p_name"), .integer("p_size"), .real("p_retailprice")]))', "dotnet": 'public static Table Part = new Table { Name = "part", Columns = { ["p_name"] = ColumnType.Text, ["p_size"] = ColumnType.Integer, ["p_retailprice"] = ColumnType.Real } };'}


@register("SELECT * FROM (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in _KINDS.items()) + ") x(language, line)")
def q88_client_languages(spark, sf_dir):
    plan = load({"config": {"edition": 3}, "streams": {"s": {"query": "SELECT p_partkey AS id, p_name, p_size, p_retailprice FROM part"}}})
    t = parquet_tables(spark, sf_dir, "part")
    return spark.createDataFrame([(k, sinks.client_schema(plan, t, k)) for k in _KINDS], "language string, line string")


@register("SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey % 2 = 0 AS BIGINT) AS even, '[' || o_custkey || ',1]' AS pair FROM orders")
def q89_conversions(spark, sf_dir):
    o = parquet_tables(spark, sf_dir, "orders")["orders"]
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even"), F.array("o_custkey", F.lit(1).cast("bigint")).alias("pair"))
    return convert.convert(rows, "mysql")


@register("SELECT 's[]' AS bucket, 'part' AS object_type, CAST(p_partkey AS VARCHAR) AS object_id, '{\"p_partkey\":0,\"id\":' || p_partkey || '}' AS data FROM part")
def q90_older_star(spark, sf_dir):
    """In older editions * leaves out names with a leading underscore, and what was selected before it stays."""
    part = parquet_tables(spark, sf_dir, "part")["part"].select("p_partkey", F.lit(1).alias("_hidden"), F.col("p_partkey").alias("id"))
    return bucket_rows(load({"bucket_definitions": {"s": {"data": ["SELECT 0 AS p_partkey, * FROM part"]}}}), {"part": part})


@register("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN lpad(printf('%x', event_id), 24, '0') WHEN 1 THEN CAST(event_id * 1000000007 AS VARCHAR) WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' WHEN 4 THEN '{"v":' || event_id || '}' END AS value FROM events""")
def q91_extended_json(spark, sf_dir):
    """Values as a document store's extended JSON writes them."""
    e = parquet_tables(spark, sf_dir, "events")["events"]
    n = F.col("event_id")
    wrapped = lambda k, v: F.concat(F.lit('{"' + k + '":"'), v, F.lit('"}'))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = F.when(n % 5 == 0, wrapped("$oid", F.lpad(F.lower(F.hex(n)), 24, "0"))).when(n % 5 == 1, wrapped("$numberLong", (n * 1000000007).cast("string"))).when(n % 5 == 2, wrapped("$date", at)).when(n % 5 == 3, F.lit('{"$maxKey":1}')).otherwise(F.concat(F.lit('{"v":'), n.cast("string"), F.lit("}")))
    return e.select(n.alias("id"), convert.mongo_extended(raw).alias("value"))


@register("SELECT 's|0[' || k || ']' AS bucket, CAST(c_custkey AS VARCHAR) AS object_id FROM customer, (SELECT unnest(range(0, 3)) AS k) WHERE k < c_custkey % 4")
def q92_own_table_function(spark, sf_dir):
    """A table-valued function of the user's own: the numbers below its argument."""
    from weirflow.functions.table import TABLE_FUNCTIONS, register_table_function

    if "below" not in TABLE_FUNCTIONS:
        register_table_function("below", lambda n: F.transform(F.sequence(F.lit(1), n.try_cast("int")), lambda k: F.struct(F.lit(None).cast("string").alias("key"), (k - 1).cast("string").alias("value"))))
    c = parquet_tables(spark, sf_dir, "customer")["customer"].select("c_custkey", (F.col("c_custkey") % 4).alias("n")).filter("n > 0")
    return _rows(spark, sf_dir, "SELECT c.c_custkey AS id FROM c, below(c.n) AS b WHERE b.value = auth.parameter('k')", extra={"c": c}).select("bucket", "object_id")


@register("SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) % 100 AS cents FROM orders")
def q93_own_scalar_function(spark, sf_dir):
    """A scalar function of the user's own."""
    from weirflow.functions.scalar import FUNCTIONS, register_function
    from weirflow.functions.values import as_real, integer

    if "last_digits" not in FUNCTIONS:
        register_function("last_digits", lambda x: integer(F.pmod(F.round(as_real(x)).cast("bigint"), F.lit(100))))
    return _rows(spark, sf_dir, "SELECT o_orderkey AS id, last_digits(o_totalprice) AS cents FROM orders", "orders").drop("bucket", "object_type", "object_id")


@register("""SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'g|0["' || x.v || '"]' AS bucket FROM customer, (VALUES ('F'), ('P')) x(v) WHERE c_custkey % 2 = 0""")
def q94_alpha_overlap(spark, sf_dir):
    """An older stream whose rows' arrays overlap with one of the request's."""
    spec = {"config": {"edition": 2}, "streams": {"g": {"auto_subscribe": True, "query": "SELECT id FROM docs WHERE states && auth.parameter('states')"}}}
    t = parquet_tables(spark, sf_dir, "customer")
    docs = t["customer"].select(F.col("c_custkey").alias("id"), F.lit('["F","O"]').alias("states"))
    states = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("F"), F.lit("P"))).otherwise(F.expr("cast(array() as array<string>)"))
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub"), states.alias("states")])
    return resolve_buckets(load(spec), {"docs": docs}, r).select("request_id", "bucket")


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'by[' || (c_custkey % 4) || ']' AS bucket FROM customer")
def q95_client_parameters(spark, sf_dir):
    """The older name of what a client itself sends."""
    spec = {"bucket_definitions": {"by": {"parameters": ["SELECT user_parameters.k AS k"], "data": ["SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = bucket.k"]}}}
    t = parquet_tables(spark, sf_dir, "customer", "supplier")
    r = _requests(t["customer"], F.col("c_custkey"), [F.col("c_custkey").alias("sub")], connection=[(F.col("c_custkey") % 4).alias("k")])
    return resolve_buckets(load(spec), t, r).select("request_id", "bucket")


@register(f"""WITH {_OPS}, z AS (SELECT *, coalesce(strlen(data), 0) AS size, row_number() OVER (PARTITION BY bucket ORDER BY op_id) AS rn FROM log), p AS (SELECT *, sum(size) OVER (PARTITION BY bucket ORDER BY op_id) - size AS before FROM z)
SELECT bucket, op_id, CAST(greatest((rn - 1) // 1000, before // 700) AS BIGINT) AS chunk FROM p""")
def q96_chunks_by_bytes(spark, sf_dir):
    """A batch of all ops, in chunks of up to 700 bytes of data."""
    log = event_log(spark, sf_dir)
    n = log.count()
    wanted = log.select("bucket").distinct().select("bucket", F.lit(1).alias("priority"), F.lit(0).alias("after"))
    return checkpoint.data_batch(log, wanted, n, limit=n, chunk_ops=1000, chunk_bytes=700).select("bucket", "op_id", "chunk")


@register("SELECT event_id AS id, 2 + event_id * 3 - 1 AS a, (2 + event_id) * 3 - 1 AS b, event_id % 2 = 0 OR event_id % 3 = 0 AND event_id % 5 = 0 AS c, '1' || (event_id + 1) AS d FROM events")
def q97_precedence(spark, sf_dir):
    sql = "SELECT event_id AS id, 2 + event_id * 3 - 1 AS a, (2 + event_id) * 3 - 1 AS b, event_id % 2 = 0 OR event_id % 3 = 0 AND event_id % 5 = 0 AS c, '1' || (event_id + 1) AS d FROM events"
    return _rows(spark, sf_dir, sql, "events", semantics="sqlite").drop("bucket", "object_type", "object_id").withColumn("c", F.col("c") == 1)


@register("SELECT 's|0[' || n_regionkey || ']' AS bucket, 'n' AS object_type, CAST(n_nationkey AS VARCHAR) AS object_id, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def q98_table_star(spark, sf_dir):
    """All columns of one table of several, and a plus that changes nothing."""
    t = parquet_tables(spark, sf_dir, "nation")["nation"]
    typed = t.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))
    sql = "SELECT n.*, +n.n_nationkey AS id FROM nation AS n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = auth.parameter('r')"
    return _rows(spark, sf_dir, sql, "region", extra={"nation": typed})


@register("SELECT 's|0|0|0' AS lookup, '[' || p_size || ']' AS key, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 10 GROUP BY p_size")
def q99_whole_reals_in_keys(spark, sf_dir):
    """A real without a fraction is looked up like the integer of the same value."""
    from weirflow.operators.evaluate import lookup_rows

    part = parquet_tables(spark, sf_dir, "part")["part"].select("p_partkey", F.col("p_size").cast("double").alias("size"))
    s = compile_stream("s", ["SELECT l.l_orderkey AS id FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND p.size = auth.parameter('size') AND p.size > 10"])
    return lookup_rows(Plan(3, [s]), {"part": part}).groupBy("lookup", "key").agg(F.count("*").alias("n"))

"""Definitions that are accepted and rejected, and what they compile to."""

import pytest

from weirflow.plans.compile import compile_stream
from weirflow.plans.config import load, options_of, versioned
from weirflow.plans.model import as_json
from weirflow.plans.sql import DefinitionError, Lit, Op, Ref, parse

#: Over the tables of the test data.
ACCEPTED = [
    "SELECT * FROM region",
    "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_custkey = auth.user_id()",
    "SELECT p.*, p.p_partkey AS id FROM part AS p WHERE p.p_size BETWEEN 1 AND 15 AND p.p_brand IS NOT NULL",
    "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag NOT IN '[\"R\"]' AND NOT (l_quantity < 5)",
    "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag IN ARRAY['A', 'N'] OR l_suppkey = auth.parameter('supplier')",
    "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS state FROM orders",
    "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = auth.parameter('nation') AND c_acctbal > 0)",
    "SELECT o.o_orderkey AS id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = auth.parameter('nation')",
    "SELECT s.* FROM supplier s, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name IN connection.parameter('regions') AND auth.parameter('staff') IS TRUE",
    "SELECT user_id AS id FROM events WHERE props ->> '$.team' IN auth.parameter('teams')",
    "SELECT user_id AS id FROM events WHERE auth.user_id() IN props -> 'readers'",
    "SELECT user_id AS id FROM events WHERE props -> 'tags' && subscription.parameter('tags') AND value >= 10",
    "SELECT e.event_id AS id FROM events e, json_each(e.props) AS p WHERE p.key = auth.parameter('key')",
    "SELECT e.event_id AS id FROM events e, json_each(auth.parameter('kinds')) AS k WHERE e.event_type = k.value",
    'SELECT *, t.table_name() AS origin FROM "archive"."orders_%" t WHERE t.table_suffix() = auth.parameter(\'year\')',
    "SELECT p.* FROM part p, (SELECT l_partkey, l_suppkey FROM lineitem) AS sold(part, supplier) WHERE p.p_partkey = sold.part AND sold.supplier = auth.user_id()",
    "SELECT a.* FROM orders a, customer b, supplier c, nation d WHERE a.o_custkey = b.c_custkey AND b.c_nationkey = d.n_nationkey AND d.n_nationkey = c.s_nationkey AND c.s_suppkey = a.o_shippriority",
    "SELECT * FROM nation WHERE n_regionkey = 1; SELECT this part is left alone",
]
REJECTED = [
    # aggregates, ordering, limits, set operations, windows
    "SELECT avg(o_totalprice) AS a FROM orders", "SELECT count(*) FROM orders", "SELECT o_custkey AS id FROM orders GROUP BY o_custkey", "SELECT o_custkey AS id FROM orders HAVING o_custkey > 1", "SELECT n_nationkey AS id FROM nation ORDER BY n_name", "SELECT n_nationkey AS id FROM nation LIMIT 3",
    "SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier", "SELECT c_custkey AS id FROM customer INTERSECT SELECT s_suppkey FROM supplier", "SELECT c_custkey AS id FROM customer WHERE rank() OVER () = 1", "SELECT upper(DISTINCT n_name) AS n FROM nation",
    # joins other than equalities, several synced tables
    "SELECT o.o_orderkey AS id FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey AS id FROM orders o JOIN customer USING (key)", "SELECT o.o_orderkey AS id FROM orders o NATURAL JOIN customer", "SELECT o.o_orderkey AS id, c.c_name AS n FROM orders o, customer c WHERE o.o_custkey = c.c_custkey",
    "SELECT * FROM orders, customer WHERE orders.o_custkey = customer.c_custkey", "SELECT o.* FROM orders o, customer c WHERE o.o_totalprice > c.c_acctbal", "SELECT o.* FROM orders o, customer c WHERE NOT (o.o_custkey = c.c_custkey)", "SELECT o.* FROM orders o, customer c, json_each(o.o_custkey + c.c_custkey) AS j WHERE j.value = 1",
    # requests beyond equalities, request data in rows
    "SELECT o_orderkey AS id FROM orders WHERE o_totalprice < auth.parameter('most')", "SELECT o_orderkey AS id, auth.parameter('tenant') AS t FROM orders", "SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    # unknown or unsupported words
    "SELECT p_name AS id FROM part WHERE p_name LIKE 'g%'", "SELECT -p_size AS id FROM part", "SELECT trim(p_name) AS id FROM part", "SELECT json_valid(props) AS id FROM events", "SELECT CAST(o_orderdate AS date) AS id FROM orders", "SELECT o_orderkey AS id FROM orders WHERE nowhere.o_custkey = 1", "SELECT o_orderkey AS id FROM orders WHERE auth.unknown() = 1",
    "SELECT n AS id FROM range(1, 5)", "SELECT x.* FROM (SELECT * FROM part) AS x", "SELECT p_partkey", "SELECT p_partkey AS id FROM", "SELECT p_partkey AS id FROM part WHERE", "SELECT p_partkey AS id FROM part one two",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(sql):
    assert compile_stream("s", [sql]).buckets


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(sql):
    with pytest.raises(DefinitionError):
        compile_stream("s", [sql])


def test_precedence():
    assert parse("SELECT a + b || c AS x FROM t").items[0].expr == Op("||", (Op("+", (Ref(None, "a"), Ref(None, "b"))), Ref(None, "c")))
    where = parse("SELECT a FROM t WHERE a = 1 OR b = 2 AND NOT c").where
    assert where.name == "OR" and where.args[1].name == "AND"
    assert parse("SELECT a FROM t WHERE x ->> 'k' = 'v'").where == Op("=", (Op("->>", (Ref(None, "x"), Lit("k"))), Lit("v")))


def test_chain_of_tables():
    """Lines of orders of customers of a nation: what is a key, what a lookup takes and gives, and what filters it."""
    s = compile_stream("lines", ["SELECT l.* FROM lineitem l, orders o, customer c WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = auth.parameter('nation') AND o.o_orderstatus = 'O'"])
    (bucket,) = s.buckets
    (q,) = bucket.queriers
    assert [k.column for k in bucket.evaluators[0].keys] == ["l_orderkey"]
    lookups = {k.table.name: ([e.column for e in k.inputs], [e.column for e in k.outputs], len(k.filters)) for k in q.lookups}
    assert lookups == {"orders": (["o_custkey"], ["o_orderkey"], 1), "customer": (["c_custkey", "c_nationkey"], [], 0)}
    assert as_json(s)["buckets"][0]["prefix"] == "lines|0"


def test_alternatives_share_a_bucket():
    two_ways = "SELECT o_orderkey AS id FROM orders WHERE o_custkey = subscription.parameter('c') AND (auth.user_id() IN (SELECT c_custkey FROM customer) OR auth.user_id() IN (SELECT s_suppkey FROM supplier))"
    s = compile_stream("s", [two_ways])
    assert len(s.buckets) == 1 and len(s.buckets[0].queriers) == 2
    s = compile_stream("s", ["SELECT c_custkey AS id FROM customer WHERE c_nationkey = auth.parameter('n')", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = auth.parameter('n')"])
    assert len(s.buckets) == 1 and len(s.buckets[0].evaluators) == 2
    s = compile_stream("s", ["SELECT l_orderkey AS id FROM lineitem WHERE l_suppkey = auth.user_id() OR l_partkey = auth.user_id()"])
    assert len(s.buckets) == 1 and len(s.buckets[0].evaluators) == 2
    s = compile_stream("s", ["SELECT l_orderkey AS id FROM lineitem WHERE l_suppkey = auth.user_id() OR l_partkey = auth.parameter('part')"])
    assert len(s.buckets) == 2
    with pytest.raises(DefinitionError):
        compile_stream("s", ["SELECT id FROM wide WHERE " + " AND ".join(f"(x{k} = auth.user_id() OR y{k} = auth.user_id())" for k in range(8))])


def test_two_arrays_of_a_row_are_two_keys():
    s = compile_stream("s", ["SELECT e.event_id AS id FROM events e, json_each(e.xs) AS x, json_each(e.ys) AS y WHERE x.value = auth.parameter('x') AND y.value = auth.parameter('y')"])
    assert len(s.buckets[0].evaluators[0].keys) == 2 and s.buckets[0].queriers[0].joins == ()


def test_warnings():
    assert compile_stream("s", ["SELECT p_partkey AS id, p_size * 2 FROM part"]).warnings
    assert compile_stream("s", ["SELECT p_partkey AS id FROM part WHERE p_brand = subscription.parameter('brand')"]).warnings
    assert any("Unused" in w for w in compile_stream("s", ["SELECT * FROM region"], {"never": "SELECT n_nationkey FROM nation"}).warnings)


def test_configuration():
    plan = load("config:\n  edition: 3\nstreams:\n  s:\n    auto_subscribe: true\n    priority: 1\n    with:\n      mine: SELECT n_nationkey FROM nation WHERE n_name = auth.parameter('n')\n    query: SELECT * FROM customer WHERE c_nationkey IN mine\n")
    assert plan.streams[0].priority == 1 and plan.streams[0].auto_subscribe and plan.options["fixed_json_extract"]
    assert versioned(plan, 4).streams[0].buckets[0].prefix == "4#s|0"
    assert load({"config": {"edition": 3}, "streams": {"s": {"query": "SELECT * FROM part"}}}, version=7).streams[0].buckets[0].prefix == "7#s|0"
    assert load({"config": {"edition": 3, "versioned_bucket_ids": False}, "streams": {"s": {"query": "SELECT * FROM part"}}}, version=7).streams[0].buckets[0].prefix == "s|0"
    for bad in ("SELECT c_nationkey AS n, 4 AS _priority FROM customer", "SELECT c_nationkey AS n, c_acctbal AS _priority FROM customer"):
        with pytest.raises(DefinitionError):
            load({"bucket_definitions": {"b": {"parameters": bad, "data": "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = bucket.n"}}})
    assert not options_of({})["timestamps_iso8601"] and options_of({"edition": 2, "timestamp_max_precision": "milliseconds"})["timestamp_max_precision"] == 3
    for bad in ({"edition": 9}, {"timestamp_max_precision": "seconds"}, {"edition": 3, "timestamp_max_precision": "years"}):
        with pytest.raises(DefinitionError):
            options_of(bad)
    for bad in (
        {"bucket_definitions": {"b": {"parameters": "SELECT id AS a FROM u", "data": ["SELECT id FROM t"]}}}, {"bucket_definitions": {"b": {"data": ["SELECT name FROM t"]}}}, {"bucket_definitions": {"b": {"data": ["SELECT id FROM t, u"]}}},
        {"config": {"edition": 2}, "streams": {"s": {"query": "SELECT a.id FROM a, b WHERE a.x = b.x"}}}, {"config": {"edition": 3}, "streams": {"s": {}}}, {"config": {"edition": 3}, "streams": {"s": {"query": "SELECT id FROM t", "priority": 4}}}, {},
    ):
        with pytest.raises(DefinitionError):
            load(bad)


def test_a_row_that_fails_is_left_out(spark):
    from weirflow.operators.evaluate import row_errors, source_rows

    t = {"t": spark.createDataFrame([("a", "550e8400-e29b-41d4-a716-446655440000", 1), ("b", "no uuid", 1), ("c", None, 1), ("d", "bad", 0)], "id string, u string, keep int")}
    s = compile_stream("s", ["SELECT id, hex(uuid_blob(u)) AS h FROM t WHERE keep = 1"])
    (b,) = s.buckets
    assert sorted(r.object_id for r in source_rows(s, b, b.evaluators[0], t).collect()) == ["a", "c"]
    assert [(r.object_id, r.error) for r in row_errors(s, b, b.evaluators[0], t).collect()] == [("b", "Cannot parse UUID")]

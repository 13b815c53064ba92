"""Rows to buckets and requests to buckets, end to end."""

import json

import pytest

from weirflow.operators.evaluate import bucket_rows, over_limits, resolve_buckets
from weirflow.plans.compile import compile_stream
from weirflow.plans.config import load
from weirflow.plans.model import Plan

REQUESTS = "request_id string, auth string, connection string, subscription string, stream string, priority int"


def request(i, auth=None, connection=None, subscription=None, stream=None, priority=None):
    return (i, json.dumps(auth or {}), json.dumps(connection or {}), json.dumps(subscription or {}), stream, priority)


def test_rows(spark):
    t = {"users": spark.sql("SELECT 'foo' AS id, 1D AS _double, 1 AS _int, CAST(NULL AS INT) AS _null, 'text' AS _text, X'00' AS _blob, 1.5D AS r, true AS b")}
    s = compile_stream("s", ["SELECT * FROM users"])
    r = bucket_rows(Plan(3, [s]), t).first()
    assert (r.bucket, r.object_type, r.object_id) == ("s|0[]", "users", "foo")
    assert r.data == '{"id":"foo","_double":1.0,"_int":1,"_null":null,"_text":"text","r":1.5,"b":1}'


@pytest.mark.parametrize("column, key", [("_double", "[1]"), ("_int", "[1]"), ("_text", '["te\\"xt"]'), ("r", "[1.5]"), ("b", "[1]"), ("_null", None), ("_blob", None)])
def test_keys(spark, column, key):
    t = {"users": spark.sql("""SELECT 'foo' AS id, 1D AS _double, 1 AS _int, CAST(NULL AS INT) AS _null, 'te"xt' AS _text, X'00' AS _blob, 1.5D AS r, true AS b""")}
    s = compile_stream("s", [f"SELECT id FROM users WHERE {column} = subscription.parameter('p')"])
    assert [r.bucket for r in bucket_rows(Plan(3, [s]), t).collect()] == ([] if key is None else [f"s|0{key}"])


def test_requests_and_subscriptions(spark):
    t = {"orgs": spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 5)], "id int, owner string, region int"), "docs": spark.createDataFrame([(1, 1), (2, 3)], "id int, org int")}
    plan = load({"config": {"edition": 3}, "streams": {
        "mine": {"auto_subscribe": True, "priority": 1, "query": "SELECT d.* FROM docs d, orgs o WHERE d.org = o.id AND o.owner = auth.user_id() AND o.region IN connection.parameter('regions')"},
        "named": {"query": "SELECT id FROM docs WHERE id = subscription.parameter('doc') AND auth.parameter('role') = 'admin'"},
    }})
    requests = spark.createDataFrame(
        [request("r1", {"sub": "a"}, {"regions": [5, 6]}), request("r2", {"sub": "a"}, {"regions": [6]}), request("r3", {"sub": "none"}, {"regions": [5]}),
         request("r4", {"sub": "x", "role": "admin"}, None, {"doc": 7}, "named", 0), request("r5", {"sub": "x"}, None, {"doc": 7}, "named"), request("r6", {"sub": "x", "role": "admin"}, None, {"doc": "7"}, "named")],
        REQUESTS,
    )
    got = sorted((r.request_id, r.bucket, r.priority, tuple(r.reasons)) for r in resolve_buckets(plan, t, requests).collect())
    assert got == [("r1", "mine|0[1]", 1, ("mine",)), ("r1", "mine|0[2]", 1, ("mine",)), ("r2", "mine|0[2]", 1, ("mine",)), ("r4", "named|0[7]", 0, ("named",)), ("r6", 'named|0["7"]', 3, ("named",))]


def test_limits(spark):
    rows = [("r", f"big|0[{k}]") for k in range(150)] + [("r", "small|0[1]"), ("q", "small|0[1]")]
    found = over_limits(spark.createDataFrame(rows, "request_id string, bucket string"), buckets=1000).collect()
    assert [(r.request_id, r.buckets, r.largest[0]["definition"]) for r in found] == [("r", 151, "big|0")]


def test_requests_of_several_classes(spark):
    """Requests are resolved by class: two subscriptions of one request that lead to one bucket are one row, with the smaller priority."""
    t = {"docs": spark.createDataFrame([(k, k % 3, k % 2) for k in range(12)], "id int, org int, kind int")}
    plan = load({"config": {"edition": 3}, "streams": {
        "s": {"query": "SELECT d.id FROM docs d, docs e WHERE d.id = e.id AND (e.org = subscription.parameter('n') OR e.kind = subscription.parameter('n'))"},
        "all": {"auto_subscribe": True, "query": "SELECT d.id FROM docs d, docs e WHERE d.id = e.id AND e.org = 2"},
    }})
    requests = spark.createDataFrame(
        [request("r1", subscription={"n": 0}, stream="s", priority=2), request("r1", subscription={"n": 1}, stream="s", priority=1), request("r1", subscription={"n": 1}, stream="s", priority=0), request("r2", subscription={"n": 1.0}, stream="s"), request("r3")],
        REQUESTS,
    )
    got = sorted((r.request_id, r.bucket, r.priority, tuple(r.reasons)) for r in resolve_buckets(plan, t, requests).collect())
    want = {}
    for r, n, p in (("r1", 0, 2), ("r1", 1, 0), ("r2", 1, 3)):
        for k in range(12):
            if n in (k % 3, k % 2):
                want[r, f"s|0[{k}]"] = min(p, want.get((r, f"s|0[{k}]"), 9))
    assert got == sorted([(*k, p, ("s",)) for k, p in want.items()] + [("r3", f"all|0[{k}]", 3, ("all",)) for k in range(2, 12, 3)])


def test_rows_of_requests_and_buckets_are_not_exchanged(spark, monkeypatch):
    """One class of many requests and buckets is dealt into parts, and what requests and buckets make meets no further exchange."""
    from weirflow.operators import evaluate

    monkeypatch.setattr(evaluate, "PART_ROWS", 1000)
    t = {"docs": spark.range(100).selectExpr("id", "id % 2 AS org")}
    s = compile_stream("s", ["SELECT d.id FROM docs d, docs e WHERE d.id = e.id AND e.org = auth.parameter('org')"], auto_subscribe=True)
    requests = spark.range(300).selectExpr("string(id) AS request_id", "concat('{\"org\":', id % 2, '}') AS auth", "'{}' AS connection", "'{}' AS subscription", "CAST(NULL AS string) AS stream", "CAST(NULL AS int) AS priority")
    df = resolve_buckets(Plan(3, [s]), t, requests)
    got = sorted((r.request_id, r.bucket) for r in df.collect())
    assert got == sorted((str(i), f"s|0[{k}]") for i in range(300) for k in range(i % 2, 100, 2))
    # above the join that makes the rows nothing groups them
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Union" in above and "Aggregate" not in above

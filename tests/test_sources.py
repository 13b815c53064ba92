"""Source conversions, patterns, sinks."""

import pytest
from pyspark.sql import functions as F

from weirflow.plans.model import Table
from weirflow.sources import convert, sinks, tables


def test_conversions(spark):
    df = spark.sql("SELECT true AS b, 3 AS i, CAST(5 AS BIGINT) AS l, 1.50BD AS d, 2.5D AS r, timestamp'2024-01-02 03:04:05.678901' AS ts, date'2024-01-02' AS day, array(1, 2) AS a, X'01' AS x, 1 AS `__$start`, 2 AS _ts")
    row = lambda s: convert.convert(df, s).first().asDict()
    assert row("postgres") == {"b": 1, "i": 3, "l": 5, "d": "1.50", "r": 2.5, "ts": "2024-01-02T03:04:05.678901Z", "day": "2024-01-02", "a": "[1,2]", "x": bytearray(b"\x01"), "__$start": 1, "_ts": 2}
    assert "__$start" not in row("mssql") and row("mssql")["d"] == 1.5 and row("mssql")["ts"].endswith(".678901000Z")
    assert row("mysql")["ts"] == "2024-01-02T03:04:05.678Z"
    assert "_ts" not in row("convex") and row("convex")["l"] == "5" and row("convex")["x"] == "AQ=="
    p = spark.range(1).select(*[convert.postgres_timestamp(F.lit(x), z) for x, z in (("infinity", True), ("-infinity", False), ("2024-01-02 03:04:05", True), ("nonsense", True))]).first()
    assert list(p) == ["9999-12-31T23:59:59Z", "0000-01-01T00:00:00", "2024-01-02T03:04:05.000000Z", None]
    m = spark.range(1).select(*[convert.mongo_extended(F.lit(x)) for x in ('{"$oid":"ab"}', '{"$numberLong":"9007199254740993"}', '{"$minKey":1}', '{"$date":"2024-01-02T03:04:05.678Z"}')]).first()
    assert list(m) == ["ab", "9007199254740993", None, "2024-01-02T03:04:05.678Z"]


def test_patterns(spark):
    one = spark.range(1)
    t = {"users_a": one, "app.users_b": one.withColumn("extra", F.lit(1)), "other": one}
    found = lambda n, s=None: [x[:2] for x in tables.matching(t, Table("t#1", n, s))]
    assert found("users_%") == [("app", "users_b"), ("public", "users_a")] and found("users_%", "a%") == [("app", "users_b")] and found("other") == [("public", "other")]
    rows = tables.scan(t, Table("t#1", "users_%"))
    assert {r["t#1|$table_suffix"]: r["t#1|extra"] for r in rows.collect()} == {"a": None, "b": 1}


def test_reconcile():
    a, b = {"relation_id": 1, "replica_id_columns": ["id"]}, {"relation_id": 2, "replica_id_columns": ["id"]}
    assert convert.reconcile({"x": a, "y": a, "z": a}, {"x": a, "y": b, "w": a}) == {"w": "snapshot", "x": "keep", "y": "snapshot", "z": "drop"}


def test_reconcile_renamed_and_replaced_tables():
    a = {"relation_id": 1, "replica_id_columns": ["id"]}
    # a renamed table is another one; so is one with another identity, or another key, under the old name
    assert convert.reconcile({"old": a}, {"new": a}) == {"old": "drop", "new": "snapshot"}
    assert convert.reconcile({"t": a}, {"t": {"relation_id": 1, "replica_id_columns": ["id", "part"]}}) == {"t": "snapshot"}
    assert convert.reconcile({}, {}) == {}


def test_changes_arrive_as_files(spark, tmp_path):
    from weirflow.sources import changes

    rows = [("users", 1, "a", False, 7), ("users", 2, "a", True, None), ("users", 3, None, False, 8)]
    df = spark.createDataFrame(rows, "_table string, _ts long, _id string, _deleted boolean, n int")
    df.write.parquet(str(tmp_path / "in"))
    stream = changes.changes_stream(spark, "convex", str(tmp_path / "in"), df.schema)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.kind, r.key, r.row and r.row.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("delete", "a", None), ("update", "a", 7)]  # a document without _id is passed over
    with pytest.raises(ValueError):
        changes.register_source("convex", changes.convex_changes)


def test_keys_of_several_columns(spark):
    from weirflow.sources import changes

    df = spark.createDataFrame([("1/1", 1, "update", "t", (1, "x"), (2, "x"), None), ("1/2", 1, "delete", "t", (2, "x"), None, None)], "lsn string, place int, tag string, relation string, before struct<a:int,b:string>, after struct<a:int,b:string>, unchanged array<string>")
    got = [(r.kind, r.key) for r in changes.keyed(changes.postgres_changes(df, ["a", "b"])).orderBy("seq").collect()]
    assert got == [("delete", '["1","x"]'), ("update", '["2","x"]'), ("delete", '["2","x"]')]


def test_rows_of_one_place_in_the_log(spark):
    """Changes of several rows at one place are changes of their own; images of updates are paired by key, then what is left of them."""
    from weirflow.sources import changes

    rows = [(1, 2, "a", 1), (1, 2, "b", 2), (1, 1, "c", 0), (1, 1, "d", 0)]
    rows += [(2, 3, "a", 1), (2, 4, "a", 3), (2, 3, "b", 2), (2, 4, "b", 4), (2, 3, "x", 5), (2, 4, "y", 6), (3, 4, "z", 7), (4, 3, "w", 8)]
    df = spark.createDataFrame(rows, "at int, op int, k string, v int").selectExpr("unhex(lpad(hex(at), 20, '0')) AS `__$start_lsn`", "unhex('00') AS `__$seqval`", "op AS `__$operation`", "k", "v")
    got = sorted((r.seq[19:20], r.kind, r.key, r.old_key, r.row and r.row.v) for r in changes.mssql_changes(df, ["k"], "t").collect())
    want = [("1", "delete", "c", None, None), ("1", "delete", "d", None, None), ("1", "insert", "a", None, 1), ("1", "insert", "b", None, 2)]
    want += [("2", "update", "a", None, 3), ("2", "update", "b", None, 4), ("2", "update", "y", "x", 6), ("3", "update", "z", None, 7), ("4", "update", "w", None, 8)]
    assert got == want


def test_many_truncates(spark):
    """Each key is emptied by the first truncate of its table after a change, in whatever range that is, and no row holds all truncates."""
    import random

    from weirflow.sources import changes

    rng = random.Random(5)
    rows, live, want = [], {}, []
    for at in range(1, 1500):
        table = rng.choice("tu")
        if rng.random() < 0.2:
            rows.append((f"0/{at:X}", 1, "truncate", table, None, None, None))
            want += sorted((f"{at:08X}", "delete", t, k) for t, k in live if t == table)
            live = {x: 1 for x in live if x[0] != table}
            continue
        key = str(rng.randrange(9))
        gone = rng.random() < 0.2
        rows.append((f"0/{at:X}", 1, "delete" if gone else "update", table, (key,) if gone else None, None if gone else (key,), None))
        want.append((f"{at:08X}", rows[-1][2], table, key))
        live.pop((table, key), None) if gone else live.update({(table, key): 1})
    df = spark.createDataFrame(rows, "lsn string, place int, tag string, relation string, before struct<a:string>, after struct<a:string>, unchanged array<string>")
    keyed = changes.keyed(changes.postgres_changes(df, ["a"]))
    assert sorted((r.seq[9:17], r.kind, r.table, r.key) for r in keyed.collect()) == sorted(want)
    assert "collect_set" not in keyed._jdf.queryExecution().optimizedPlan().toString()


def test_log_sink(spark, tmp_path):
    from weirflow.operators.oplog import LOG_SCHEMA

    log = spark.createDataFrame([(f"b{k % 3}", k, "PUT", "t", str(k), f"k{k}", "{}", 5, None) for k in range(9)], LOG_SCHEMA)
    sinks.append_log(log, str(tmp_path / "log"))
    assert [r.op_id for r in sinks.read_bucket(spark, str(tmp_path / "log"), "b1").orderBy("op_id").collect()] == [1, 4, 7]

"""The algebra of logs, held against a step-by-step version."""

import random

from pyspark.sql import functions as F

from weirflow.operators import checkpoint, oplog
from weirflow.operators.oplog import LOG_SCHEMA


def random_log(rng, buckets=12, n=25):
    rows = []
    for b in range(buckets):
        for _ in range(rng.randrange(1, n)):
            key = str(rng.randrange(4))
            put = rng.random() < rng.choice([0.3, 0.6])
            rows.append([f"b{b}", 0, "PUT" if put else "REMOVE", "t", key, "k" + key, f'{{"v":{rng.randrange(99)}}}' if put else None, rng.randrange(1 << 32), None])
    rng.shuffle(rows)
    for k, r in enumerate(rows):
        r[1] = k + 1
    return [tuple(r) for r in rows]


def wrap(x):
    return ((x + (1 << 31)) % (1 << 32)) - (1 << 31)


def plain_compact(log, max_op):
    out = []
    for b in sorted({r[0] for r in log}):
        ops = sorted(r for r in log if r[0] == b)
        ops.sort(key=lambda r: r[1])
        newest = {}
        for r in ops:
            if r[1] <= max_op and r[2] in ("PUT", "REMOVE"):
                newest[r[3:6]] = r[1]
        moved = []
        for r in ops:
            if r[1] <= max_op and r[2] in ("PUT", "REMOVE") and newest[r[3:6]] > r[1]:
                moved.append((b, r[1], "MOVE", None, None, None, None, r[7], newest[r[3:6]]))
            else:
                moved.append(r)
        prefix = []
        for r in moved:
            if r[1] > max_op or r[2] == "PUT":
                break
            prefix.append(r)
        while prefix and prefix[-1][2] == "CLEAR":
            prefix.pop()
        if sum(r[2] != "CLEAR" for r in prefix) > 1:
            targets = [r[8] for r in prefix if r[8] is not None]
            out.append((b, prefix[-1][1], "CLEAR", None, None, None, None, wrap(sum(r[7] for r in prefix)), max(targets, default=None)))
            moved = moved[len(prefix) :]
        out += moved
    return out


def plain_reduce(log):
    out = []
    for b in sorted({r[0] for r in log}):
        kept, rest = {}, 0
        for r in sorted((r for r in log if r[0] == b), key=lambda r: r[1]):
            if r[2] == "CLEAR":
                kept, rest = {}, r[7]
                continue
            if r[2] in ("PUT", "REMOVE"):
                old = kept.pop(r[3:6], None)
                rest += old[7] if old else 0
            if r[2] == "PUT":
                kept[r[3:6]] = r
            else:
                rest += r[7]
        out += [(b, 0, "CLEAR", None, None, None, None, wrap(rest), None)] + [(*r[:8], None) for r in kept.values()]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compaction_and_reduction(spark):
    rng = random.Random(17)
    log = random_log(rng)
    df = spark.createDataFrame(log, LOG_SCHEMA).cache()
    top = len(log)
    for max_op in (top, top // 2):
        once = oplog.compact(df, max_op)
        assert rows(once) == sorted(plain_compact(log, max_op), key=str)
    once = spark.createDataFrame(plain_compact(log, top // 2), LOG_SCHEMA)
    twice = oplog.compact(once)
    assert rows(twice) == sorted(plain_compact([tuple(r) for r in once.collect()], top), key=str)
    # what a client sees stays the same, whenever it is compacted
    view = rows(oplog.reduce_log(df).drop("target_op"))
    assert view == sorted((r[:8] for r in plain_reduce(log)), key=str)
    assert rows(oplog.reduce_log(once).drop("target_op")) == view and rows(oplog.reduce_log(twice).drop("target_op")) == view
    sums = rows(checkpoint.checksums(df).select("bucket", "checksum"))
    assert rows(checkpoint.checksums(twice).select("bucket", "checksum")) == sums


def test_compaction_makes_its_window_once(spark):
    """Newest ops are found once, not for each of the four readings of the log."""
    df = spark.createDataFrame(random_log(random.Random(5)), LOG_SCHEMA)
    assert "Window" in oplog.compact_moves(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in oplog.compact(df)._jdf.queryExecution().optimizedPlan().toString()


def test_reducing_in_parts(spark):
    """r(B) = r(r(first part) and the rest), at several places."""
    log = random_log(random.Random(3), buckets=5)
    df = spark.createDataFrame(log, LOG_SCHEMA).cache()
    whole = rows(oplog.reduce_log(df))
    for cut in (1, len(log) // 3, len(log) - 1):
        head = oplog.reduce_log(df.filter(F.col("op_id") <= cut))
        assert rows(oplog.reduce_log(head.unionByName(df.filter(F.col("op_id") > cut)))) == whole


def test_hashes_and_wrapping(spark):
    r = spark.range(1).select(oplog.put_hash(F.lit("t"), F.lit("1"), F.lit("{}")), oplog.wrap32(F.lit(4294967295)), oplog.wrap32(F.lit(9287505201)), checkpoint.lsn_key(F.lit("1a"), F.lit("ff"))).first()
    assert tuple(r) == (3095835067, -1, 697570609, "0000001A/000000FF")
    assert checkpoint.may_commit("2", "1", None, True) and not checkpoint.may_commit("2", "1", "3", True) and not checkpoint.may_commit("2", None, None, False)


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted(tuple(r) for r in oplog.numbered(df, ["k"], 10).select("k", "op_id").collect())
    assert got == [(k, k + 11) for k in range(1000)]


def test_entries_of_one_place_are_in_the_order_of_lookups(spark):
    states = [("r1", "1", [("b", ["x"])]), ("r2", "1", [("a", ["x"])]), ("r1", "2", []), ("r2", "2", [("c", ["y"])])]
    df = spark.createDataFrame(states, "source_key string, seq string, lookups array<struct<lookup:string,outputs:array<string>>>")
    got = sorted((r.id, r.lookup, r.source_key) for r in oplog.changes_to_lookups(df).collect())
    assert got == [(1, "a", "r2"), (2, "b", "r1"), (3, "a", "r2"), (4, "b", "r1"), (5, "c", "r2")]


def test_lines(spark):
    df = spark.createDataFrame([("b", k, "PUT", "t", str(k), f"k{k}", "{}", 5, None) for k in range(1, 8)], LOG_SCHEMA)
    batch = checkpoint.data_batch(df, spark.createDataFrame([("b", 0, 1)], "bucket string, after long, priority int"), 7, limit=5, chunk_ops=2)
    lines = [r.line for r in checkpoint.data_lines(batch).orderBy("chunk").collect()]
    assert len(lines) == 3 and '"after":"0","next_after":"2","has_more":true' in lines[0]
    full = checkpoint.checkpoint_line(checkpoint.checksums(df), spark.createDataFrame([("r", "b", 3)], "request_id string, bucket string, priority int"), 7).first().line
    assert full == '{"checkpoint":{"last_op_id":"7","buckets":[{"bucket":"b","checksum":35,"count":7,"priority":3}]}}'

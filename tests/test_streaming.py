"""The stream of changes gives the same ops as the batch operator."""

from pyspark.sql import functions as F

from weirflow.operators import oplog
from weirflow.streaming import cdc

STATES = "object_type string, object_id string, subkey string, seq string, buckets array<struct<bucket:string,data:string>>"


def test_stream_equals_batch(spark, tmp_path):
    rows, n = [], 0
    for row in range(6):
        for buckets in (["a"], ["a", "b"], ["b"], [], ["c"])[: 2 + row % 4]:
            n += 1
            rows.append(("t", str(row), f"t/{row}", f"{n:05d}", [(b, f'{{"n":{n}}}') for b in buckets]))
    df = spark.createDataFrame(rows, STATES)
    for k in range(2):  # two files, read one per batch
        df.filter(F.col("seq") <= "00009" if k == 0 else F.col("seq") > "00009").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cdc.ROCKSDB)
    try:
        states = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = cdc.run_into(states, str(tmp_path / "log"), str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    columns = ["bucket", "op", "object_id", "subkey", "data", "checksum"]
    got = spark.read.parquet(str(tmp_path / "log"))
    want = oplog.changes_to_ops(df)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    ids = sorted(r.op_id for r in got.select("op_id").collect())
    assert ids == list(range(1, len(ids) + 1))


def test_changes_read_again_and_rows_that_come_back(spark, tmp_path):
    files = [[("t", "1", "t/1", "00001", [("a", "{}")])], [("t", "1", "t/1", "00001", [("a", "{}")])], [("t", "1", "t/1", "00002", [])], [("t", "1", "t/1", "00003", [("b", "{}")])]]
    schema = spark.createDataFrame(files[0], STATES).schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cdc.ROCKSDB)
    try:
        for rows in files:
            spark.createDataFrame(rows, STATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            states = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = cdc.run_into(states, str(tmp_path / "log"), str(tmp_path / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "log")).orderBy("op_id").collect()
    assert [(r.op_id, r.bucket, r.op) for r in got] == [(1, "a", "PUT"), (2, "a", "REMOVE"), (3, "b", "PUT")]

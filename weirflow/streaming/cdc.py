"""Change capture as a stream: per source row, the buckets it is in are state; each change becomes PUTs and REMOVEs.

State lives in the RocksDB store, keyed by the row's key: its buckets and the place of its last change, for rows that are in
a bucket, and nothing once a row is in none. A change that is read again is passed over while its row is live; after that,
Spark's file source, which reads a file once, is what keeps old changes from coming again. There are no watermarks: order is
by log position, and nothing is late.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("bucket", "op", "object_type", "object_id", "subkey", "data")] + [T.StructField("seq", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("checksum", T.LongType())]
)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little")


class RowBuckets(StatefulProcessor):
    """One key's changes, in order of seq: columns object_type, object_id, subkey, seq, buckets (array of bucket, data)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getValueState("buckets", T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("seq", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("seq")
        names, last = (list(self.buckets.get()[0]), self.buckets.get()[1]) if self.buckets.exists() else ([], "")
        out = []
        for c in changes.itertuples(index=False):
            if c.seq <= last:
                continue  # seen before: a snapshot that overlaps the changes, or a file read again
            now = {}
            for b in c.buckets:
                b = b if isinstance(b, dict) else b.asDict()
                now[b["bucket"]] = b["data"]
            out += [(b, "PUT", c.object_type, c.object_id, c.subkey, d, c.seq, 0, _hash(f"put.{c.object_type}.{c.object_id}.{d}")) for b, d in now.items()]
            out += [(b, "REMOVE", c.object_type, c.object_id, c.subkey, None, c.seq, 1, _hash(f"delete.{c.subkey}")) for b in names if b not in now]
            names, last = list(now), c.seq
        if names:
            self.buckets.update((names, last))
        else:
            self.buckets.clear()
        yield pd.DataFrame(out, columns=OPS.names)

    def close(self) -> None:
        pass


def stream_ops(states: DataFrame) -> DataFrame:
    """Ops of a stream of row states; op ids are given per batch by ``oplog.numbered`` when a batch is committed."""
    return states.groupBy("subkey").transformWithStateInPandas(statefulProcessor=RowBuckets(), outputStructType=OPS, outputMode="Append", timeMode="None")


def _file_system(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_op(spark, path: str, batch_id: int) -> int:
    """The last op id before a batch: what the latest earlier batch left beside the log."""
    p, fs = _file_system(spark, f"{path}/_last_op")
    if not fs.exists(p):
        return 0
    before = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit() and int(f.getPath().getName()) < batch_id]
    if not before:
        return 0
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_last_op/{max(before)}"))
    try:
        return int(stream.readUTF())
    finally:
        stream.close()


def _keep_last_op(spark, path: str, batch_id: int, last: int) -> None:
    p, fs = _file_system(spark, f"{path}/_last_op/{batch_id}")
    stream = fs.create(p, True)
    stream.writeUTF(str(last))
    stream.close()
    # an earlier batch isn't run again once the one after it is done
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_last_op/{batch_id - 2}"), False)


def run_into(states: DataFrame, path: str, checkpoint: str):
    """Starts a query that numbers each batch's ops after those before it and appends them to a log."""
    from weirflow.operators.oplog import numbered

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = _last_op(spark, path, batch_id)
        # a batch that is run again overwrites what it wrote
        done = f"{path}/batch={batch_id}"
        numbered(batch, ["seq", "kind", "bucket", "subkey"], first).drop("kind").write.mode("overwrite").parquet(done)
        _keep_last_op(spark, path, batch_id, first + spark.read.parquet(done).count())

    return stream_ops(states).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)

"""Checksums, checkpoint diffs, ordered bounded batches, protocol lines and write checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.oplog import wrap32

CHUNK_OPS, CHUNK_BYTES = 1000, 1 << 20


def checksums(log: DataFrame, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Per bucket: signed 32-bit sum of checksums, ops, and whether a CLEAR is among them; for after < op_id <= upto."""
    part = log
    if after is not None:
        part = part.filter(F.col("op_id") > after)
    if upto is not None:
        part = part.filter(F.col("op_id") <= upto)
    return part.groupBy("bucket").agg(wrap32(F.sum("checksum")).alias("checksum"), F.count("*").alias("n_ops"), F.max(F.col("op") == "CLEAR").alias("cleared"))


def add_checksums(cached: DataFrame, delta: DataFrame) -> DataFrame:
    """A stored checksum and what came since; a CLEAR in the delta makes the stored one void."""
    a, b = cached.alias("a"), delta.alias("b")
    replaced = F.coalesce(F.col("b.cleared"), F.lit(False))
    old = lambda c: F.when(replaced, 0).otherwise(F.coalesce(F.col(f"a.{c}"), F.lit(0)))
    new = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0))
    joined = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full_outer")
    return joined.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), wrap32(old("checksum") + new("checksum")).alias("checksum"), (old("n_ops") + new("n_ops")).cast("bigint").alias("n_ops"), (replaced | F.coalesce(F.col("a.cleared"), F.lit(False))).alias("cleared"))


def checkpoint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets of two checkpoints: added, changed (checksum or count differ), removed, unchanged."""
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.checksum") == F.col("b.checksum")) & (F.col("a.n_ops") == F.col("b.n_ops"))
    status = F.when(F.col("b.bucket").isNull(), "removed").when(F.col("a.bucket").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full_outer").select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), status.alias("status"), F.col("b.checksum").alias("checksum"), F.col("b.n_ops").alias("n_ops"))


def changed_buckets(log: DataFrame, last: int, upto: int) -> DataFrame:
    return log.filter((F.col("op_id") > last) & (F.col("op_id") <= upto)).select("bucket").distinct()


def changed_subscriptions(log: DataFrame, resolved: DataFrame, last: int, upto: int) -> DataFrame:
    """Changed buckets that some request reads."""
    return resolved.join(changed_buckets(log, last, upto), "bucket", "left_semi")


def changed_lookups(entries: DataFrame, last: int, upto: int) -> DataFrame:
    """Lookups that got entries, empty ones too."""
    return entries.filter((F.col("id") > last) & (F.col("id") <= upto)).select("lookup").distinct()


def checkpoint_update(log: DataFrame, entries: DataFrame, resolved: DataFrame, used: DataFrame, last: int, upto: int, most: int = 1000) -> DataFrame:
    """What each request must look at again between two checkpoints: request_id, invalidate_all, buckets.

    ``resolved``: request_id, bucket; ``used``: request_id, lookup (what the request's buckets were found by). A request one
    of whose lookups changed resolves its buckets anew and looks at all of them; so does every request if more than ``most``
    buckets or lookups changed, as then no list of them is kept. Others look at those of their buckets that changed.
    """
    buckets, lookups = changed_buckets(log, last, upto), changed_lookups(entries, last, upto)
    # ``most`` rows and one tell whether there are more
    many = buckets.limit(most + 1).agg((F.count("*") > most).alias("b")).crossJoin(lookups.limit(most + 1).agg((F.count("*") > most).alias("l"))).select((F.col("b") | F.col("l")).alias("many"))
    requests = resolved.select("request_id").union(used.select("request_id")).distinct()
    moved = used.join(lookups, "lookup", "left_semi").select("request_id").distinct().withColumn("moved", F.lit(True))
    changed = resolved.select("request_id", "bucket").distinct().join(buckets, "bucket", "left_semi").groupBy("request_id").agg(F.sort_array(F.collect_list("bucket")).alias("changed"))
    joined = requests.join(moved, "request_id", "left").join(changed, "request_id", "left").crossJoin(F.broadcast(many))
    every = F.coalesce(F.col("moved"), F.lit(False)) | F.col("many")
    return joined.select("request_id", every.alias("invalidate_all"), F.when(~every, F.coalesce("changed", F.expr("cast(array() as array<string>)"))).alias("buckets"))


def diff_line(old: DataFrame, new: DataFrame, resolved_old: DataFrame, resolved: DataFrame, checkpoint: int) -> DataFrame:
    """One line per request on what changed between two checkpoints: buckets that are new or whose checksum changed, and buckets that are gone."""
    now = resolved.join(new, "bucket", "left").select("request_id", "bucket", "priority", F.coalesce("checksum", F.lit(0)).alias("checksum"), F.coalesce("n_ops", F.lit(0)).alias("count"))
    was = resolved_old.join(old, "bucket", "left").select(F.col("request_id").alias("r"), F.col("bucket").alias("b"), F.coalesce("checksum", F.lit(0)).alias("c"), F.coalesce("n_ops", F.lit(0)).alias("n"))
    both = now.join(was, (F.col("request_id") == F.col("r")) & (F.col("bucket") == F.col("b")), "full_outer")
    updated = F.col("bucket").isNotNull() & (F.col("b").isNull() | (F.col("checksum") != F.col("c")) | (F.col("count") != F.col("n")))
    entry = F.struct("bucket", "checksum", "count", "priority")
    lines = both.groupBy(F.coalesce("request_id", "r").alias("request_id")).agg(F.sort_array(F.collect_list(F.when(updated, entry))).alias("updated_buckets"), F.sort_array(F.collect_list(F.when(F.col("bucket").isNull(), F.col("b")))).alias("removed_buckets"))
    diff = F.struct(F.lit(str(checkpoint)).alias("last_op_id"), "removed_buckets", "updated_buckets")
    return lines.select("request_id", F.to_json(F.struct(diff.alias("checkpoint_diff"))).alias("line"))


def completion_lines(batch: DataFrame, wanted: DataFrame, checkpoint: int, invalid: DataFrame | None = None) -> DataFrame:
    """What follows the data of each priority (priority, line), once all of it is sent: partial_checkpoint_complete, after the last one checkpoint_complete.

    ``batch``: as of ``data_batch``; ``wanted``: bucket, after, priority; ``invalid``: buckets whose data refers to later ops.
    Nothing follows a priority with data left or an invalid bucket, nor those after it.
    """
    left = batch.groupBy("priority").agg(F.max("has_more").alias("more"))
    per = wanted.groupBy("priority").agg(F.count("*").alias("n"))
    per = per.join(left, "priority", "left")
    if invalid is not None:
        bad = wanted.join(invalid.select("bucket"), "bucket", "left_semi").select("priority").distinct().withColumn("bad", F.lit(True))
        per = per.join(bad, "priority", "left")
    else:
        per = per.withColumn("bad", F.lit(False))
    # one row per priority: four at most
    w = Window.orderBy("priority")
    stopped = F.max(F.coalesce("more", F.lit(False)) | F.coalesce("bad", F.lit(False))).over(w)
    rows = per.withColumn("stopped", stopped).withColumn("last", F.lead("priority").over(w).isNull()).filter("not stopped")
    op = F.lit(str(checkpoint)).alias("last_op_id")
    line = F.when(F.col("last"), F.to_json(F.struct(F.struct(op).alias("checkpoint_complete")))).otherwise(F.to_json(F.struct(F.struct(op, "priority").alias("partial_checkpoint_complete"))))
    return rows.select("priority", line.alias("line"))


def until_superseded(batch: DataFrame, newer: bool, after_ops: int = 1000) -> DataFrame:
    """The chunks of a batch that are sent if a newer checkpoint comes in: those that begin before ``after_ops`` ops were sent."""
    if not newer:
        return batch
    chunks = batch.groupBy("priority", "bucket", "chunk").agg(F.count("*").alias("__n"))
    # a batch has a bounded number of ops
    before = F.sum("__n").over(Window.orderBy("priority", "bucket", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    return batch.join(chunks.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < after_ops).drop("__n", "__before"), ["priority", "bucket", "chunk"], "left_semi")


def data_batch(log: DataFrame, wanted: DataFrame, upto: int, limit: int = CHUNK_OPS, chunk_ops: int = CHUNK_OPS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Up to ``limit`` next ops of buckets (bucket, after, priority), by priority, bucket and op, with their chunks.

    Each bucket gives its first ``limit`` ops at most, so that only these are put in the common order. A chunk holds ops of
    one bucket, up to ``chunk_ops`` of them or as many bytes as fit; has_more tells whether ops of the bucket are left.
    """
    ops = log.join(wanted, "bucket").filter((F.col("op_id") > F.col("after")) & (F.col("op_id") <= upto))
    each = Window.partitionBy("bucket").orderBy("op_id")
    # the limit on the rank reaches below the exchange; counts are partial sums
    first = ops.withColumn("rn", F.row_number().over(each)).filter(F.col("rn") <= limit)
    batch = first.orderBy("priority", "bucket", "op_id").limit(limit).join(ops.groupBy("bucket").agg(F.count("*").alias("in_bucket")), "bucket")
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")
    bytes_before = F.sum(size).over(each.rowsBetween(Window.unboundedPreceding, 0)) - size
    chunk = F.greatest(F.floor((F.col("rn") - 1) / chunk_ops), F.floor(bytes_before / chunk_bytes)).cast("bigint")
    sent = F.max("rn").over(Window.partitionBy("bucket"))
    return batch.withColumn("chunk", chunk).withColumn("has_more", F.col("in_bucket") > sent).select("priority", "bucket", "op_id", "op", "object_type", "object_id", "subkey", "data", "checksum", "chunk", "has_more")


def data_lines(batch: DataFrame) -> DataFrame:
    """NDJSON lines of a batch, one per chunk, with where it begins and ends."""
    entry = F.struct(F.col("op_id").cast("string").alias("op_id"), "op", "object_type", "object_id", "subkey", "data", "checksum")
    chunks = batch.groupBy("priority", "bucket", "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("op_id").alias("o"), entry.alias("e")))).alias("es"), F.min("op_id").alias("after"), F.max("op_id").alias("next_after"), F.max("has_more").alias("has_more"))
    data = F.struct(F.struct("bucket", (F.col("after") - 1).cast("string").alias("after"), F.col("next_after").cast("string").alias("next_after"), "has_more", F.transform("es", lambda x: x["e"]).alias("data")).alias("data"))
    return chunks.select("priority", "bucket", "chunk", F.to_json(data).alias("line"))


def checkpoint_line(sums: DataFrame, resolved: DataFrame, checkpoint: int) -> DataFrame:
    """One full checkpoint line per request."""
    joined = resolved.join(sums, "bucket", "left")
    b = F.struct("bucket", F.coalesce("checksum", F.lit(0)).alias("checksum"), F.coalesce("n_ops", F.lit(0)).alias("count"), "priority")
    return joined.groupBy("request_id").agg(F.sort_array(F.collect_list(b)).alias("buckets")).select("request_id", F.to_json(F.struct(F.struct(F.lit(str(checkpoint)).alias("last_op_id"), "buckets").alias("checkpoint"))).alias("line"))


def invalidated(log: DataFrame, checkpoint: int) -> DataFrame:
    """Buckets whose data refers to ops after the checkpoint: no checkpoint_complete may be sent for them."""
    return log.filter(F.col("op_id") <= checkpoint).groupBy("bucket").agg(F.max("target_op").alias("target_op")).filter(F.col("target_op") > checkpoint)


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")).alias("data_bytes"))


def write_checkpoints(writes: DataFrame, lsn: str, custom: bool = False) -> DataFrame:
    """The highest write checkpoint that each user may see: managed ones by log position, custom ones as they are."""
    seen = writes if custom else writes.filter(F.col("lsn") <= F.lit(lsn))
    return seen.groupBy("user_id").agg(F.max("checkpoint").alias("checkpoint"))


def lsn_key(high, low):
    """Both halves of a log position as eight hex digits, so that texts compare like positions."""
    return F.concat(F.lpad(F.upper(high), 8, "0"), F.lit("/"), F.lpad(F.upper(low), 8, "0"))


def may_commit(lsn: str, last_lsn: str | None, no_checkpoint_before: str | None, snapshot_done: bool) -> bool:
    """Whether a commit at a log position makes a checkpoint."""
    return snapshot_done and (last_lsn is None or lsn >= last_lsn) and (no_checkpoint_before is None or lsn >= no_checkpoint_before)


def commits(attempts: DataFrame) -> DataFrame:
    """Which attempts to commit make a checkpoint, one replication stream after another: checkpoint (null: none), resume_lsn.

    ``attempts``: stream, at (order), kind (commit, keepalive), lsn, op_id (last op written), snapshot_done,
    no_checkpoint_before. A commit counts once the snapshot is done, and its lsn is neither below ``no_checkpoint_before`` nor
    below that of an earlier one; its checkpoint is the greatest op so far. A keepalive moves only the place to resume from.
    """
    w = Window.partitionBy("stream").orderBy("at")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    may = F.col("snapshot_done") & (F.col("no_checkpoint_before").isNull() | (F.col("lsn") >= F.col("no_checkpoint_before")))
    rows = attempts.withColumn("__may", may)
    highest = F.max(F.when(F.col("__may"), F.col("lsn"))).over(earlier)
    rows = rows.withColumn("__ok", F.col("__may") & (highest.isNull() | (F.col("lsn") >= highest)))
    rows = rows.withColumn("checkpoint", F.when(F.col("__ok") & (F.col("kind") == "commit"), F.max("op_id").over(upto))).withColumn("resume_lsn", F.max(F.when(F.col("__ok"), F.col("lsn"))).over(upto))
    return rows.drop("__may", "__ok")


def replication_lag(uncommitted: DataFrame, now: Column) -> DataFrame:
    """Per stream, how long its oldest change that no checkpoint has yet is waiting: seconds, 0 without any."""
    return uncommitted.groupBy("stream").agg(F.greatest(F.lit(0.0), F.coalesce(F.unix_micros(now) - F.min(F.unix_micros("changed_at")), F.lit(0)) / 1e6).alias("seconds"))


def token_lines(requests: DataFrame, now: Column) -> DataFrame:
    """What tells a client how many seconds its token still holds: request_id, line."""
    left = F.greatest(F.lit(0), F.floor((F.unix_micros("expires_at") - F.unix_micros(now)) / 1e6)).cast("bigint")
    return requests.select("request_id", F.to_json(F.struct(left.alias("token_expires_in"))).alias("line"))

"""Operation logs: hashes, ops from changes, reduction and compaction, all as aggregates and windows per row key or bucket.

A log has bucket, op_id, op (PUT, REMOVE, MOVE, CLEAR), object_type, object_id, subkey, data, checksum, target_op.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [T.StructField("bucket", T.StringType()), T.StructField("op_id", T.LongType()), T.StructField("op", T.StringType()), T.StructField("object_type", T.StringType()), T.StructField("object_id", T.StringType()), T.StructField("subkey", T.StringType())]
    + [T.StructField("data", T.StringType()), T.StructField("checksum", T.LongType()), T.StructField("target_op", T.LongType())]
)
MAX_ROW_BYTES = 15 * 1024 * 1024


def hash32(text: Column) -> Column:
    """The first four bytes of SHA-256, little-endian, as an unsigned number."""
    h = F.sha2(text.cast("binary"), 256)
    turned = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(turned, 16, 10).cast("bigint")


def put_hash(object_type: Column, object_id: Column, data: Column) -> Column:
    return hash32(F.concat(F.lit("put."), object_type, F.lit("."), object_id, F.lit("."), data))


def remove_hash(subkey: Column) -> Column:
    return hash32(F.concat(F.lit("delete."), subkey))


def wrap32(total: Column) -> Column:
    """A sum as a signed 32-bit number; sums of 64 bits don't overflow below 2^31 ops."""
    return F.call_function("shiftright", F.call_function("shiftleft", total.cast("bigint"), F.lit(32)), F.lit(32))


UUID_TEXT = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Fixed value: the namespace of keys that aren't UUIDs.
KEY_NAMESPACE = "a396dd9109fc4017a28d3df722f651e9"


def subkey_of(table: Column, replica_id: Column) -> Column:
    return F.concat(table, F.lit("/"), replica_id)


def _int32(n: Column) -> Column:
    """Four bytes, the lowest first, as hex digits."""
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def hashed_subkey(table: Column, replica_id: Column) -> Column:
    """The key under which storage holds a row: ``table/id`` for a UUID, else a UUID (version 5) of the BSON document {table, id}, of texts."""

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit("02" + name.encode().hex() + "00"), _int32(F.octet_length(value) + 1), F.hex(value.cast("binary")), F.lit("00"))

    body = F.concat(member("table", table), member("id", replica_id))
    document = F.concat(_int32(F.length(body) / 2 + 5), body, F.lit("00"))
    h = F.sha1(F.unhex(F.concat(F.lit(KEY_NAMESPACE), document)))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(replica_id.rlike(UUID_TEXT), F.concat(table, F.lit("/"), F.lower(replica_id))).otherwise(made)


def row_bytes(df: DataFrame) -> Column:
    """An estimate of each row's size: for every column 12, its name, and 4 for null, 8 for a number, else the value's length."""
    out = F.lit(0)
    for f in df.schema.fields:
        c = df["`" + f.name.replace("`", "``") + "`"]
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            size = F.lit(8)
        elif isinstance(f.dataType, T.BinaryType):
            size = F.octet_length(c)
        else:
            size = F.length(c.cast("string"))
        out = out + 12 + len(f.name) + F.when(c.isNull(), 4).otherwise(size)
    return out.cast("bigint")


def limited(rows: DataFrame, limit: int = MAX_ROW_BYTES) -> DataFrame:
    """Data beyond the limit is nulled and the row is marked."""
    big = F.octet_length("data") > limit
    return rows.withColumn("oversized", F.coalesce(big, F.lit(False))).withColumn("data", F.when(big, F.lit(None)).otherwise(F.col("data")))


def merge_unchanged(changes: DataFrame, state: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that ``changes.unchanged`` (array of names) lists are taken from the stored row; without one the row is incomplete."""
    stored = state.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = changes.join(stored, F.col(key) == F.col("__key"), "left")
    kept = [F.when(F.array_contains("unchanged", F.lit(c)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    complete = (F.size("unchanged") == 0) | F.col("__key").isNotNull()
    return joined.select(*[F.col(c) for c in changes.columns if c not in columns and c != "unchanged"], *kept, complete.alias("complete"))


def changes_to_ops(states: DataFrame, first_op: int = 0) -> DataFrame:
    """Ops of a history of row states.

    ``states``: object_type, object_id, subkey, seq (order of all changes), buckets (array of (bucket, data); empty once a row
    is gone). A row's state becomes a PUT for every bucket it is in, also where nothing changed, and then a REMOVE for each
    bucket that it left. Op ids follow (seq, kind, bucket).
    """
    by_row = Window.partitionBy("subkey").orderBy("seq")
    before = F.coalesce(F.lag("buckets").over(by_row), F.expr("cast(array() as array<struct<bucket:string,data:string>>)"))
    now = F.transform("buckets", lambda b: b["bucket"])
    puts = F.transform("buckets", lambda b: F.struct(F.lit(0).alias("kind"), b["bucket"].alias("bucket"), b["data"].alias("data")))
    gone = F.array_except(F.transform("before", lambda b: b["bucket"]), now)
    removes = F.transform(gone, lambda b: F.struct(F.lit(1).alias("kind"), b.alias("bucket"), F.lit(None).cast("string").alias("data")))
    rows = states.withColumn("before", before).select("object_type", "object_id", "subkey", "seq", F.explode(F.concat(puts, removes)).alias("o")).select("object_type", "object_id", "subkey", "seq", "o.*")
    # numbering passes over its rows twice: what can be made from them is made afterwards
    out = numbered(rows, ["seq", "kind", "bucket", "subkey"], first_op)
    put = F.col("kind") == 0
    return out.select(
        "bucket", F.when(put, "PUT").otherwise("REMOVE").alias("op"), "object_type", "object_id", "subkey", "data",
        F.when(put, put_hash(F.col("object_type"), F.col("object_id"), F.col("data"))).otherwise(remove_hash(F.col("subkey"))).alias("checksum"), F.lit(None).cast("bigint").alias("target_op"), "op_id",
    )


def changes_to_lookups(states: DataFrame, first_id: int = 0) -> DataFrame:
    """Entries of lookups from a history of row states: lookup, source_key, id, outputs.

    ``states``: source_key, seq, lookups (array of (lookup, outputs)). Each lookup that a row gives to gets an entry with its
    outputs; one that it no longer gives to gets an entry without any, which takes the earlier ones back. Ids follow (seq,
    lookup, source_key).
    """
    before = F.coalesce(F.lag("lookups").over(Window.partitionBy("source_key").orderBy("seq")), F.expr("cast(array() as array<struct<lookup:string,outputs:array<string>>>)"))
    rows = states.withColumn("before", before)
    gone = F.array_except(F.transform("before", lambda x: x["lookup"]), F.transform("lookups", lambda x: x["lookup"]))
    empty = F.transform(gone, lambda x: F.struct(x.alias("lookup"), F.expr("cast(array() as array<string>)").alias("outputs")))
    made = rows.select("source_key", "seq", F.explode(F.concat("lookups", empty)).alias("e")).select("source_key", "seq", "e.lookup", "e.outputs")
    return numbered(made, ["seq", "lookup", "source_key"], first_id, "id").select("lookup", "source_key", "id", "outputs")


def flush_groups(changes: DataFrame, order: list[str], size: Column, max_rows: int = 2000, max_bytes: int = 5_000_000) -> DataFrame:
    """Adds ``flush``: which write a change goes into, in a common order; a write takes ``max_rows`` rows, and bytes that fit.

    Rows are numbered first; sums of bytes are taken within stretches of ``max_rows`` numbers, so that no task sees all rows.
    """
    rows = numbered(changes.withColumn("__size", size.cast("bigint")), order, name="__n")
    stretch = F.floor((F.col("__n") - 1) / max_rows)
    before = F.sum("__size").over(Window.partitionBy("__stretch").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    rows = rows.withColumn("__stretch", stretch)
    return rows.withColumn("flush", F.struct(F.col("__stretch").alias("stretch"), F.floor(before / max_bytes).alias("part"))).drop("__size", "__n", "__stretch")


def numbered(rows: DataFrame, order: list[str], first: int = 0, name: str = "op_id") -> DataFrame:
    """Consecutive numbers in a total order, without one task that sees all rows.

    Rows are dealt by ranges of the order; each partition's size is counted, and a row's number is the sizes before its
    partition plus its place in it. ``order`` must tell all rows apart. The counts, one per partition, are all that meets.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    spread = spread.withColumn("__p", F.call_function("shiftright", F.col("__m"), F.lit(33))).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    # a second use must see the same partitions: ranges are cut by sampling
    from weirflow.sources.shared import written

    spread = written(spread.drop("__m"), "numbered")
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"))
    return spread.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__at") + F.col("__i") + F.lit(first + 1)).drop("__p", "__i", "__at")


def truncate_ops(current: DataFrame) -> DataFrame:
    """REMOVE for every row of a table's current buckets: (bucket, object_type, object_id, subkey)."""
    return current.select("bucket", F.lit("REMOVE").alias("op"), "object_type", "object_id", "subkey", F.lit(None).cast("string").alias("data"), remove_hash(F.col("subkey")).alias("checksum"))


def compact_moves(log: DataFrame, max_op: int | None = None) -> DataFrame:
    """An op that a later one for its row supersedes becomes a MOVE to the newest; op_id and checksum stay."""
    seen = F.lit(True) if max_op is None else F.col("op_id") <= max_op
    # ops without a row key stay out of the window: all of a bucket's would share one
    live = F.coalesce(seen & F.col("op").isin("PUT", "REMOVE"), F.lit(False))
    newest = F.max("op_id").over(Window.partitionBy("bucket", "object_type", "object_id", "subkey"))
    rows = log.filter(live).withColumn("__newest", newest)
    old = F.col("__newest") > F.col("op_id")
    made = {c: F.when(old, F.lit(None)).otherwise(F.col(c)) for c in ("object_type", "object_id", "subkey", "data")}
    made |= {"op": F.when(old, "MOVE").otherwise(F.col("op")), "target_op": F.when(old, F.col("__newest")).otherwise(F.col("target_op"))}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in log.columns]).unionByName(log.filter(~live))


def compact_clear(moved: DataFrame, max_op: int | None = None) -> DataFrame:
    """What stands before a bucket's first live PUT becomes one CLEAR, if it is more than one op other than CLEAR.

    The log is read four times, so that it is written first: three times few of its columns, into aggregates by bucket.
    """
    from weirflow.sources.shared import written

    moved = written(moved, "moved")
    seen = F.lit(True) if max_op is None else F.col("op_id") <= max_op
    facts = moved.filter(seen).groupBy("bucket").agg(F.min(F.when(F.col("op") == "PUT", F.col("op_id"))).alias("__first"))
    inside = (F.col("__first").isNull() | (F.col("op_id") < F.col("__first"))) & seen
    marked = moved.join(facts, "bucket", "left").withColumn("__prefix", F.coalesce(inside, F.lit(False)))
    ends = marked.filter("__prefix").groupBy("bucket").agg(F.max(F.when(F.col("op") != "CLEAR", F.col("op_id"))).alias("__end"), F.sum(F.when(F.col("op") != "CLEAR", 1).otherwise(0)).alias("__n"))
    marked = marked.join(ends.filter("__n > 1").drop("__n"), "bucket", "left").withColumn("__in", F.coalesce(F.col("__prefix") & (F.col("op_id") <= F.col("__end")), F.lit(False)))
    clear = marked.filter("__in").groupBy("bucket").agg(F.max("op_id").alias("op_id"), wrap32(F.sum("checksum")).alias("checksum"), F.max("target_op").alias("target_op"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    cleared = clear.select("bucket", "op_id", F.lit("CLEAR").alias("op"), none("object_type"), none("object_id"), none("subkey"), none("data"), "checksum", "target_op")
    return marked.filter(~F.col("__in")).select(*cleared.columns).unionByName(cleared).select(*moved.columns)


def compact(log: DataFrame, max_op: int | None = None) -> DataFrame:
    return compact_clear(compact_moves(log, max_op), max_op)


def reduce_log(log: DataFrame) -> DataFrame:
    """A client's view: each row's last op if it is a PUT, and one CLEAR (op id 0) per bucket with the checksum of all else."""
    clears = log.filter("op = 'CLEAR'").groupBy("bucket").agg(F.max("op_id").alias("__c"))
    since = log.join(clears, "bucket", "left").filter(F.col("__c").isNull() | (F.col("op_id") >= F.col("__c"))).drop("__c")
    rows = since.filter(F.col("op").isin("PUT", "REMOVE"))
    last = F.max("op_id").over(Window.partitionBy("bucket", "object_type", "object_id", "subkey"))
    rows = rows.withColumn("__kept", (F.col("op") == "PUT") & (F.col("op_id") == last))
    marked = rows.unionByName(since.filter(~F.col("op").isin("PUT", "REMOVE")).withColumn("__kept", F.lit(False)))
    residual = marked.groupBy("bucket").agg(wrap32(F.sum(F.when(F.col("__kept"), 0).otherwise(F.col("checksum")))).alias("checksum"))
    none = lambda c, k="string": F.lit(None).cast(k).alias(c)
    clear = residual.select("bucket", F.lit(0).cast("bigint").alias("op_id"), F.lit("CLEAR").alias("op"), none("object_type"), none("object_id"), none("subkey"), none("data"), "checksum", none("target_op", "bigint"))
    return marked.filter("__kept").select(*clear.columns).unionByName(clear)


def compact_parameters(entries: DataFrame) -> DataFrame:
    """Of the entries (lookup, source_key, id, outputs) the last per key, without those that are empty."""
    last = entries.groupBy("lookup", "source_key").agg(F.max_by(F.struct("id", "outputs"), "id").alias("e"))
    return last.select("lookup", "source_key", "e.id", "e.outputs").filter(F.size("outputs") > 0)


def latest_lookups(entries: DataFrame, checkpoint: int) -> DataFrame:
    """What lookups gave as of a checkpoint."""
    return compact_parameters(entries.filter(F.col("id") <= checkpoint))


def touched(log: DataFrame, first_op: int) -> DataFrame:
    """New PUTs of all live rows, as if each had been written again: after a compaction, buckets of many MOVEs are small then."""
    last = F.max("op_id").over(Window.partitionBy("bucket", "object_type", "object_id", "subkey"))
    live = log.filter(F.col("op").isin("PUT", "REMOVE")).withColumn("__last", last).filter("op_id = __last and op = 'PUT'")
    return numbered(live.select("bucket", "op", "object_type", "object_id", "subkey", "data", "checksum", "target_op"), ["bucket", "object_type", "object_id", "subkey"], first_op).select(*log.columns)


def compaction_due(sums: DataFrame, compacted: DataFrame, least_ops: int = 10, least_share: float = 0.1) -> DataFrame:
    """Buckets that are worth compacting: enough ops since the last time, by number and by share.

    ``sums``: bucket, n_ops; ``compacted``: bucket, n_ops as of the last compaction.
    """
    done = compacted.select("bucket", F.col("n_ops").alias("before"))
    both = sums.join(done, "bucket", "left").select("bucket", "n_ops", (F.col("n_ops") - F.coalesce("before", F.lit(0))).cast("bigint").alias("new_ops"))
    return both.filter((F.col("new_ops") >= least_ops) & (F.col("new_ops") >= least_share * F.col("n_ops")))


def chunk_documents(log: DataFrame, max_bytes: int = 1 << 20, span: int = 100_000) -> DataFrame:
    """A log packed into documents of up to ``max_bytes`` of data: bucket, min_op, max_op, n_ops, checksum, data_bytes, ops.

    No document crosses a multiple of ``span`` op ids, so that a bucket of any size is packed side by side.
    """
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")
    rows = log.withColumn("__span", F.floor(F.col("op_id") / span)).withColumn("__size", size)
    before = F.sum("__size").over(Window.partitionBy("bucket", "__span").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    rows = rows.withColumn("__part", F.floor(before / max_bytes))
    op = F.struct("op_id", "op", "object_type", "object_id", "subkey", "data", "checksum", "target_op")
    return rows.groupBy("bucket", "__span", "__part").agg(
        F.min("op_id").alias("min_op"), F.max("op_id").alias("max_op"), F.count("*").alias("n_ops"), wrap32(F.sum("checksum")).alias("checksum"), F.sum("__size").alias("data_bytes"), F.sort_array(F.collect_list(op)).alias("ops")
    ).drop("__span", "__part")


def unpacked(documents: DataFrame) -> DataFrame:
    """The log that documents hold."""
    return documents.select("bucket", F.explode("ops").alias("o")).select("bucket", "o.*")

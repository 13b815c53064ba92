"""Change events of each kind of source as changes of rows, and the states, buckets and lookups that rows go through.

A change has table, seq (text that sorts like the order of changes), kind (insert, update, delete, truncate), key (of the
row after the change, or of the row deleted; null for truncate), old_key (where an update changed the key), row (a struct;
null for delete and truncate) and unchanged (names of columns that the source didn't send). Events are files or streams of
rows; reading them from a server is the business of what writes those files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.evaluate import lookup_sources, source_rows
from weirflow.plans.model import Plan
from weirflow.sources.shared import written
from weirflow.sources.tables import matches

NONE_UNCHANGED = "cast(array() as array<string>)"
IN_BUCKETS = "cast(array() as array<struct<bucket:string,data:string>>)"
IN_LOOKUPS = "cast(array() as array<struct<lookup:string,outputs:array<string>>>)"


def key_text(row: Column, columns: list[str]) -> Column:
    """The key of a row: one column's text, or the texts of several as a JSON array; null where one is null."""
    parts = [row[c].cast("string") for c in columns]
    if len(parts) == 1:
        return parts[0]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.to_json(F.array(*parts)))


def _change(df: DataFrame, table: Column, seq: Column, kind: Column, key: Column, old_key: Column, row: Column, unchanged: Column) -> DataFrame:
    return df.select(table.alias("table"), seq.alias("seq"), kind.alias("kind"), key.alias("key"), old_key.alias("old_key"), row.alias("row"), unchanged.alias("unchanged"))


def _null() -> Column:
    return F.lit(None).cast("string")


# --- the sources


def postgres_changes(events: DataFrame, key: list[str]) -> DataFrame:
    """Logical replication: lsn (hex/hex), place (within the transaction), tag, relation, before, after (structs), unchanged (names).

    ``before`` is there only where the key changed, and for deletes; an update without it is one of the same key.
    """
    high, low = F.substring_index("lsn", "/", 1), F.substring_index("lsn", "/", -1)
    seq = F.concat(F.lpad(F.upper(high), 8, "0"), F.lit("/"), F.lpad(F.upper(low), 8, "0"), F.lit("."), F.lpad(F.col("place").cast("string"), 10, "0"))
    after, before = key_text(F.col("after"), key), key_text(F.col("before"), key)
    kind, deleted = F.lower("tag"), F.lower("tag") == "delete"
    old = F.when((kind == "update") & (before != after), before)
    found = events.filter(kind.isin("insert", "update", "delete", "truncate"))
    return _change(found, F.col("relation"), seq, kind, F.when(deleted, before).otherwise(after), old, F.when(~deleted, F.col("after")), F.coalesce(F.col("unchanged"), F.expr(NONE_UNCHANGED)))


def mysql_changes(events: DataFrame, key: list[str]) -> DataFrame:
    """Row events of a binary log: file, position, event (write, update, delete), table, rows, rows_before (arrays of structs, side by side)."""
    one = events.select("file", "position", "event", "table", F.posexplode(F.arrays_zip(F.col("rows").alias("after"), F.coalesce(F.col("rows_before"), F.col("rows")).alias("before"))).alias("at", "r"))
    # numbers of log files grow in width
    seq = F.concat(F.lpad(F.regexp_extract("file", r"([0-9]+)$", 1), 12, "0"), F.lit(":"), F.lpad(F.col("position").cast("string"), 12, "0"), F.lit("."), F.lpad(F.col("at").cast("string"), 10, "0"))
    after, before = key_text(F.col("r.after"), key), key_text(F.col("r.before"), key)
    kind = F.when(F.col("event") == "write", "insert").otherwise(F.col("event"))
    old = F.when((kind == "update") & (before != after), before)
    return _change(one.filter("event in ('write', 'update', 'delete')"), F.col("table"), seq, kind, after, old, F.when(kind != "delete", F.col("r.after")), F.expr(NONE_UNCHANGED))


def mongodb_changes(events: DataFrame) -> DataFrame:
    """Change-stream documents: clusterTime (seconds, increment), operationType, ns (db, coll), documentKey (_id as text), fullDocument (struct).

    An update whose document is gone by the time it was looked up counts as a delete; dropping or renaming a collection empties it.
    """
    seq = F.concat(F.lpad(F.col("clusterTime.seconds").cast("string"), 12, "0"), F.lit("."), F.lpad(F.col("clusterTime.increment").cast("string"), 10, "0"))
    op = F.col("operationType")
    gone = (op == "delete") | op.isin("update", "replace") & F.col("fullDocument").isNull()
    kind = F.when(op.isin("drop", "rename"), "truncate").when(gone, "delete").when(op == "insert", "insert").otherwise("update")
    found = events.filter(op.isin("insert", "update", "replace", "delete", "drop", "rename"))
    return _change(found, F.col("ns.coll"), seq, kind, F.when(kind != "truncate", F.col("documentKey._id")), _null(), F.when(kind.isin("insert", "update"), F.col("fullDocument")), F.expr(NONE_UNCHANGED))


def mssql_changes(events: DataFrame, key: list[str], table: str) -> DataFrame:
    """Rows of a change table: __$start_lsn, __$seqval (binary), __$operation (1 delete, 2 insert, 3 before an update, 4 after it), the row's columns.

    Rows of one place in the log are told apart by their keys. The two images of an update are those of one key; where an
    update changed the key, images at its place that find no other one of their key are paired in the order of keys.
    """
    data = [f.name for f in events.schema.fields if not f.name.startswith("__$")]
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in data])
    seq = F.concat(F.hex("__$start_lsn"), F.lit(":"), F.hex("__$seqval"))
    op = F.col("__$operation")
    image = F.struct(op.alias("op"), key_text(row, key).alias("key"), row.alias("r"))
    kind = F.when(F.col("i.op").isin(3, 4), "update").when(F.col("i.op") == 2, "insert").otherwise("delete")
    placed = events.select(seq.alias("seq"), image.alias("i")).groupBy("seq", kind.alias("kind")).agg(F.collect_list("i").alias("images"))
    first, last = F.filter("images", lambda i: i["op"] == 3), F.filter("images", lambda i: i["op"] != 3)
    sides = placed.select("seq", "kind", first.alias("first"), last.alias("last"))
    # keys of images that find no other one
    lone = sides.select("*", *[F.array_sort(F.array_except(F.transform(a, lambda i: i["key"]), F.transform(b, lambda i: i["key"]))).alias(n) for a, b, n in (("first", "last", "gone"), ("last", "first", "come"))])
    # a first image that is alone for good stands for its row as it is
    rest = F.when(F.size("gone") > F.size("come"), F.slice("gone", F.size("come") + 1, F.size("gone"))).otherwise(F.slice("gone", 1, 0))
    every = F.when(F.size("gone") > F.size("come"), F.concat("last", F.filter("first", lambda i: F.array_contains(rest, i["key"])))).otherwise(F.col("last"))
    made = lone.select("seq", "kind", "gone", "come", F.explode(every).alias("i"))
    at = F.array_position("come", F.col("i.key"))
    before = F.when((F.size("gone") > 0) & (F.col("kind") == "update") & (F.col("i.op") == 4) & (at > 0), F.try_element_at("gone", at.cast("int")))
    return _change(made, F.lit(table), F.col("seq"), F.col("kind"), F.col("i.key"), before, F.when(F.col("kind") != "delete", F.col("i.r")), F.expr(NONE_UNCHANGED))


def convex_changes(events: DataFrame) -> DataFrame:
    """Delta documents: _table, _ts, _id, _deleted, and the document's columns. A document without _id is passed over."""
    data = [f.name for f in events.schema.fields if f.name not in ("_table", "_ts", "_deleted", "_component")]
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in data])
    deleted = F.coalesce(F.col("_deleted"), F.lit(False))
    return _change(events.filter("_id is not null"), F.col("_table"), F.lpad(F.col("_ts").cast("string"), 20, "0"), F.when(deleted, "delete").otherwise("update"), F.col("_id").cast("string"), _null(), F.when(~deleted, row), F.expr(NONE_UNCHANGED))


#: How events of a source become changes; another source is added under its own name.
SOURCES: dict[str, Callable[..., DataFrame]] = {"postgres": postgres_changes, "mysql": mysql_changes, "mongodb": mongodb_changes, "mssql": mssql_changes, "convex": convex_changes}


def register_source(name: str, changes: Callable[..., DataFrame]) -> None:
    if name in SOURCES:
        raise ValueError(f"There is a source {name} already")
    SOURCES[name] = changes


def snapshot_changes(rows: DataFrame, table: str, key: list[str], seq: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of a snapshot as inserts at one place of the log; rows whose key is ``known`` (key) are passed over, as changes brought them already."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in rows.columns])
    made = rows.select(row.alias("row")).withColumn("key", key_text(F.col("row"), key))
    if known is not None:
        made = made.join(known.select(F.col("key").alias("__known")).distinct(), F.col("key") == F.col("__known"), "left_anti")
    return _change(made, F.lit(table), F.lit(seq), F.lit("insert"), F.col("key"), _null(), F.col("row"), F.expr(NONE_UNCHANGED))


# --- states


def keyed(changes: DataFrame) -> DataFrame:
    """One row per key that a change touches: an update that changed the key deletes the old one first; a truncate deletes each row that is live."""
    plain = changes.filter("kind != 'truncate'")
    moved = plain.filter("old_key is not null")
    first = moved.select("table", F.concat("seq", F.lit("/0")).alias("seq"), F.lit("delete").alias("kind"), F.col("old_key").alias("key"), F.lit(None).cast(changes.schema["row"].dataType).alias("row"), F.expr(NONE_UNCHANGED).alias("unchanged"))
    own = plain.select("table", F.concat("seq", F.lit("/1")).alias("seq"), "kind", "key", "row", "unchanged")
    every = first.unionByName(own)
    cuts = changes.filter("kind = 'truncate'").select("table", F.concat("seq", F.lit("/0")).alias("seq"))
    if cuts.isEmpty():
        return every
    # the first truncate after a change empties its key, if nothing touched the key before
    met = _with_next_cut(every.select("table", "key", "seq", "kind", F.lead("seq").over(Window.partitionBy("table", "key").orderBy("seq")).alias("next")).filter("kind != 'delete'"), cuts.distinct())
    emptied = written(met.filter("cut is not null and (next is null or cut < next)").select("table", "key", "cut"), "emptied")
    return every.unionByName(emptied.select("table", F.col("cut").alias("seq"), F.lit("delete").alias("kind"), "key", F.lit(None).cast(changes.schema["row"].dataType).alias("row"), F.expr(NONE_UNCHANGED).alias("unchanged")))


def _with_next_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (table, key, seq, next) with ``cut``: the first of their table's cuts (table, seq) that is after them, or null.

    Rows and cuts are dealt by ranges of their order, and a window finds the first cut in each range. What is after a range
    is its table's first cut in a later one; of these there is one per table and range.
    """
    both = rows.select("table", "seq", "key", "next", F.lit(False).alias("is_cut")).unionByName(cuts.select("table", "seq", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("next"), F.lit(True).alias("is_cut")))
    # a second use must see the same ranges, which are cut by sampling
    dealt = written(both.repartitionByRange("table", "seq").withColumn("range", F.spark_partition_id()), "cuts")
    at = F.when(F.col("is_cut"), F.col("seq"))
    # backwards, as a frame to the end of a range is summed up anew for each row; no row is at a cut's place: cuts end in /0, rows in /1
    before = (Window.unboundedPreceding, -1)
    after = F.last(at, ignorenulls=True).over(Window.partitionBy("range", "table").orderBy(F.desc("seq")).rowsBetween(*before))
    firsts = dealt.filter("is_cut").groupBy("table", "range").agg(F.min("seq").alias("first"))
    tables = dealt.select("table", "range").distinct().join(firsts, ["table", "range"], "left")
    later = tables.withColumn("later", F.last("first", ignorenulls=True).over(Window.partitionBy("table").orderBy(F.desc("range")).rowsBetween(*before))).drop("first")
    found = dealt.withColumn("after", after).filter("not is_cut").join(F.broadcast(later), ["table", "range"])
    return found.select("table", "key", "seq", "next", F.coalesce("after", "later").alias("cut"))


def _carried(changes: DataFrame, table: str) -> DataFrame:
    """The rows that changes of a table leave, with $seq and $key beside their columns; no * takes those."""
    here = changes.filter((F.col("table") == table) & F.col("row").isNotNull())
    return here.select(F.col("seq").alias("$seq"), F.col("key").alias("$key"), "row.*")


def _tables(plan_tables: list, changes: DataFrame) -> list[str]:
    names = sorted({t.name for t in plan_tables if not t.name.endswith("%")})
    if any(t.name.endswith("%") for t in plan_tables):
        # the tables of a change set are few
        names = sorted({r.table for r in changes.select("table").distinct().collect() if any(matches(t.name, r.table) for t in plan_tables)})
    return names


def row_states(plan: Plan, changes: DataFrame) -> DataFrame:
    """What buckets each row is in after each change, as ``oplog.changes_to_ops`` takes it.

    A row that is known to buckets under several types or ids goes through a history for each.
    """
    each = keyed(changes)
    parts = []
    for name in _tables([e.table for s in plan.streams for b in s.buckets for e in b.evaluators], changes):
        rows = _carried(each, name)
        for s in plan.streams:
            for b in s.buckets:
                for e in b.evaluators:
                    if matches(e.table.name, name):
                        parts.append(source_rows(s, b, e, {name: rows}, typed=False, carry=("$seq", "$key")).withColumn("table", F.lit(name)))
    made = reduce(DataFrame.unionByName, parts).select("table", F.col("$key").alias("key"), F.col("$seq").alias("seq"), "object_type", "object_id", F.struct("bucket", "data").alias("in"))
    held = made.groupBy("table", "key", "seq", "object_type", "object_id").agg(F.sort_array(F.collect_set("in")).alias("buckets"))
    known = held.select("table", "key", "object_type", "object_id").distinct()
    states = each.select("table", "key", "seq").join(known, ["table", "key"]).join(held, ["table", "key", "seq", "object_type", "object_id"], "left")
    return states.select("object_type", "object_id", F.concat("table", F.lit("/"), "key").alias("subkey"), "seq", F.coalesce("buckets", F.expr(IN_BUCKETS)).alias("buckets"))


def lookup_states(plan: Plan, changes: DataFrame) -> DataFrame:
    """What each row gives to lookups after each change: source_key, seq, lookups (array of (lookup, outputs)), as ``oplog.changes_to_lookups`` takes it."""
    each = keyed(changes)
    parts = []
    for name in _tables([k.table for s in plan.streams for b in s.buckets for q in b.queriers for k in q.lookups], changes):
        rows = _carried(each, name)
        parts += [df.withColumn("table", F.lit(name)) for df in lookup_sources(plan, {name: rows}, carry=("$seq", "$key"))]
    made = reduce(DataFrame.unionByName, parts).select("table", F.col("$key").alias("key"), F.col("$seq").alias("seq"), F.concat("lookup", "lookup_key").alias("lookup"), "output")
    outputs = made.groupBy("table", "key", "seq", "lookup").agg(F.sort_array(F.collect_set("output")).alias("outputs"))
    held = outputs.groupBy("table", "key", "seq").agg(F.sort_array(F.collect_list(F.struct("lookup", "outputs"))).alias("lookups"))
    states = each.select("table", "key", "seq").join(held, ["table", "key", "seq"], "left")
    return states.select(F.concat("table", F.lit("/"), "key").alias("source_key"), "seq", F.coalesce("lookups", F.expr(IN_LOOKUPS)).alias("lookups"))


def changes_stream(spark, source: str, path: str, schema: T.StructType, files_per_batch: int = 100, **options) -> DataFrame:
    """The changes of a source's event files, as they arrive."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return SOURCES[source](events, **options)

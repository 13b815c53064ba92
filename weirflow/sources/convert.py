"""Source columns as replicated values: what each kind of source makes of its types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.values import stamp_text

SOURCES = ("generic", "postgres", "mysql", "mssql", "mongodb", "convex")
#: Bookkeeping columns that aren't data.
INTERNAL = {"mssql": ("__$",), "convex": ("_table", "_deleted", "_ts", "_component")}


def postgres_timestamp(text: Column, zoned: bool) -> Column:
    """Text as the server sends it; infinities get the ends of the calendar, what can't be read is null."""
    end = "Z" if zoned else ""
    read = F.try_to_timestamp(text)
    return F.when(text == "infinity", f"9999-12-31T23:59:59{end}").when(text == "-infinity", f"0000-01-01T00:00:00{end}").otherwise(stamp_text(read, zoned))


def _value(c: Column, kind: T.DataType, source: str, iso: bool, digits: int) -> Column | None:
    if isinstance(kind, T.BooleanType):
        return c.cast("bigint")
    if isinstance(kind, T.IntegralType):
        return c.cast("string") if source == "convex" and isinstance(kind, T.LongType) else c.cast("bigint")
    if isinstance(kind, T.DecimalType):
        return c.cast("double") if source == "mssql" else c.cast("string")
    if isinstance(kind, T.FractionalType):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return stamp_text(c, True, iso, digits)
    if isinstance(kind, T.TimestampNTZType):
        return stamp_text(c, source == "mongodb", iso, digits)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c) if source == "convex" else c
    return c.cast("string")


def convert(df: DataFrame, source: str = "generic", iso: bool = True, digits: int | None = None) -> DataFrame:
    """Integers, reals, texts and blobs only. ``digits``: of sub-seconds; by default the source's own."""
    if source not in SOURCES:
        raise ValueError(f"Unknown source {source}")
    own = {"mysql": 3, "mongodb": 3, "mssql": 9}.get(source, 6) if digits is None else digits
    out = []
    for f in df.schema.fields:
        if any(f.name == x or x.endswith("$") and f.name.startswith(x) for x in INTERNAL.get(source, ())):
            continue
        out.append(_value(df["`" + f.name.replace("`", "``") + "`"], f.dataType, source, iso, own).alias(f.name))
    return df.select(*out)


def mongo_extended(raw: Column) -> Column:
    """A value in extended JSON as text: ids as hex, long and decimal numbers as digits, dates as ISO, end keys as null."""
    get = lambda k: F.get_json_object(raw, f"$['{k}']")
    date = get("$date")
    return (
        F.when(get("$minKey").isNotNull() | get("$maxKey").isNotNull(), F.lit(None).cast("string"))
        .when(get("$oid").isNotNull(), get("$oid"))
        .when(get("$uuid").isNotNull(), get("$uuid"))
        .when(get("$numberLong").isNotNull(), get("$numberLong"))
        .when(get("$numberDecimal").isNotNull(), get("$numberDecimal"))
        .when(date.isNotNull(), stamp_text(F.try_to_timestamp(date), True, True, 3))
        .otherwise(raw)
    )


# --- snapshots and changes


def snapshot(spark: SparkSession, url: str, table: str, key: str | None = None, lower: int | None = None, upper: int | None = None, parts: int = 16, **options) -> DataFrame:
    """A table over JDBC: whole, or in ranges of its key that are read side by side and can be read again alone."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def key_chunks(df: DataFrame, key: str, after=None, limit: int = 1000) -> DataFrame:
    """The next rows by key after the last one seen."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(limit)


def resume_key(chunk: DataFrame, key: str):
    """Where a snapshot goes on after a chunk: its greatest key, None once it is empty."""
    return chunk.agg(F.max(key)).first()[0]


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def reconcile(known: dict[str, dict], found: dict[str, dict]) -> dict[str, str]:
    """What to do with each table: keep, snapshot (new, or another identity or replica id), drop."""
    out = {}
    for name in sorted(set(known) | set(found)):
        if name not in found:
            out[name] = "drop"
        elif name not in known:
            out[name] = "snapshot"
        else:
            same = all(known[name].get(k) == found[name].get(k) for k in ("relation_id", "replica_id_columns"))
            out[name] = "keep" if same else "snapshot"
    return out


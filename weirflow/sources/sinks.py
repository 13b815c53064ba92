"""Sinks: op logs, lines, event payloads, client schemas."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.values import Kind, of_column
from weirflow.operators.evaluate import source_rows
from weirflow.plans.model import Plan

PARTS = 64


def append_log(log: DataFrame, path: str, parts: int = PARTS) -> None:
    """Appends ops, partitioned by bucket hash, so that a bucket's ops are read from one partition."""
    log.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts))).repartition("part").sortWithinPartitions("bucket", "op_id").write.mode("append").partitionBy("part").parquet(path)


def read_bucket(spark, path: str, bucket: str, parts: int = PARTS) -> DataFrame:
    """One bucket's ops; only its partition is read."""
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(bucket)), F.lit(parts))).first()[0]
    return spark.read.parquet(path).filter((F.col("part") == part) & (F.col("bucket") == bucket)).drop("part")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def event_payloads(plan: Plan, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of each declared event."""
    out = {}
    for name, streams in plan.events.items():
        parts = [source_rows(s, b, e, tables).drop("bucket", "object_type", "object_id") for s in streams for b in s.buckets for e in b.evaluators]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        out[name] = whole
    return out


def on_events(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls a handler with the payloads of each micro-batch."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)


def client_tables(plan: Plan, tables: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    """Client tables of a plan: column -> text, real or integer. Of several kinds that a column has over the queries, text goes before real before integer."""
    order = [Kind.TEXT, Kind.REAL, Kind.INTEGER]
    found: dict[str, dict[str, Kind]] = {}
    for s in plan.streams:
        for b in s.buckets:
            for e in b.evaluators:
                rows = source_rows(s, b, e, tables)
                columns = found.setdefault(e.table.output or e.table.name, {})
                for f in rows.schema.fields[3:]:
                    kind = of_column(F.col("`" + f.name + "`"), f.dataType).kind
                    kind = kind if kind in order else Kind.TEXT
                    if f.name != "id":
                        columns[f.name] = min(columns.get(f.name, kind), kind, key=order.index)
    return {t: {c: k.name.lower() for c, k in cols.items()} for t, cols in sorted(found.items())}


def camel(name: str, first: bool = False) -> str:
    """Words as one name; ``first``: the first letter is a capital one, too."""
    words = [w for w in re.split(r"[^0-9A-Za-z]+", name) if w]
    joined = "".join(w[:1].upper() + w[1:] for w in words)
    return joined if first else joined[:1].lower() + joined[1:]


@dataclass(frozen=True)
class Language:
    """How a language writes tables: text around all of them, around one, and a column; {t}, {T}: the table, {c}, {C}: the column, {k}: its type."""

    start: str
    end: str
    between: str
    table: str
    table_end: str
    column: str
    columns_between: str
    kinds: dict[str, str]


_OWN = {"text": "text", "real": "real", "integer": "integer"}
_CAPITALS = {"text": "TEXT", "real": "REAL", "integer": "INTEGER"}
#: The formats of client schemas.
LANGUAGES = {
    "sql": Language("", "", "\n", "CREATE TABLE {t} (id TEXT PRIMARY KEY", ");", ", {c} {k}", "", _CAPITALS),
    "typescript": Language("", "", "\n", "export interface {t} {{ id: string;", " }}", " {c}: {k} | null;", "", {"text": "string", "real": "number", "integer": "number"}),
    "js": Language("", "", "\n", "const {t} = new Table({{", " }});", " {c}: column.{k}", ",", _OWN),
    "jsLegacy": Language("new Schema([", "])", ", ", "new Table({{ name: '{t}', columns: [", "] }})", "new Column({{ name: '{c}', type: ColumnType.{k} }})", ", ", _CAPITALS),
    "dart": Language("Schema([", "]);", ", ", "Table('{t}', [", "])", "Column.{k}('{c}')", ", ", _OWN),
    "kotlin": Language("val schema = Schema(", ")", ", ", 'Table(name = "{t}", columns = listOf(', "))", 'Column.{k}("{c}")', ", ", _OWN),
    "kotlin-room": Language("", "", "\n", '@Entity(tableName = "{t}") data class {T}(@PrimaryKey val id: String', ")", ', @ColumnInfo("{c}") val {C}: {k}', "", {"text": "String", "real": "Double", "integer": "Long"}),
    "swift": Language("let schema = Schema(", ")", ", ", 'Table(name: "{t}", columns: [', "])", '.{k}("{c}")', ", ", _OWN),
    "dotnet": Language("", "", "\n", 'public static Table {T} = new Table {{ Name = "{t}", Columns = {{', " }} }};", ' ["{c}"] = ColumnType.{k}', ",", {"text": "Text", "real": "Real", "integer": "Integer"}),
}


def client_schema(plan: Plan, tables: dict[str, DataFrame], language: str = "sql") -> str:
    """Client tables of a plan, as a language writes them."""
    if language not in LANGUAGES:
        raise ValueError(f"No generator for {language}")
    g = LANGUAGES[language]
    made = []
    for t, columns in client_tables(plan, tables).items():
        names = {"t": t, "T": camel(t, True)}
        made.append(g.table.format(**names) + g.columns_between.join(g.column.format(c=c, C=camel(c), k=g.kinds[k]) for c, k in columns.items()) + g.table_end.format())
    return g.start + g.between.join(made) + g.end

"""Tables by exact name or pattern, with the metadata columns of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.model import Table


def matches(pattern: str | None, name: str) -> bool:
    if pattern is None:
        return True
    return name.startswith(pattern[:-1]) if pattern.endswith("%") else name == pattern


def matching(tables: dict[str, DataFrame], table: Table) -> list[tuple[str, str, DataFrame]]:
    """(schema, name, rows) of what a pattern covers. Keys are names or ``schema.name``; without a schema: public."""
    out = []
    for key, df in sorted(tables.items()):
        schema, dot, name = key.rpartition(".")
        if matches(table.name, name) and matches(table.schema, schema if dot else "public"):
            out.append((schema if dot else "public", name, df))
    return out


def scan(tables: dict[str, DataFrame], table: Table) -> DataFrame:
    """Rows of the matching tables; columns are called ``alias|name``, and $schema, $table_name, $table_suffix are added."""
    found = matching(tables, table)
    if not found:
        raise KeyError(f"No table matches {table.schema + '.' if table.schema else ''}{table.name}")
    prefix = table.name[:-1] if table.name.endswith("%") else table.name
    parts = []
    for schema, name, df in found:
        marks = {"$schema": schema, "$table_name": name, "$table_suffix": name[len(prefix) :]}
        if table.name.endswith("%"):
            marks["_table_suffix"] = marks["$table_suffix"]
        parts.append(df.select(*[df["`" + c.replace("`", "``") + "`"].alias(f"{table.alias}|{c}") for c in df.columns], *[F.lit(v).alias(f"{table.alias}|{k}") for k, v in marks.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def parquet_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}

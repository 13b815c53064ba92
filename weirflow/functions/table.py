"""Table-valued functions: name -> (text of the argument -> array of (key, value), both JSON text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def elements(doc: Column) -> Column:
    """The members of a JSON document as an array of (key, value), each JSON text; a scalar is one member without key."""
    first = F.substring(F.ltrim(doc), 1, 1)
    of_array = F.transform(F.from_json(doc, "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), F.coalesce(F.to_json(v), F.lit("null")).alias("value")))
    of_object = F.transform(F.map_entries(F.from_json(doc, "map<string,variant>")), lambda e: F.struct(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2).alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    return F.when(first == "[", of_array).when(first == "{", of_object).when(doc.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("key"), doc.alias("value"))))


TABLE_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"json_each": elements}


def register_table_function(name: str, function: Callable[[Column], Column]) -> None:
    """Adds a table-valued function of one argument, whose rows have the columns key and value."""
    if name in TABLE_FUNCTIONS:
        raise ValueError(f"There is a table-valued function {name} already")
    TABLE_FUNCTIONS[name] = function

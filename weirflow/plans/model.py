"""Plans: what a definition compiles to. All parts are plain values and can be written as JSON."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

REQUEST = "@request"


@dataclass(frozen=True)
class Table:
    """A table in a FROM list; name and schema may end in % (any suffix)."""

    alias: str
    name: str
    schema: str | None = None
    output: str | None = None  # fixed output name; None: the physical table's


@dataclass(frozen=True)
class Each:
    """A table-valued function over an expression of one table or of the request."""

    alias: str
    of: str
    expr: object
    function: str = "json_each"


@dataclass(frozen=True)
class Evaluator:
    """Rows of a table into one kind of bucket."""

    table: Table
    each: tuple[Each, ...]
    filters: tuple
    items: tuple
    keys: tuple


@dataclass(frozen=True)
class Lookup:
    """Another table that decides on buckets: its filters, the expressions it is found by, and those it gives."""

    table: Table
    each: tuple[Each, ...]
    filters: tuple
    inputs: tuple
    outputs: tuple


@dataclass(frozen=True)
class Querier:
    """Which buckets a request may read: filters on the request, joins of lookups, and an expression per bucket key."""

    filters: tuple
    each: tuple[Each, ...]
    lookups: tuple[Lookup, ...]
    joins: tuple[tuple[object, object], ...]
    values: tuple
    #: Of the buckets it leads to; None: the stream's.
    priority: int | None = None


@dataclass
class Bucket:
    prefix: str
    evaluators: list[Evaluator] = field(default_factory=list)
    queriers: list[Querier] = field(default_factory=list)


@dataclass
class Stream:
    name: str
    buckets: list[Bucket] = field(default_factory=list)
    auto_subscribe: bool = False
    priority: int = 3
    warnings: list[str] = field(default_factory=list)
    fixed_json: bool = True
    semantics: str = "js"
    #: Editions below 3: '*' leaves out names with a leading underscore and doesn't overwrite.
    legacy_star: bool = False
    #: Time stamps with a T or a space, and the most digits of their fractions; row types as JSON or in their database's text form.
    iso: bool = True
    digits: int | None = None
    custom_types: bool = True


@dataclass
class Plan:
    edition: int
    streams: list[Stream] = field(default_factory=list)
    events: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)


def as_json(x):
    """A plan as JSON values, for storing and comparing."""
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {"type": type(x).__name__} | {f.name: as_json(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, (list, tuple)):
        return [as_json(v) for v in x]
    if isinstance(x, dict):
        return {k: as_json(v) for k, v in x.items()}
    return x

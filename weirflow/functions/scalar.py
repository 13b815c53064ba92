"""The scalar functions of stream definitions, as name -> (values -> value), over Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.values import NULL, Kind, Val, as_blob, as_integer, as_real, as_text, blob, choose, condition, integer, let, null_of, of_json, once, real, text, truthy


_COLLECTORS: list[list[tuple[Column, str]]] = []


@contextmanager
def collected():
    """Inside, what makes a value an error is collected as (condition, message), and the value is null."""
    found: list[tuple[Column, str]] = []
    _COLLECTORS.append(found)
    try:
        yield found
    finally:
        _COLLECTORS.pop()


def failing(bad: Column, message: str, value: Column, kind: str) -> Column:
    """``value``, but an error where ``bad`` holds."""
    if _COLLECTORS:
        _COLLECTORS[-1].append((F.coalesce(bad, F.lit(False)), message))
        return F.when(~F.coalesce(bad, F.lit(False)), value)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def failing_null(bad: Column, message: str, value: Column, kind: str) -> Column:
    """``failing`` for a value that is null anyway where ``bad`` holds."""
    if _COLLECTORS:
        _COLLECTORS[-1].append((F.coalesce(bad, F.lit(False)), message))
        return value
    return failing(bad, message, value, kind)


def upper(x: Val) -> Val:
    return text(F.upper(as_text(x)))


def lower(x: Val) -> Val:
    return text(F.lower(as_text(x)))


def substring(x: Val, start: Val = NULL, length: Val | None = None) -> Val:
    """1-based; start 0 takes one off the length; a negative start counts from the end, a negative length goes back from it."""
    s, at = as_text(x), as_integer(start)
    size = F.length(s).cast("bigint")
    n = as_integer(length) if length is not None else F.lit(1 << 40).cast("bigint")
    # the half-open stretch [a, b) of 0-based places
    first = F.when(at > 0, at - 1).when(at < 0, size + at).otherwise(F.lit(-1).cast("bigint"))
    a, b = F.when(n >= 0, first).otherwise(F.when(at == 0, 0).otherwise(first) + n), F.when(n >= 0, first + n).otherwise(F.when(at == 0, 0).otherwise(first))
    a, b = F.greatest(a, F.lit(0).cast("bigint")), F.least(F.greatest(b, F.lit(0).cast("bigint")), size)
    out = F.when(b > a, F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    return text(F.when(s.isNotNull() & at.isNotNull() & n.isNotNull(), out))


def hex_(x: Val) -> Val:
    return text(F.coalesce(F.hex(as_blob(x)), F.lit("")))


def length(x: Val) -> Val:
    if x.kind == Kind.BLOB:
        return integer(F.octet_length(x.col).cast("bigint"))
    if x.parts:
        return integer(F.when(x.parts["tag"] == int(Kind.BLOB), F.octet_length(x.parts["b"])).otherwise(F.length(as_text(x))).cast("bigint"))
    return integer(F.length(as_text(x)).cast("bigint"))


def base64(x: Val) -> Val:
    return text(F.coalesce(F.regexp_replace(F.base64(as_blob(x)), r"\s", ""), F.lit("")))


def uuid_blob(x: Val) -> Val:
    """16 bytes; a text that is no UUID makes the row an error."""
    s = as_text(x)
    good = s.rlike("^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$")
    return blob(failing(~good, "Cannot parse UUID", F.when(good, F.unhex(F.replace(s, F.lit("-"), F.lit("")))), "binary"))


def typeof(x: Val) -> Val:
    if x.parts:
        t = x.parts["tag"]
        return text(F.when(t == 4, "integer").when(t == 8, "real").when(t == 2, "text").when(t == 1, "blob").otherwise("null"))
    if x.kind == Kind.NONE:
        return text(F.lit("null"))
    return text(F.when(x.col.isNull(), "null").otherwise({Kind.INTEGER: "integer", Kind.REAL: "real", Kind.TEXT: "text", Kind.BLOB: "blob"}[x.kind]))


def ifnull(x: Val, y: Val) -> Val:
    return choose([(~x.is_null(), x)], y)


def iif(c: Val, a: Val, b: Val) -> Val:
    return choose([(truthy(c), a)], b)


def instr(x: Val, y: Val) -> Val:
    if x.kind == y.kind == Kind.BLOB:
        # two hex digits a byte: a match counts from an odd place
        hx, hy = F.hex(x.col), F.hex(y.col)
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(hx) - F.length(hy) + 1, F.lit(1)), F.lit(2)), lambda k: F.substring(hx, k, F.length(hy)) == hy)
        return integer(F.when(hx.isNotNull() & hy.isNotNull(), F.coalesce(F.floor((F.try_element_at(places, F.lit(1)) + 1) / 2), F.lit(0))).cast("bigint"))
    s, t = as_text(x), as_text(y)
    return integer(F.when(s.isNotNull() & t.isNotNull(), F.call_function("locate", t, s)).cast("bigint"))


def _path(path: str, arrow: bool) -> str:
    """Keys divided by dots, an array's places among them; without ``$`` in front, an operator's right side is one key."""
    if path == "$":
        return ""
    if path.startswith("$."):
        keys = path[2:].split(".")
    elif arrow:
        keys = [path]
    else:
        raise ValueError("JSON path must start with $.")
    return "".join(f"[{k}]" if k.isdigit() else "['" + k.replace("'", "\\'") + "']" for k in keys)


def json_get(j: Val, path: str | int, op: str, fixed: bool = True, checked: bool = True) -> Val:
    """``op``: '->' gives JSON text, '->>' and 'json_extract' a value. ``fixed``: a JSON null is null (null as text for '->').

    ``checked``: a text that is no JSON makes the row an error.
    """
    arrow = op != "json_extract"
    steps = f"[{path}]" if isinstance(path, int) else _path(path, arrow)
    doc = as_text(j)
    # under a wildcard Spark leaves strings quoted, which tells their type
    raw = F.get_json_object(F.concat(F.lit("["), doc, F.lit("]")), "$[*]" + steps) if steps else doc
    if isinstance(path, str) and path != "$" and any(k.isdigit() for k in (path[2:] if path.startswith("$.") else path).split(".")):
        named = "".join("['" + k + "']" for k in (path[2:].split(".") if path.startswith("$.") else [path]))
        raw = F.coalesce(raw, F.get_json_object(F.concat(F.lit("["), doc, F.lit("]")), "$[*]" + named))
    raw = once(raw)
    absent = raw.isNull()
    if checked and steps:
        raw = failing_null(absent & doc.isNotNull() & F.try_parse_json(doc).isNull(), "Invalid JSON", raw, "string")
    holds_null = F.lit(False) if not steps else absent & _has_null(doc, steps)
    if op == "->":
        return text(F.when(holds_null, F.lit("null") if fixed else null_of("string")).otherwise(raw))
    value = of_json(raw)
    if fixed:
        return value
    return choose([(holds_null, text(F.lit("null")))], value)


def _has_null(doc: Column, steps: str) -> Column:
    """Whether the last step of a path names a member that is JSON null."""
    head, _, last = steps.rpartition("[")
    holder = F.get_json_object(doc, "$" + head) if head else doc
    key = last.rstrip("]").strip("'")
    if last.startswith("'"):
        return F.coalesce(F.array_contains(F.json_object_keys(holder), key), F.lit(False))
    return F.coalesce(F.json_array_length(holder) > int(key), F.lit(False))


def json_extract(j: Val, path: str, fixed: bool = True) -> Val:
    return json_get(j, path, "json_extract", fixed)


def json_array_length(j: Val, path: str | None = None) -> Val:
    part = as_text(j) if path in (None, "$") else json_get(j, path, "json_extract").parts["s"]
    return integer(F.when(part.isNotNull(), F.coalesce(F.json_array_length(part), F.lit(0))).cast("bigint"))


def json_valid(x: Val) -> Val:
    return condition(F.coalesce(F.try_parse_json(as_text(x)).isNotNull(), F.lit(False)))


def json_keys(x: Val) -> Val:
    """Keys that are whole numbers first, by value, then the others in their order; arrays, scalars and repeated keys are errors."""
    s = as_text(x)
    keys = F.json_object_keys(s)
    numbers = F.transform(F.array_sort(F.transform(F.filter(keys, lambda k: k.rlike("^(0|[1-9][0-9]{0,9})$")), lambda k: k.cast("bigint"))), lambda k: k.cast("string"))
    out = F.to_json(F.concat(numbers, F.filter(keys, lambda k: ~k.rlike("^(0|[1-9][0-9]{0,9})$"))))
    good = F.try_parse_json(s).isNotNull() & F.ltrim(s).startswith("{")
    return text(failing(s.isNotNull() & ~good, "json_keys is not applicable to this value", F.when(good, out), "string"))


#: date, then optionally a time with optional seconds and fraction, then optionally a full zone
_ISO = r"^(-?[0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def _millis(x: Val, modifiers: tuple[str, ...]) -> tuple[Column, bool]:
    """Milliseconds since 1970 and whether fractions are wanted; null for what isn't supported."""
    subsec = any(m in ("subsec", "subsecond") for m in modifiers)
    if any(m not in ("subsec", "subsecond", "unixepoch") for m in modifiers):
        return null_of("bigint"), subsec
    number = as_real(x)
    s = as_text(x)
    numeric = s.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$")
    if "unixepoch" in modifiers:
        of_number = F.floor(number * 1000 + 0.0000001)
    else:
        of_number = F.floor((number - 2440587.5) * 86400000.0 + 0.5)
    if x.stamp is not None:
        # exact: the rest is taken off first
        return F.call_function("div", x.stamp - F.pmod(x.stamp, F.lit(1000)), F.lit(1000)).cast("bigint"), subsec
    part = lambda k: F.regexp_extract(s, _ISO, k)

    def clock(t: Column) -> Column:
        return F.when(t == "", 0).otherwise(F.substring(t, 1, 2).try_cast("int") * 3600 + F.substring(t, 4, 2).try_cast("int") * 60)

    def shift(z: Column) -> Column:
        return F.when(z.isin("", "Z"), 0).otherwise((F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 5, 2).try_cast("int") * 60) * F.when(z.startswith("-"), -1).otherwise(1))

    day = F.unix_date(part(1).try_cast("date")).cast("bigint")
    fraction = F.coalesce(F.substring(F.rpad(F.substring(part(4), 2, 3), 3, "0"), 1, 3).try_cast("bigint"), F.lit(0).cast("bigint"))
    seconds = day * 86400 + let(part(2), clock) + F.coalesce(part(3).try_cast("int"), F.lit(0)) - let(part(5), shift)
    of_text = F.when(s.rlike(_ISO), seconds * 1000 + fraction)
    if x.kind in (Kind.INTEGER, Kind.REAL):
        return of_number.cast("bigint"), subsec
    return F.when(numeric, of_number.cast("bigint")).otherwise(of_text), subsec


def unixepoch(x: Val = NULL, *modifiers: str) -> Val:
    ms, subsec = _millis(x, modifiers)
    return real(ms / 1000.0) if subsec else integer(F.floor(ms / 1000.0).cast("bigint"))


def datetime(x: Val = NULL, *modifiers: str) -> Val:
    """UTC as text; the calendar is the proleptic Gregorian one, with years before 0 signed."""
    ms, subsec = _millis(x, modifiers)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def clock(s: Column) -> Column:
        out = F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(F.floor(s) % 60))
        return F.concat(out, F.lit("."), F.lpad((F.floor(s * 1000 + 0.5) % 1000).cast("string"), 3, "0")) if subsec else out

    def at(m: Column) -> Column:
        day = F.floor(m / 86400000.0)
        return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit(" "), let((m - day * 86400000) / 1000.0, clock))

    return text(let(ms, at))


def _geo(name: str) -> Callable[[Val], Val]:
    def call(x: Val) -> Val:
        from weirflow.functions import geo

        raw = x.col if x.kind == Kind.BLOB else F.expr("cast(null as binary)") if x.kind == Kind.NONE else F.try_to_binary(as_text(x), F.lit("hex"))
        return getattr(geo, name)(raw)

    return call


#: name -> (function, fewest arguments, most, places of arguments that must be literals)
FUNCTIONS: dict[str, tuple[Callable, int, int, frozenset[int]]] = {
    "upper": (upper, 1, 1, frozenset()),
    "lower": (lower, 1, 1, frozenset()),
    "substring": (substring, 1, 3, frozenset()),
    "substr": (substring, 1, 3, frozenset()),
    "hex": (hex_, 1, 1, frozenset()),
    "length": (length, 1, 1, frozenset()),
    "base64": (base64, 1, 1, frozenset()),
    "uuid_blob": (uuid_blob, 1, 1, frozenset()),
    "typeof": (typeof, 1, 1, frozenset()),
    "ifnull": (ifnull, 2, 2, frozenset()),
    "iif": (iif, 3, 3, frozenset()),
    "instr": (instr, 2, 2, frozenset()),
    "json_extract": (json_extract, 2, 2, frozenset({1})),
    "json_array_length": (json_array_length, 1, 2, frozenset({1})),
    "json_valid": (json_valid, 1, 1, frozenset()),
    "json_keys": (json_keys, 1, 1, frozenset()),
    "unixepoch": (unixepoch, 0, 3, frozenset({1, 2})),
    "datetime": (datetime, 0, 3, frozenset({1, 2})),
    "st_asgeojson": (_geo("as_geojson"), 1, 1, frozenset()),
    "st_astext": (_geo("as_wkt"), 1, 1, frozenset()),
    "st_x": (_geo("x_of"), 1, 1, frozenset()),
    "st_y": (_geo("y_of"), 1, 1, frozenset()),
}


def register_function(name: str, function: Callable[..., Val], least: int = 1, most: int | None = None, literals: tuple[int, ...] = ()) -> None:
    """Adds a scalar function to the language: values to a value, over Spark expressions. ``literals``: places of arguments that must be literals."""
    if name in FUNCTIONS:
        raise ValueError(f"There is a function {name} already")
    FUNCTIONS[name.lower()] = (function, least, least if most is None else most, frozenset(literals))

"""Dynamically typed values on statically typed columns.

A value is null, integer, real, text or blob. Where a column's type is known, a ``Val`` holds that one column and its kind,
and expressions stay plain Spark expressions. Where a cell's type is only known at run time (what JSON holds, casts to
numeric), the kind is ``any`` and the value is held in parts: a tag and one column per kind.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import IntFlag
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(IntFlag):
    """Type flags; unions of them describe what a cell may hold."""

    NONE = 0
    BLOB = 1
    TEXT = 2
    INTEGER = 4
    REAL = 8
    NUMERIC = 12
    ANY = 15


NAMES = {Kind.NONE: "null", Kind.BLOB: "blob", Kind.TEXT: "text", Kind.INTEGER: "integer", Kind.REAL: "real"}
#: Casts never fail: what is numeric about a text is its prefix.
INT_PREFIX, NUM_PREFIX = r"^\s*([+-]?[0-9]+)", r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Val:
    kind: Kind
    col: Column | None = None
    parts: dict[str, Column] = field(default_factory=dict)
    #: The same as a boolean, for values that are conditions; filters on it can be pushed down.
    cond: Column | None = None
    #: JSON text that the value was read from.
    json: Column | None = None
    #: Microseconds since 1970, for texts that are time stamps.
    stamp: Column | None = None

    def any(self) -> Val:
        """The same value in parts: tag (a Kind or 0), i, r, s, b."""
        if self.parts:
            return self
        k = self.kind
        tag = F.lit(0) if k == Kind.NONE else F.when(self.col.isNotNull(), int(k)).otherwise(0)
        return Val(
            Kind.ANY,
            parts={
                "tag": tag,
                "i": self.col if k == Kind.INTEGER else null_of("bigint"),
                "r": self.col if k == Kind.REAL else null_of("double"),
                "s": self.col if k == Kind.TEXT else null_of("string"),
                "b": self.col if k == Kind.BLOB else null_of("binary"),
            },
        )

    def is_null(self) -> Column:
        if self.kind == Kind.NONE:
            return F.lit(True)
        return self.parts["tag"] == 0 if self.parts else self.col.isNull()


NULL = Val(Kind.NONE)


def integer(c: Column) -> Val:
    return Val(Kind.INTEGER, c)


def real(c: Column) -> Val:
    return Val(Kind.REAL, c)


def text(c: Column) -> Val:
    return Val(Kind.TEXT, c)


def blob(c: Column) -> Val:
    return Val(Kind.BLOB, c)


def condition(c: Column) -> Val:
    return Val(Kind.INTEGER, c.cast("bigint"), cond=c)


def literal(x) -> Val:
    if x is None:
        return NULL
    if isinstance(x, bool):
        return condition(F.lit(x))
    if isinstance(x, int):
        return integer(F.lit(x).cast("bigint"))
    if isinstance(x, float):
        return real(F.lit(x))
    if isinstance(x, (bytes, bytearray)):
        return blob(F.lit(bytes(x)))
    return text(F.lit(x))


def stamp_text(c: Column, zoned: bool, iso: bool = True, digits: int = 6) -> Column:
    """A time stamp as text; fractions are padded or cut to ``digits``, never rounded."""
    fraction = "." + "S" * digits if digits else ""
    return F.date_format(c, ("yyyy-MM-dd'T'HH:mm:ss" if iso else "yyyy-MM-dd HH:mm:ss") + fraction + ("'Z'" if zoned else ""))


def composite_text(c: Column, kind: T.StructType) -> Column:
    """A row type in the text form of its database: (a,b), nulls empty, what needs it in quotes."""

    def member(f: T.StructField) -> Column:
        x = c[f.name]
        if isinstance(f.dataType, T.StructType):
            raw = composite_text(x, f.dataType)
        elif isinstance(f.dataType, T.BooleanType):
            raw = F.when(x, "t").when(~x, "f")
        else:
            raw = x.cast("string")
        doubled = F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
        return F.when(raw.isNull(), "").when(raw.rlike(r'[",()\\\s]|^$'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(raw)

    return F.when(c.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *[member(f) for f in kind.fields]), F.lit(")")))


def of_column(c: Column, kind: T.DataType, iso: bool = True, digits: int | None = None, custom_types: bool = True) -> Val:
    """A source column as the value that replication makes of it. ``digits``: the most that a time stamp's fraction has."""
    if isinstance(kind, T.BooleanType):
        return condition(c)
    if isinstance(kind, T.IntegralType):
        return integer(c.cast("bigint"))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return real(c.cast("double"))
    if isinstance(kind, T.BinaryType):
        return blob(c)
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zoned, most = isinstance(kind, T.TimestampType), 6 if digits is None else min(6, digits)
        micros = F.unix_micros(c) if zoned else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
        micros = micros - F.pmod(micros, F.lit(10 ** (6 - most))) if most < 6 else micros
        return Val(Kind.TEXT, stamp_text(c, zoned, iso, most), stamp=micros)
    if isinstance(kind, T.StructType) and not custom_types:
        return text(composite_text(c, kind))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return text(F.to_json(c))
    if isinstance(kind, T.VariantType):
        return text(F.to_json(c))
    return text(c.cast("string"))


_HOISTS: list[dict[str, tuple[str, Column]]] = []
_NUMBERS = count()


@contextmanager
def hoisting():
    """Inside, what ``once`` is given is collected, as (name, column) by its text, in the order in which columns may need others."""
    found: dict[str, tuple[str, Column]] = {}
    _HOISTS.append(found)
    try:
        yield found
    finally:
        _HOISTS.pop()


def once(x: Column) -> Column:
    """A column that a frame computes once per row, however many expressions use it; outside of ``hoisting``, the column itself."""
    if not _HOISTS:
        return x
    # without where in the program it was written
    name, _ = _HOISTS[-1].setdefault(x._jc.node().normalized().toString(), (f"__once{next(_NUMBERS)}", x))
    return F.col(name)


def let(x: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it; keeps generated code small."""
    return F.element_at(F.transform(F.array(x), f), 1)


def real_text(x: Column) -> Column:
    """A double as text: the shortest digits, plain from 1e-6 up to below 1e21, else with an exponent."""

    def parts(raw: Column) -> Column:
        mantissa = F.regexp_extract(raw, r"([0-9.]+)", 1)
        e = F.coalesce(F.regexp_extract(raw, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
        whole, frac = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
        short = F.regexp_replace(frac, "^0+", "")
        digits = F.regexp_replace(F.when(whole == "0", short).otherwise(F.concat(whole, frac)), "(?<=.)0+$", "")
        n = F.when(whole == "0", e - F.length(frac) + F.length(short)).otherwise(F.length(whole) + e)
        return F.struct(F.when(raw.startswith("-"), "-").otherwise("").alias("sign"), digits.alias("d"), n.alias("n"), F.length(digits).alias("k"))

    def join(p: Column) -> Column:
        d, n, k = p["d"], p["n"], p["k"]
        sci = F.concat(F.substring(d, F.lit(1), F.lit(1)), F.when(k > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), k))).otherwise(""), F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string"))
        plain = (
            F.when((k <= n) & (n <= 21), F.rpad(d, n, "0"))
            .when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
            .otherwise(sci)
        )
        return F.concat(p["sign"], plain)

    def whole(raw: Column) -> Column:
        return F.when(raw.isNull(), raw).when(raw.rlike(r"^-?0\.0$"), "0").when(raw.rlike("[a-z]"), raw).otherwise(let(parts(raw), join))

    def shortest(raw: Column) -> Column:
        # older Java versions write some numbers with one digit more than needed
        short = F.replace(F.format_string("%.15E", x), F.lit("E+"), F.lit("E"))
        return F.when((F.length(raw) > 17) & (short.try_cast("double") == x), short).otherwise(raw)

    return let(let(x.cast("string"), shortest), whole)


def json_real(x: Column) -> Column:
    """A double inside JSON: integral ones keep a fraction, so that they stay real."""
    return let(real_text(x), lambda t: F.when(t.rlike("^-?[0-9]+$"), F.concat(t, F.lit(".0"))).when(t.rlike("[IN]"), "null").otherwise(t))


def json_string(s: Column) -> Column:
    packed = F.to_json(F.array(s))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def as_text(v: Val) -> Column:
    if v.parts:
        p = v.parts
        tag = p["tag"]
        return F.when(tag == int(Kind.INTEGER), p["i"].cast("string")).when(tag == int(Kind.REAL), real_text(p["r"])).when(tag == int(Kind.TEXT), p["s"]).when(tag == int(Kind.BLOB), p["b"].cast("string"))
    if v.kind == Kind.NONE:
        return null_of("string")
    if v.kind == Kind.REAL:
        return real_text(v.col)
    return v.col if v.kind == Kind.TEXT else v.col.cast("string")


def as_json(v: Val, keys: bool = False) -> Column:
    """JSON text. As a key, an integral real prints like the integer of the same value."""

    def number(x: Column) -> Column:
        return real_text(x) if keys else json_real(x)

    if v.json is not None:
        # a fragment is its own JSON, but for booleans, reals in keys and escapes
        def plain(raw: Column) -> Column:
            out = F.when(raw == "true", "1").when(raw == "false", "0").when(raw.contains("\\"), json_string(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")))
            if keys:
                out = out.when(raw.rlike("^-?[0-9][0-9.eE+-]*[.eE]"), real_text(raw.try_cast("double"))).when(raw.rlike(r"^[{\[]"), json_string(raw))
            else:
                out = out.when(raw.rlike(r"^[{\[]"), json_string(raw))
            return F.coalesce(out.otherwise(raw), F.lit("null"))

        return let(F.trim(v.json), plain)
    if v.parts:
        p = v.parts
        tag = p["tag"]
        out = F.when(tag == int(Kind.INTEGER), p["i"].cast("string")).when(tag == int(Kind.REAL), number(p["r"])).when(tag == int(Kind.TEXT), json_string(p["s"]))
        return F.coalesce(out, F.lit("null"))
    if v.kind in (Kind.NONE, Kind.BLOB):
        return F.lit("null")
    made = {Kind.REAL: number, Kind.TEXT: json_string}.get(v.kind, lambda c: c.cast("string"))(v.col)
    return F.coalesce(made, F.lit("null"))


def of_json(raw: Column) -> Val:
    """The value of a JSON fragment given as text. Arrays and objects are texts; true and false are 1 and 0."""

    def parts(r: Column) -> Column:
        first = F.substring(r, 1, 1)
        number = first.rlike("[0-9-]")
        whole = number & r.rlike("^-?[0-9]+$")
        boolean = r.isin("true", "false")
        tag = F.when(r.isNull() | (r == "null"), 0).when(first.isin('"', "{", "["), int(Kind.TEXT)).when(boolean | whole, int(Kind.INTEGER)).when(number, int(Kind.REAL)).otherwise(0)
        return F.struct(
            tag.alias("tag"),
            F.when(boolean, (r == "true").cast("bigint")).when(whole, r.try_cast("bigint")).alias("i"),
            F.when(number & ~whole, r.try_cast("double")).alias("r"),
            F.when(first == '"', F.get_json_object(F.concat(F.lit('{"v":'), r, F.lit("}")), "$.v")).when(first.isin("{", "["), r).alias("s"),
        )

    made = once(let(F.trim(raw), parts))
    return Val(Kind.ANY, parts={k: made[k] for k in ("tag", "i", "r", "s")} | {"b": null_of("binary")}, json=raw)


def as_real(v: Val) -> Column:
    if v.parts:
        p = v.parts
        return F.when(v.is_null(), null_of("double")).otherwise(F.coalesce(p["r"], p["i"].cast("double"), text_real(F.coalesce(p["s"], p["b"].cast("string")))))
    if v.kind == Kind.NONE:
        return null_of("double")
    if v.kind in (Kind.INTEGER, Kind.REAL):
        return v.col.cast("double")
    return F.when(v.col.isNotNull(), text_real(v.col.cast("string")))


def text_real(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, NUM_PREFIX, 1).try_cast("double"), F.lit(0.0))


def as_integer(v: Val, strict: bool = False) -> Column:
    """Prefix of digits; a real is rounded down (towards zero under ``strict``)."""

    def of_real(x: Column) -> Column:
        return F.when(strict & (x < 0), F.ceil(x)).otherwise(F.floor(x)).try_cast("bigint") if strict else F.floor(x).try_cast("bigint")

    def of_text(s: Column) -> Column:
        return F.coalesce(F.regexp_extract(s, INT_PREFIX, 1).try_cast("bigint"), F.lit(0).cast("bigint"))

    if v.parts:
        p = v.parts
        return F.when(v.is_null(), null_of("bigint")).otherwise(F.coalesce(p["i"], of_real(p["r"]), of_text(F.coalesce(p["s"], p["b"].cast("string")))))
    if v.kind == Kind.NONE:
        return null_of("bigint")
    if v.kind == Kind.INTEGER:
        return v.col
    if v.kind == Kind.REAL:
        return of_real(v.col)
    return F.when(v.col.isNotNull(), of_text(v.col.cast("string")))


def as_numeric(v: Val) -> Val:
    """Numbers as they are; of a text its numeric prefix, an integer unless it has a fraction or an exponent."""
    if v.kind in (Kind.INTEGER, Kind.REAL, Kind.NONE):
        return v
    p = v.any().parts
    prefix = F.regexp_extract(F.coalesce(p["s"], p["b"].cast("string")), NUM_PREFIX, 1)
    textual = p["tag"].isin(int(Kind.TEXT), int(Kind.BLOB))
    floating = textual & prefix.rlike(r"[.eE]")
    return Val(
        Kind.ANY,
        parts={
            "tag": F.when(p["tag"] == 0, 0).when(textual, F.when(floating, int(Kind.REAL)).otherwise(int(Kind.INTEGER))).otherwise(p["tag"]),
            "i": F.when(textual & ~floating, F.coalesce(prefix.try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(p["i"]),
            "r": F.when(floating, prefix.try_cast("double")).otherwise(p["r"]),
            "s": null_of("string"),
            "b": null_of("binary"),
        },
    )


def as_blob(v: Val) -> Column:
    if v.parts:
        return F.coalesce(v.parts["b"], as_text(v).cast("binary"))
    return v.col if v.kind == Kind.BLOB else as_text(v).cast("binary")


def truthy(v: Val) -> Column:
    """Two-valued: null is false, a number is true unless 0, a text by its leading integer, a blob is false."""
    if v.cond is not None:
        return F.coalesce(v.cond, F.lit(False))

    def of_text(s: Column) -> Column:
        return F.coalesce(F.regexp_extract(s, INT_PREFIX, 1).try_cast("decimal(38,0)") != 0, F.lit(False))

    if v.parts:
        p = v.parts
        return F.coalesce(p["i"] != 0, p["r"] != 0, F.when(p["s"].isNotNull(), of_text(p["s"])), F.lit(False))
    if v.kind in (Kind.NONE, Kind.BLOB):
        return F.lit(False)
    return F.coalesce(v.col != 0, F.lit(False)) if v.kind in (Kind.INTEGER, Kind.REAL) else F.when(v.col.isNotNull(), of_text(v.col)).otherwise(False)


def as_filter(v: Val) -> Column:
    """For a filter, in which null and false are the same."""
    return v.cond if v.cond is not None else truthy(v)


_CLASS = {Kind.INTEGER: 1, Kind.REAL: 1, Kind.TEXT: 2, Kind.BLOB: 3}
_TESTS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Val, b: Val) -> Val:
    """Null if either is null. Numbers compare by value, texts by code points; different classes by class: number, text, blob."""
    test = _TESTS[op]
    if Kind.NONE in (a.kind, b.kind):
        return condition(null_of("boolean"))
    if not a.parts and not b.parts:
        if _CLASS[a.kind] == _CLASS[b.kind]:
            if a.kind != b.kind:
                return condition(test(a.col.cast("double"), b.col.cast("double")))
            return condition(test(a.col, b.col))
        known = {"=": False, "!=": True, "<": _CLASS[a.kind] < _CLASS[b.kind], ">": _CLASS[a.kind] > _CLASS[b.kind]}
        known |= {"<=": known["<"], ">=": known[">"]}
        return condition(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(known[op])))
    if a.parts and not b.parts:
        turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
        return compare(turned.get(op, op), b, a)
    if not a.parts:
        # one side's kind is known: only that part of the other counts, else its class decides
        q, mine = b.parts, _CLASS[a.kind]
        if mine == 1:
            same = F.when(q["tag"] == 4, test(a.col, q["i"])).when(q["tag"] == 8, test(a.col.cast("double"), q["r"]))
        else:
            same = F.when(q["tag"] == int(a.kind), test(a.col, q["s"] if mine == 2 else q["b"]))
        grade = F.when(q["tag"] == 2, 2).when(q["tag"] == 1, 3).otherwise(1)
        other = F.lit(op == "!=") if op in ("=", "!=") else test(F.lit(mine), grade)
        return condition(F.when(a.col.isNotNull() & (q["tag"] != 0), F.coalesce(same, other)))
    p, q = a.any().parts, b.any().parts

    def grade(t: Column) -> Column:
        return F.when(t.isin(4, 8), 1).when(t == 2, 2).when(t == 1, 3)

    x, y = grade(p["tag"]), grade(q["tag"])
    both = F.when(x == 1, F.when((p["tag"] == 4) & (q["tag"] == 4), test(p["i"], q["i"])).otherwise(test(F.coalesce(p["r"], p["i"].cast("double")), F.coalesce(q["r"], q["i"].cast("double"))))).when(x == 2, test(p["s"], q["s"])).otherwise(test(p["b"], q["b"]))
    return condition(F.when((p["tag"] == 0) | (q["tag"] == 0), null_of("boolean")).when(x == y, both).otherwise(test(x, y)))


def identical(a: Val, b: Val) -> Val:
    """IS: never null; null is null."""
    return condition(F.when(a.is_null() | b.is_null(), a.is_null() & b.is_null()).otherwise(F.coalesce(compare("=", a, b).cond, F.lit(False))))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Integers stay integers (division cuts the fraction off), else real; a division by zero is null."""
    a, b = as_numeric(a), as_numeric(b)
    if Kind.NONE in (a.kind, b.kind):
        return Val(Kind.INTEGER, null_of("bigint"))
    whole = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}

    def int_op(x: Column, y: Column) -> Column:
        if op != "/":
            return whole[op](x, y)
        # exact: the remainder taken off, what is left divides without rest
        q = F.try_divide((x - F.try_mod(x, y)).cast("decimal(20,0)"), y.cast("decimal(20,0)"))
        return F.when(y != 0, q.try_cast("bigint"))

    def real_op(x: Column, y: Column) -> Column:
        if op == "/":
            return F.when(y != 0, x / F.when(y != 0, y))
        return {"+": x + y, "-": x - y, "*": x * y}[op]

    if not a.parts and not b.parts:
        if a.kind == b.kind == Kind.INTEGER:
            return integer(int_op(a.col, b.col))
        return real(real_op(a.col.cast("double"), b.col.cast("double")))
    p, q = a.any().parts, b.any().parts
    ints, none = (p["tag"] == 4) & (q["tag"] == 4), (p["tag"] == 0) | (q["tag"] == 0)
    i = F.when(ints, int_op(p["i"], q["i"]))
    r = F.when(~ints & ~none, real_op(F.coalesce(p["r"], p["i"].cast("double")), F.coalesce(q["r"], q["i"].cast("double"))))
    return Val(Kind.ANY, parts={"tag": F.when(i.isNotNull(), 4).when(r.isNotNull(), 8).otherwise(0), "i": i, "r": r, "s": null_of("string"), "b": null_of("binary")})


def bitwise(op: str, a: Val, b: Val) -> Val:
    x, y = as_integer(a, True), as_integer(b, True)
    if op == "%":
        return integer(F.when(y != 0, F.try_mod(x, y)))
    if op in ("&", "|"):
        return integer(x.bitwiseAND(y) if op == "&" else x.bitwiseOR(y))
    n = F.when(y < 0, -y).otherwise(y).cast("int")
    left, right = F.when(n > 63, 0).otherwise(F.call_function("shiftleft", x, n)), F.when(n > 63, F.when(x < 0, -1).otherwise(0)).otherwise(F.call_function("shiftright", x, n))
    return integer((F.when(y >= 0, left).otherwise(right) if op == "<<" else F.when(y >= 0, right).otherwise(left)).cast("bigint"))


def choose(cases: list[tuple[Column, Val]], other: Val) -> Val:
    """The value of the first condition that holds; of one kind if all are, else in parts."""
    kinds = {v.kind for _, v in cases} | {other.kind}
    kinds.discard(Kind.NONE)

    def pick(get, kind: str) -> Column:
        out = None
        for c, v in cases:
            out = F.when(c, get(v)) if out is None else out.when(c, get(v))
        return out.otherwise(get(other)) if out is not None else get(other)

    names = {Kind.INTEGER: "bigint", Kind.REAL: "double", Kind.TEXT: "string", Kind.BLOB: "binary"}
    if not kinds:
        return NULL
    if len(kinds) == 1 and Kind.ANY not in kinds:
        k = kinds.pop()
        return Val(k, pick(lambda v: null_of(names[k]) if v.kind == Kind.NONE else v.col, names[k]))
    return Val(Kind.ANY, parts={x: pick(lambda v, x=x: v.any().parts[x], "") for x in ("tag", "i", "r", "s", "b")})


def key_value(v: Val) -> Val:
    """As part of a lookup key: an integral real becomes the integer."""
    if v.kind == Kind.REAL:
        return Val(Kind.ANY, parts={"tag": F.when(v.col.isNull(), 0).when(v.col == F.floor(v.col), 4).otherwise(8), "i": F.when(v.col == F.floor(v.col), v.col.try_cast("bigint")), "r": F.when(v.col != F.floor(v.col), v.col), "s": null_of("string"), "b": null_of("binary")})
    return v

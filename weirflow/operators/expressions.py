"""Expressions of a plan as values over the columns of a frame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.scalar import FUNCTIONS, json_get
from weirflow.functions.values import NULL, Kind, Val, arithmetic, as_blob, as_integer, as_json, as_numeric, as_real, as_text, bitwise, choose, compare, condition, identical, integer, literal, null_of, of_column, of_json, real, text, truthy
from weirflow.plans.sql import Call, Case, Cast, DefinitionError, Lit, Op, Ref

#: The JSON documents of a request, by the schema that reads them.
DOCUMENTS = {"auth": "auth", "connection": "connection", "subscription": "subscription"}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Env:
    """What names mean in a frame: table column (id, name) -> type of the column ``id|name``."""

    types: dict[tuple[str, str], T.DataType] = field(default_factory=dict)
    #: 'js' (NOT NULL is true, AND/OR are two-valued, reals are cast downwards) or 'sqlite'
    semantics: str = "js"
    fixed_json: bool = True
    #: How time stamps and row types are written.
    iso: bool = True
    digits: int | None = None
    custom_types: bool = True

    def ref(self, n: Ref) -> Val:
        if n.table and n.table.startswith("json_each!"):
            if n.column not in ("key", "value"):
                raise DefinitionError(f"json_each has no column {n.column}")
            return of_json(column(f"{n.table}|{n.column}"))
        kind = self.types.get((n.table, n.column))
        if kind is None:
            low = [k for k in self.types if k[0] == n.table and k[1].lower() == n.column.lower()]
            if not low:
                return NULL
            n, kind = Ref(*low[0]), self.types[low[0]]
        return of_column(column(f"{n.table}|{n.column}"), kind, self.iso, self.digits, self.custom_types)

    def value(self, n) -> Val:
        if isinstance(n, Lit):
            return literal(n.value)
        if isinstance(n, Ref):
            return self.ref(n)
        if isinstance(n, Cast):
            return self._cast(self.value(n.value), n.kind)
        if isinstance(n, Case):
            return self._case(n)
        if isinstance(n, Call):
            return self._call(n)
        if isinstance(n, Op):
            return self._op(n)
        raise DefinitionError(f"Can't evaluate {n!r}")

    def _cast(self, v: Val, kind: str) -> Val:
        if v.kind == Kind.NONE:
            return NULL
        strict = self.semantics == "sqlite"
        made = {"text": lambda: text(as_text(v)), "integer": lambda: integer(as_integer(v, strict)), "real": lambda: real(as_real(v)), "numeric": lambda: as_numeric(v), "blob": lambda: Val(Kind.BLOB, as_blob(v))}
        return made[kind]()

    def _case(self, n: Case) -> Val:
        other = NULL if n.other is None else self.value(n.other)
        if n.operand is None:
            return choose([(truthy(self.value(c)), self.value(v)) for c, v in n.whens], other)
        x = self.value(n.operand)
        return choose([(F.coalesce(compare("=", x, self.value(c)).cond, F.lit(False)), self.value(v)) for c, v in n.whens], other)

    def _call(self, n: Call) -> Val:
        if n.schema in DOCUMENTS or n.schema == "request":
            if n.schema == "request":
                doc = "connection" if n.name in ("parameters", "parameter") else "auth"
            else:
                doc = DOCUMENTS[n.schema]
            whole = text(column(f"request|{doc}"))
            if n.name in ("parameters", "jwt"):
                return whole
            key = "sub" if n.name == "user_id" else str(n.args[0].value)
            return json_get(whole, f"$.{key}", "->>", self.fixed_json, checked=False)
        fn, _, _, fixed = FUNCTIONS[n.name]
        args = [a.value if k in fixed else self.value(a) for k, a in enumerate(n.args)]
        if n.name == "json_extract":
            return fn(*args, self.fixed_json)
        return fn(*args)

    def _op(self, n: Op) -> Val:
        strict = self.semantics == "sqlite"
        if n.name in ("AND", "OR"):
            if strict:
                a, b = (self._three(self.value(x)) for x in n.args)
            else:
                a, b = (truthy(self.value(x)) for x in n.args)
            return condition(a & b if n.name == "AND" else a | b)
        if n.name == "NOT":
            v = self.value(n.args[0])
            return condition(~self._three(v) if strict else ~truthy(v))
        if n.name in ("IS TRUE", "IS FALSE"):
            v = self.value(n.args[0])
            return condition(~v.is_null() & (truthy(v) if n.name == "IS TRUE" else ~truthy(v)))
        if n.name in ("IS", "IS NOT"):
            out = identical(*map(self.value, n.args)).cond
            return condition(out if n.name == "IS" else ~out)
        if n.name in ("->", "->>"):
            key = n.args[1]
            if not isinstance(key, Lit):
                raise DefinitionError("The right side of -> must be a literal")
            return json_get(self.value(n.args[0]), key.value, n.name, self.fixed_json)
        args = [self.value(a) for a in n.args]
        if n.name in ("=", "!=", "<", ">", "<=", ">="):
            return compare(n.name, *args)
        if n.name in ("+", "-", "*", "/"):
            return arithmetic(n.name, *args)
        if n.name in ("&", "|", "<<", ">>", "%"):
            if not strict:
                raise DefinitionError(f"Operator {n.name} needs the sqlite semantics")
            return bitwise(n.name, *args)
        if n.name == "||":
            return text(F.concat(*map(as_text, args)))
        if n.name == "BETWEEN":
            low, high = compare(">=", args[0], args[1]).cond, compare("<=", args[0], args[2]).cond
            return condition(F.when(low.isNotNull() & high.isNotNull(), low & high) if not strict else low & high)
        if n.name == "IN LIST":
            tests = [compare("=", args[0], a).cond for a in args[1:]]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return condition(out)
        if n.name == "IN":
            return condition(_contains(args[1], args[0]))
        if n.name == "&&":
            a, b = (_keys(x) for x in args)
            return condition(F.when(~args[0].is_null() & ~args[1].is_null(), F.coalesce(F.arrays_overlap(a, b), F.lit(False))))
        raise DefinitionError(f"Unknown operator {n.name}")

    @staticmethod
    def _three(v: Val) -> Column:
        return v.cond if v.cond is not None else F.when(v.is_null(), null_of("boolean")).otherwise(truthy(v))


def _keys(array: Val) -> Column:
    """A JSON array's elements in the text form of keys, in which equal numbers are equal; nulls are left out."""
    members = F.transform(F.from_json(as_text(array), "array<variant>"), lambda v: F.to_json(v))
    # variants print equal numbers alike; only booleans are numbers of their own
    return F.transform(F.filter(members, lambda r: r.isNotNull() & (r != "null")), lambda r: F.when(r == "true", "1").when(r == "false", "0").otherwise(r))


def _contains(array: Val, x: Val) -> Column:
    return F.when(~array.is_null() & ~x.is_null(), F.coalesce(F.array_contains(_keys(array), as_json(x, keys=True)), F.lit(False)))


def with_env(frame: DataFrame, like: Env | None = None) -> Env:
    """The names of a frame whose columns are called ``id|name``."""
    env = replace(like, types={}) if like else Env()
    for f in frame.schema.fields:
        owner, bar, name = f.name.partition("|")
        if bar and owner != "request" and not owner.startswith("json_each!"):
            env.types[owner, name] = f.dataType
    return env

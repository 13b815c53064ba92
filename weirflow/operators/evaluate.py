"""Plan evaluation: rows to buckets, rows to lookups, requests to buckets; all of it joins, filters and projections."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalar import collected
from weirflow.functions.values import Kind, Val, as_filter, as_json, as_text, hoisting, json_string, key_value
from weirflow.functions.table import TABLE_FUNCTIONS
from weirflow.operators.expressions import Env, column, with_env
from weirflow.plans.model import Bucket, Each, Evaluator, Lookup, Plan, Querier, Stream
from weirflow.sources.tables import matching, scan

MAX_BUCKETS, MAX_RESULTS, MAX_PER_DEFINITION = 1000, 1000, 100
#: About so many rows of one class of requests are made side by side in one part.
PART_ROWS = 4_000_000


def _with(frame: DataFrame, hoisted: dict) -> DataFrame:
    """The columns that expressions share, each computed once."""
    for name, c in hoisted.values():
        frame = frame.withColumn(name, c)
    return frame


def _explode(frame: DataFrame, each: Each, env: Env) -> DataFrame:
    members = TABLE_FUNCTIONS[each.function](as_text(env.value(each.expr)))
    out = frame.select("*", F.explode(members).alias("__m"))
    return out.select(*[column(c) for c in frame.columns], F.col("__m.key").alias(f"{each.alias}|key"), F.col("__m.value").alias(f"{each.alias}|value"))


def _frame(tables: dict[str, DataFrame], part: Evaluator | Lookup, like: Env) -> tuple[DataFrame, Env]:
    """The rows of a table that a plan part is about: expanded and filtered."""
    frame = scan(tables, part.table)
    env = with_env(frame, like)
    for e in part.each:
        frame = _explode(frame, e, env)
    return _filtered(frame, part.filters, env), env


def _filtered(frame: DataFrame, filters, env: Env) -> DataFrame:
    """The rows that pass filters; a row on which one can't be evaluated doesn't."""
    with hoisting() as hoisted, collected() as bad:
        conditions = [as_filter(env.value(f)) for f in filters]
    frame = _with(frame, hoisted)
    for c in [*conditions, *(~b for b, _ in bad)]:
        frame = frame.filter(c)
    return frame


def _env(stream: Stream) -> Env:
    return Env(semantics=stream.semantics, fixed_json=stream.fixed_json, iso=stream.iso, digits=stream.digits, custom_types=stream.custom_types)


def _usable(v: Val) -> Column:
    """Keys are never null and never blobs."""
    if v.kind in (Kind.NONE, Kind.BLOB):
        return F.lit(False)
    return ~v.parts["tag"].isin(0, int(Kind.BLOB)) if v.parts else v.col.isNotNull()


def bucket_name(prefix: str, keys: list[Val]) -> Column:
    return _named(prefix, [as_json(v, keys=True) for v in keys])


def _named(prefix: str, keys: list[Column]) -> Column:
    parts: list[Column] = [F.lit(prefix + "[")]
    for k, text in enumerate(keys):
        parts += [F.lit(",")] * (k > 0) + [text]
    return F.concat(*parts, F.lit("]"))


def _output(ev: Evaluator, frame: DataFrame, env: Env, legacy: bool) -> dict[str, Val]:
    """Selected columns by name, without blobs. Of two with one name the later one counts, in older editions the earlier one."""
    out: dict[str, Val] = {}

    def put(name: str, v: Val) -> None:
        if legacy and name in out:
            return
        out[name] = v

    for i in ev.items:
        if i.expr is not None:
            put(i.alias, env.value(i.expr))
            continue
        for owner, name in env.types:
            if owner == ev.table.alias and not name.startswith("$") and not (legacy and name.startswith("_")):
                from weirflow.plans.sql import Ref

                put(name, env.ref(Ref(owner, name)))
    return {k: v for k, v in out.items() if v.kind != Kind.BLOB}


def _evaluated(stream: Stream, bucket: Bucket, ev: Evaluator, tables: dict[str, DataFrame]):
    """Frame, values and what fails: a row that fails in a filter, or after passing them, is an error of this evaluator."""
    like = _env(stream)
    frame = scan(tables, ev.table)
    env = with_env(frame, like)
    for e in ev.each:
        frame = _explode(frame, e, env)
    with hoisting() as hoisted:
        with collected() as in_filters:
            filters = [as_filter(env.value(f)) for f in ev.filters]
        with collected() as in_values:
            keys = [env.value(k) for k in ev.keys]
            out = _output(ev, frame, env, stream.legacy_star)
    frame = _with(frame, hoisted)
    return frame, filters, keys, out, in_filters, in_values


def row_errors(stream: Stream, bucket: Bucket, ev: Evaluator, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that can't be evaluated: object_type, object_id, error. Other rows and evaluators aren't touched by them."""
    frame, filters, keys, out, in_filters, in_values = _evaluated(stream, bucket, ev, tables)
    passed = reduce(lambda a, b: a & b, [F.coalesce(f, F.lit(False)) for f in filters], F.lit(True))
    message = F.coalesce(F.lit(None).cast("string"), *[F.when(c, m) for c, m in in_filters], *[F.when(passed & c, m) for c, m in in_values])
    object_id = F.coalesce(as_text(out["id"]), F.lit("")) if "id" in out else F.lit("")
    kind = F.lit(ev.table.output) if ev.table.output else column(f"{ev.table.alias}|$table_name")
    return frame.select(kind.alias("object_type"), object_id.alias("object_id"), message.alias("error")).filter("error is not null")


def source_rows(stream: Stream, bucket: Bucket, ev: Evaluator, tables: dict[str, DataFrame], typed: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """bucket, object_type, object_id, and either the selected columns (values of mixed type as text) or ``data`` as JSON.

    ``carry``: columns of the table that are passed on as they are; their names begin with $.
    """
    frame, filters, keys, out, in_filters, in_values = _evaluated(stream, bucket, ev, tables)
    for f in filters:
        frame = frame.filter(f)
    for k in keys:
        frame = frame.filter(_usable(k))
    for bad, _ in [*in_filters, *in_values]:
        frame = frame.filter(~bad)
    kind = F.lit(ev.table.output) if ev.table.output else column(f"{ev.table.alias}|$table_name")
    object_id = F.coalesce(as_text(out["id"]), F.lit("")) if "id" in out else F.lit("")
    head = [bucket_name(bucket.prefix, keys).alias("bucket"), kind.alias("object_type"), object_id.alias("object_id"), *[column(f"{ev.table.alias}|{c}").alias(c) for c in carry]]
    if typed:
        return frame.select(*head, *[(as_text(v) if v.parts or v.kind == Kind.NONE else v.col).alias(k) for k, v in out.items()])
    members: list[Column] = []
    for k, (name, v) in enumerate(out.items()):
        members += [F.concat(F.lit("," if k else ""), json_string(F.lit(name)), F.lit(":")), as_json(v)]
    return frame.select(*head, F.concat(F.lit("{"), *members, F.lit("}")).alias("data"))


def bucket_rows(plan: Plan, tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of all streams by bucket: bucket, object_type, object_id, data."""
    parts = []
    for s in plan.streams:
        for b in s.buckets:
            rows = reduce(DataFrame.unionByName, [source_rows(s, b, e, tables, typed=False) for e in b.evaluators])
            names = [e.table.name for e in b.evaluators]
            # a row that two alternatives put into one bucket is there once
            parts.append(rows.distinct() if len(names) > len(set(names)) else rows)
    return reduce(DataFrame.unionByName, parts)


def lookup_sources(plan: Plan, tables: dict[str, DataFrame], carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """What the tables give to each lookup of a plan that reads one of them: lookup, lookup_key, output, and the carried columns."""
    parts = []
    for s in plan.streams:
        for b in s.buckets:
            for q, querier in enumerate(b.queriers):
                for n, lookup in enumerate(querier.lookups):
                    if not matching(tables, lookup.table):
                        continue
                    frame, env = _frame(tables, lookup, _env(s))
                    with hoisting() as hoisted, collected() as bad:
                        ins, outs = ([key_value(env.value(e)) for e in es] for es in (lookup.inputs, lookup.outputs))
                    frame = _with(frame, hoisted)
                    for c in [*map(_usable, [*ins, *outs]), *(~b for b, _ in bad)]:
                        frame = frame.filter(c)
                    kept = [column(f"{lookup.table.alias}|{c}").alias(c) for c in carry]
                    parts.append(frame.select(F.lit(f"{b.prefix}|{q}|{n}").alias("lookup"), bucket_name("", ins).alias("lookup_key"), bucket_name("", outs).alias("output"), *kept).distinct())
    return parts


def lookup_rows(plan: Plan, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the lookup indexes: lookup, key (JSON array of what is looked up), output (JSON array of what is given).

    Key parts and outputs that are null or blobs make no row; integral reals are stored as integers. One row per key and
    output, so that a key that leads to very many outputs is no single value.
    """
    return reduce(DataFrame.unionByName, lookup_sources(plan, tables)).withColumnRenamed("lookup_key", "key")


@dataclass(frozen=True)
class _Side:
    """A side of a join: the column itself where it is of one kind that joins as it is, and the text of its key."""

    kind: Kind
    native: Column | None
    text: Column
    usable: Column

    @staticmethod
    def of(v: Val) -> _Side:
        return _Side(v.kind, v.col if v.kind in (Kind.INTEGER, Kind.TEXT) and not v.parts else None, as_json(v, keys=True), _usable(v))

    def pinned(self, name: str) -> tuple[list[Column], _Side]:
        """Columns that hold a side that is usable, and the side that reads them."""
        made = [self.text.alias(f"{name}|text")] + ([] if self.native is None else [self.native.alias(f"{name}|native")])
        return made, _Side(self.kind, None if self.native is None else column(f"{name}|native"), column(f"{name}|text"), F.lit(True))


def _join_on(a: _Side, b: _Side) -> tuple[Column, Column]:
    """Two sides that are equal exactly if the values are: columns of one kind as they are, else the text of keys."""
    if a.kind == b.kind and a.native is not None and b.native is not None:
        return a.native, b.native
    return a.text, b.text


def requests_frame(stream: Stream, requests: DataFrame) -> DataFrame:
    """The requests that subscribe to a stream: by name, or by default where the stream allows it.

    A row that names the stream without parameters (null subscription) stands for the request's default subscription; one
    with parameters is a subscription beside it.
    """
    named = F.col("stream") == stream.name
    own = requests.filter(named)
    if stream.auto_subscribe:
        explicit = own.filter(F.col("subscription").isNull()).select(F.col("request_id").alias("__explicit")).distinct()
        default = requests.filter(F.col("stream").isNull())
        own = own.unionByName(default.join(explicit, F.col("request_id") == F.col("__explicit"), "left_anti"))
    return own.select(
        F.col("request_id").alias("request|id"), *[F.col(c).alias(f"request|{c}") for c in ("auth", "connection", "subscription")], F.col("priority").cast("int").alias("request|priority")
    )


def querier_buckets(stream: Stream, bucket: Bucket, querier: Querier, tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """(request_id, bucket, priority): one row per request and bucket, with the smallest priority.

    Requests that give the same values to joins and bucket keys are a class. Lookups are joined with the classes, stage by
    stage, and buckets are made and told apart per class. Each class's requests meet its buckets in the last step, whose
    rows are distinct already unless a request is in several classes; only the rows of such requests go through an exchange.
    """
    like = _env(stream)
    frame = requests_frame(stream, requests)
    env = with_env(frame, like)
    for e in querier.each:
        frame = _explode(frame, e, env)
    frame = _filtered(frame, querier.filters, env)
    have = {"@request"} | {e.alias for e in querier.each}
    left = list(querier.lookups)
    pending = list(querier.joins)

    def owners(e) -> set[str]:
        from weirflow.plans.compile import Compiler

        return Compiler._deps(e)

    # an expression is of one table or of the request; those of the request are columns from here on
    of_request = {id(e): e for e in [*(x for p in pending for x in p), *querier.values] if owners(e) <= have}
    with hoisting() as hoisted, collected() as bad:
        sides = {k: _Side.of(env.value(e)) for k, e in of_request.items()}
    frame = _with(frame, hoisted)
    for c in [*(v.usable for v in sides.values()), *(~b for b, _ in bad)]:
        frame = frame.filter(c)
    held: list[Column] = []
    for n, (k, v) in enumerate(sides.items()):
        made, sides[k] = v.pinned(f"class|{n}")
        held += made
    own = stream.priority if querier.priority is None else querier.priority
    members = frame.select(column("request|id").alias("request_id"), F.coalesce(column("request|priority"), F.lit(own)).cast("int").alias("priority"), *held)
    keys = members.columns[2:]
    if not left:
        frame = members
    else:
        # no values of the request: one class, which is there if a request is
        frame = members.select(*map(column, keys)).distinct() if keys else members.limit(1).select(F.lit(0).alias("class|0"))
    env.types.clear()

    def side(e) -> _Side:
        return sides.get(id(e)) or _Side.of(env.value(e))

    while left:
        pick = None
        for lookup in left:
            mine = {lookup.table.alias} | {e.alias for e in lookup.each}
            on = [(x, y) for x, y in pending if (owners(x) <= have and owners(y) <= mine) or (owners(y) <= have and owners(x) <= mine)]
            if on:
                pick = (lookup, mine, on)
                break
        if pick is None:
            lookup = left[0]
            pick = (lookup, {lookup.table.alias} | {e.alias for e in lookup.each}, [])
        lookup, mine, on = pick
        near, near_env = _frame(tables, lookup, like)
        wanted = _columns_used(querier, lookup)
        conditions = None
        pairs = []
        with collected() as bad_far:
            with hoisting() as of_frame:
                fars = [side(x if owners(x) <= have else y) for x, y in on]
            frame = _with(frame, of_frame)
        with collected() as bad_near:
            with hoisting() as of_near:
                nears = [_Side.of(near_env.value(y if owners(x) <= have else x)) for x, y in on]
            near = _with(near, of_near)
        for k, (a, b) in enumerate(zip(fars, nears)):
            frame, near = frame.filter(a.usable), near.filter(b.usable)
            ca, cb = _join_on(a, b)
            pairs.append((f"__a{k}", ca, f"__b{k}", cb))
        for b, _ in bad_far:
            frame = frame.filter(~b)
        for b, _ in bad_near:
            near = near.filter(~b)
        frame = frame.select("*", *[ca.alias(na) for na, ca, _, _ in pairs])
        near = near.select(*[column(c) for c in near.columns if c.partition("|")[0].startswith("json_each!") or c in wanted], *[cb.alias(nb) for _, _, nb, cb in pairs]).distinct()
        for na, _, nb, _ in pairs:
            c = F.col(na) == F.col(nb)
            conditions = c if conditions is None else conditions & c
        # without a condition every request gets every row: that is what the definition says
        frame = frame.join(near, conditions, "inner") if conditions is not None else frame.join(near)
        frame = frame.drop(*[n for p in pairs for n in (p[0], p[2])])
        env.types.update(near_env.types)
        have |= mine
        left.remove(lookup)
        pending = [p for p in pending if p not in on]
    with hoisting() as hoisted, collected() as bad:
        equal = [(side(x), side(y)) for x, y in pending]
        values = [side(v) for v in querier.values]
    frame = _with(frame, hoisted)
    for a, b in equal:
        ca, cb = _join_on(a, b)
        frame = frame.filter(a.usable & b.usable & (ca == cb))
    for c in [*(v.usable for v in values), *(~b for b, _ in bad)]:
        frame = frame.filter(c)
    name = _named(bucket.prefix, [v.text for v in values]).alias("bucket")
    least = F.min("priority").alias("priority")
    if not querier.lookups:
        return frame.select("request_id", name, "priority").groupBy("request_id", "bucket").agg(least)
    if not keys:
        return members.groupBy("request_id").agg(least).join(frame.select(name).distinct()).select("request_id", "bucket", "priority")
    return _members_buckets(members, frame.select(*map(column, keys), name).distinct(), keys)


def _members_buckets(members: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (request_id, priority, class) with the buckets of their classes: request_id, bucket, the smallest priority.

    A class with many requests and many buckets is dealt into parts by its requests, so that no task makes all of its rows.
    """
    by_class = [column(k) for k in keys]
    least = F.min("priority").alias("priority")
    # one exchange, by request, serves both steps
    members = members.repartition("request_id").groupBy("request_id", *by_class).agg(least).withColumn("__classes", F.count("*").over(Window.partitionBy("request_id")))
    sizes = members.groupBy(*by_class).agg(F.count("*").alias("__members"))
    counts = buckets.groupBy(*by_class).agg(F.count("*").alias("__buckets")).join(sizes, keys)
    parts = F.least(F.col("__members"), F.floor(F.col("__members") * F.col("__buckets") / PART_ROWS) + 1)
    hot = counts.select(*by_class, parts.cast("int").alias("__parts")).filter("__parts > 1")
    dealt = F.coalesce(F.col("__parts"), F.lit(1))
    members = members.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64("request_id"), dealt).cast("int")).drop("__parts")
    buckets = buckets.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("__parts")
    met = members.join(buckets, [*keys, "__part"])
    once = met.filter("__classes = 1").select("request_id", "bucket", "priority")
    several = met.filter("__classes > 1").groupBy("request_id", "bucket").agg(least)
    return once.unionByName(several)


def _columns_used(querier: Querier, lookup: Lookup) -> set[str]:
    from weirflow.plans.sql import Ref, walk

    used: set[str] = set()
    for e in [*querier.values, *[x for p in querier.joins for x in p]]:
        walk(e, lambda n: (used.add(f"{n.table}|{n.column}") if isinstance(n, Ref) and n.table == lookup.table.alias else None, n)[1])
    return used


def resolve_buckets(plan: Plan, tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Which buckets each request may read: request_id, bucket, the smallest priority, and the streams that lead there.

    ``requests``: request_id, auth, connection, subscription (JSON texts), stream (null: the default subscription), priority (null: the stream's).
    """
    prefixes = [b.prefix for s in plan.streams for b in s.buckets]
    # buckets of different prefixes have different names, unless a prefix may hold the beginning of another's keys
    apart = not any("[" in p for p in prefixes)
    found: dict[str, list[tuple[str, DataFrame]]] = {}
    for s in plan.streams:
        for b in s.buckets:
            found.setdefault(b.prefix if apart else "", []).extend((s.name, querier_buckets(s, b, q, tables, requests)) for q in b.queriers)
    parts = []
    for same in found.values():
        if len(same) == 1:
            parts.append(same[0][1].withColumn("reasons", F.array(F.lit(same[0][0]))))
        elif same:
            every = reduce(DataFrame.unionByName, [df.withColumn("reason", F.lit(name)) for name, df in same])
            parts.append(every.groupBy("request_id", "bucket").agg(F.min("priority").alias("priority"), F.sort_array(F.collect_set("reason")).alias("reasons")))
    return reduce(DataFrame.unionByName, parts)


def over_limits(resolved: DataFrame, buckets: int = MAX_BUCKETS, per_definition: int = MAX_PER_DEFINITION) -> DataFrame:
    """Requests with too many buckets, with the definitions that hold most of them."""
    counts = resolved.groupBy("request_id", F.substring_index("bucket", "[", 1).alias("definition")).agg(F.count("*").alias("n"))
    ranked = counts.groupBy("request_id").agg(F.sum("n").alias("buckets"), F.slice(F.sort_array(F.collect_list(F.struct("n", "definition")), asc=False), 1, 100).alias("largest"))
    return ranked.filter((F.col("buckets") > buckets) | (F.col("largest")[0]["n"] > per_definition))


def within_limits(resolved: DataFrame, buckets: int = MAX_BUCKETS, per_definition: int = MAX_PER_DEFINITION) -> tuple[DataFrame, DataFrame]:
    """The buckets of requests that keep the limits, and what is wrong with the others: request_id, error. A refused request reads nothing."""
    over = over_limits(resolved, buckets, per_definition)
    named = F.array_join(F.transform("largest", lambda x: F.concat(x["definition"], F.lit(": "), x["n"].cast("string"))), ", ")
    errors = over.select("request_id", F.concat(F.lit("Too many buckets: "), F.col("buckets").cast("string"), F.lit(f" (limit of {buckets}, {per_definition} per definition). "), named).alias("error"))
    return resolved.join(over.select("request_id"), "request_id", "left_anti"), errors

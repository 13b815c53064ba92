"""Definitions as YAML (or as the mapping that YAML gives): editions 1 to 3, options, events."""

from __future__ import annotations

from weirflow.plans.compile import compile_stream
from weirflow.plans.legacy import compile_alpha, compile_bucket_definition
from weirflow.plans.model import Plan
from weirflow.plans.sql import DefinitionError, parse

PRIORITIES = range(4)
PRECISIONS = {"seconds": 0, "milliseconds": 3, "microseconds": 6, "nanoseconds": 9}


def _mapping(source) -> dict:
    if isinstance(source, str):
        try:
            import yaml
        except ImportError as e:
            raise DefinitionError("Reading YAML needs PyYAML; give a mapping instead") from e
        source = yaml.safe_load(source)
    if not isinstance(source, dict):
        raise DefinitionError("A definition must be a mapping")
    return source


def _list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def options_of(config: dict) -> dict:
    """Compatibility options: on by default from edition 2, except the engine; each may be set."""
    edition = int(config.get("edition", 1))
    if edition not in (1, 2, 3):
        raise DefinitionError(f"Unknown edition {edition}")
    out = {k: bool(config.get(k, edition >= 2)) for k in ("timestamps_iso8601", "versioned_bucket_ids", "fixed_json_extract", "custom_postgres_types")}
    out["unstable_sqlite_expression_engine"] = bool(config.get("unstable_sqlite_expression_engine", False))
    precision = config.get("timestamp_max_precision")
    if precision is not None:
        if precision not in PRECISIONS:
            raise DefinitionError(f"Unknown precision {precision}")
        if not out["timestamps_iso8601"]:
            raise DefinitionError("timestamp_max_precision needs timestamps_iso8601")
        out["timestamp_max_precision"] = PRECISIONS[precision]
    return out | {"edition": edition}


def _priority(x) -> int:
    if x is None:
        return 3
    if not isinstance(x, int) or x not in PRIORITIES:
        raise DefinitionError("A priority is 0, 1, 2 or 3")
    return x


def load(source, version: int | None = None) -> Plan:
    """The plan of a whole definition. ``version``: of its deployment; bucket names begin with it where the definition's options say so."""
    spec = _mapping(source)
    options = options_of(spec.get("config") or {})
    plan = Plan(options["edition"], options=options)
    kept = {
        "fixed_json": options["fixed_json_extract"],
        "semantics": "sqlite" if options["unstable_sqlite_expression_engine"] else "js",
        "iso": options["timestamps_iso8601"],
        "digits": options.get("timestamp_max_precision"),
        "custom_types": options["custom_postgres_types"],
    }
    shared = dict(spec.get("with") or {})
    for name, d in (spec.get("streams") or {}).items():
        queries = _list(d.get("query")) + _list(d.get("queries"))
        if not queries:
            raise DefinitionError(f"Stream {name} has no query")
        both = {"priority": _priority(d.get("priority")), "auto_subscribe": bool(d.get("auto_subscribe", False)), **kept}
        if options["edition"] >= 3:
            local = dict(d.get("with") or {})
            plan.streams.append(compile_stream(name, queries, {**shared, **local}, **both))
            if d.get("accept_potentially_dangerous_queries"):
                plan.streams[-1].warnings = [w for w in plan.streams[-1].warnings if not w.startswith("Potentially")]
        else:
            if d.get("with") or len(queries) > 1:
                raise DefinitionError("with: and several queries need edition 3")
            plan.streams.append(compile_alpha(name, queries[0], legacy_star=True, **both))
    for name, d in (spec.get("bucket_definitions") or {}).items():
        plan.streams.append(compile_bucket_definition(name, _list(d.get("parameters")), _list(d.get("data")), priority=_priority(d.get("priority")), auto_subscribe=True, legacy_star=True, **kept))
    for name, d in (spec.get("event_definitions") or {}).items():
        plan.events[name] = [compile_stream(name, [q], **kept) for q in _list(d.get("payloads"))]
    if not plan.streams and not plan.events:
        raise DefinitionError("Nothing is defined")
    return versioned(plan, version) if version is not None and options["versioned_bucket_ids"] else plan


def versioned(plan: Plan, version: int) -> Plan:
    """Bucket names of a deployed version: <n>#name."""
    for s in plan.streams:
        for b in s.buckets:
            b.prefix = f"{version}#{b.prefix.rpartition('#')[2]}"
    return plan


__all__ = ["load", "versioned", "options_of", "parse"]

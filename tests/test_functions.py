"""Goldens of scalar functions and operators."""

import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalar, values
from weirflow.functions.values import Kind, literal
from weirflow.operators.expressions import Env
from weirflow.plans.sql import parse


def lower(v):
    """A value of any kind as Python sees it."""
    if v.kind == Kind.NONE:
        return F.struct(F.lit("null").alias("k"), F.lit(None).cast("string").alias("v"))
    return F.struct(scalar.typeof(v).col.alias("k"), F.when(scalar.typeof(v).col == "blob", F.hex(values.as_blob(v))).otherwise(values.as_text(v)).alias("v"))


def expect(x):
    if x is None:
        return ("null", None)
    if isinstance(x, bool) or isinstance(x, int):
        return ("integer", str(int(x)))
    if isinstance(x, float):
        return ("real", str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x).replace("e+0", "e+"))
    if isinstance(x, bytes):
        return ("blob", x.hex().upper())
    return ("text", x)


#: Inputs chosen for the rules that the docstrings of weirflow.functions state.
DOC = """'{"port":"Bergen","berths":14,"depth":11.0,"open":false,"master":null,"log":[3,{"k":"v"}],"a.b":"dotted"}'"""
CALLS = [
    # JSON: members, numbers as they are written, booleans as 0 and 1, nulls, places in arrays, keys with dots
    (f"json_extract({DOC}, '$.port')", "Bergen"), (f"json_extract({DOC}, '$.berths')", 14), (f"json_extract({DOC}, '$.depth')", 11.0), (f"json_extract({DOC}, '$.open')", 0), (f"json_extract({DOC}, '$.master')", None),
    (f"json_extract({DOC}, '$.log.0')", 3), (f"json_extract({DOC}, '$.log.1')", '{"k":"v"}'), (f"json_extract({DOC}, '$.log.1.k')", "v"), (f"json_extract({DOC}, '$.log.7')", None), ("json_extract('[8]', '$')", "[8]"),
    (f"{DOC} ->> 'berths'", 14), (f"{DOC} ->> 'a.b'", "dotted"), (f"{DOC} ->> '$.a.b'", None), (f"{DOC} ->> '$.log.1.k'", "v"), ("'[\"x\",9]' ->> 1", 9),
    (f"{DOC} -> 'port'", '"Bergen"'), (f"{DOC} -> 'depth'", "11.0"), (f"{DOC} -> 'open'", "false"), (f"{DOC} -> 'master'", "null"), (f"{DOC} -> 'none'", None), (f"{DOC} -> '$.log'", '[3,{"k":"v"}]'),
    ("json_array_length('[[],[],[]]')", 3), (f"json_array_length({DOC}, '$.log')", 2), ("json_array_length('{}')", 0), ("json_array_length(NULL)", None),
    ("json_keys('{\"w\":0,\"12\":1,\"h\":2,\"3\":3,\"03\":4}')", '["3","12","w","h","03"]'), ("json_keys(NULL)", None),
    # types, lengths, encodings
    ("typeof(7 / 2)", "integer"), ("typeof(7 / 2.0)", "real"), ("typeof('7')", "text"), ("typeof(CAST(7 AS blob))", "blob"), ("typeof(NULL + 1)", "null"),
    ("length('naïve')", 5), ("length(CAST('naïve' AS blob))", 6), ("length(-40)", 3), ("length(2.50)", 3), ("length(NULL)", None),
    ("hex('Kiwi')", "4B697769"), ("hex(-5)", "2D35"), ("hex(NULL)", ""), ("base64('tide')", "dGlkZQ=="), ("base64(NULL)", ""), ("hex(uuid_blob('0A1b2c3d-0000-4000-8000-00000000000f'))", "0A1B2C3D00004000800000000000000F"), ("uuid_blob(NULL)", None),
    # choices: texts count by their leading integer, blobs are false
    ("ifnull(NULL, 3)", 3), ("ifnull('', 3)", ""), ("ifnull(NULL, NULL)", None), ("iif(-1, 'y', 'n')", "y"), ("iif(0.25, 'y', 'n')", "y"), ("iif('4 boats', 'y', 'n')", "y"), ("iif('boats', 'y', 'n')", "n"), ("iif('0.9', 'y', 'n')", "n"), ("iif(CAST('1' AS blob), 'y', 'n')", "n"), ("iif(NULL, 'y', 'n')", "n"),
    ("CASE WHEN NULL THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END", "b"), ("CASE 3 WHEN 1 THEN 'a' WHEN 3.0 THEN 'b' END", "b"), ("CASE NULL WHEN NULL THEN 'a' ELSE 'b' END", "b"), ("CASE 9 WHEN 1 THEN 'a' END", None),
    # texts: places count from 1, 0 takes one off, negative ones go backwards
    ("upper('fjord')", "FJORD"), ("lower(NULL)", None), ("upper(5)", "5"), ("substring('lighthouse', 6)", "house"), ("substring('lighthouse', 1, 5)", "light"), ("substring('lighthouse', -5, 3)", "hou"), ("substring('lighthouse', 0, 3)", "li"), ("substring('lighthouse', 0, 1)", ""),
    ("substring('lighthouse', 6, -2)", "ht"), ("substring('lighthouse', 40)", ""), ("substring('lighthouse', NULL)", None), ("substring('lighthouse', 3, NULL)", None), ("instr('lighthouse', 'house')", 6), ("instr('lighthouse', 'boat')", 0), ("instr('x', NULL)", None), ("instr(CAST('tide' AS blob), CAST('de' AS blob))", 3),
    ("'pier ' || 9", "pier 9"), ("'pier ' || NULL", None), ("0.5 || 'm'", "0.5m"),
    # casts: what is numeric is a text's beginning
    ("CAST('31 knots' AS integer)", 31), ("CAST('-7.9 m' AS integer)", -7), ("CAST(-7.9 AS integer)", -8), ("CAST('knots' AS integer)", 0), ("CAST('  6.25e2kg' AS numeric)", 625.0), ("CAST('88 kg' AS numeric)", 88), ("CAST('.75l' AS numeric)", 0.75), ("CAST('+4' AS numeric)", 4), ("CAST('kg' AS real)", 0.0),
    ("CAST(6 AS real)", 6.0), ("CAST(6.0 AS text)", "6"), ("CAST(0.0000004 AS text)", "4e-7"), ("CAST(4000000.5 AS text)", "4000000.5"), ("CAST(7e22 AS text)", "7e+22"), ("CAST(31 AS blob)", b"31"), ("CAST(NULL AS integer)", None), ("'19'::integer", 19),
    # dates: texts with or without time and zone, numbers as days of the Julian calendar or as seconds
    ("unixepoch('2001-09-09T01:46:40Z')", 1000000000), ("unixepoch('2001-09-09 03:46:40+02:00')", 1000000000), ("unixepoch('2001-09-09')", 999993600), ("unixepoch('1969-12-31T23:59:59')", -1), ("unixepoch('2001-09-09T03:46+2')", None), ("unixepoch('tomorrow')", None), ("unixepoch('2001-09-09', 'utc')", None), ("unixepoch()", None),
    ("unixepoch(2440587.5)", 0), ("unixepoch('2440588.5')", 86400), ("unixepoch(1000000000.75, 'unixepoch')", 1000000000), ("unixepoch(1000000000.75, 'unixepoch', 'subsec')", 1000000000.75), ("unixepoch('2001-09-09 01:46:40.125', 'subsecond')", 1000000000.125),
    ("datetime('2001-09-09T01:46:40.9Z')", "2001-09-09 01:46:40"), ("datetime('1850-06-01')", "1850-06-01 00:00:00"), ("datetime(1000000000.75, 'unixepoch', 'subsec')", "2001-09-09 01:46:40.750"), ("datetime(0, 'unixepoch')", "1970-01-01 00:00:00"),
    # comparison by class and value, arithmetic, lists
    ("4 = 4.0", 1), ("4 = '4'", 0), ("'4' > 4000", 1), ("4 < 'a'", 1), ("4.5 > 4", 1), ("NULL != 4", None), ("NULL IS NULL", 1), ("4 IS 4.0", 1), ("4 IS NOT NULL", 1), ("4 IS '4'", 0),
    ("6 + '1.5'", 7.5), ("6 + '1 m'", 7), ("6 * NULL", None), ("9 / 4", 2), ("-9 / 4", -2), ("9 / 4.0", 2.25), ("9 / '4'", 2), ("9 / 0", None), ("9.0 / 0", None), ("9 - 2.5", 6.5),
    ("3 IN '[2,3.0]'", 1), ("'3' IN '[2,3]'", 0), ("7 NOT IN '[2,3]'", 1), ("'[1,2]' && '[2.0,9]'", 1), ("'[\"p\"]' && '[\"q\"]'", 0), ("NULL && '[1]'", None), ("3 IN ARRAY[3, 5]", 1), ("3 IN ROW(5, NULL)", None), ("6 BETWEEN 2 AND 6", 1), ("6 NOT BETWEEN 2 AND 5", 1), ("6 BETWEEN 7 AND NULL", None),
    ("NOT 0", 1), ("NOT NULL", 1), ("NULL AND 1", 0), ("NULL OR 2", 1), ("2 IS TRUE", 1), ("NULL IS NOT TRUE", 1),
]
STRICT = [("NOT NULL", None), ("0 AND NULL", 0), ("1 AND NULL", None), ("9 % 4", 1), ("9 % 0", None), ("12 & 10", 8), ("12 | 3", 15), ("3 << 3", 24), ("-16 >> 2", -4), ("1 << 64", 0), ("CAST(-7.9 AS integer)", -7), ("6 BETWEEN 7 AND NULL", 0)]


def run(spark, cases, semantics):
    env = Env(semantics=semantics)
    made = [lower(env.value(parse(f"SELECT {sql}", from_optional=True).items[0].expr)) for sql, _ in cases]
    got = []
    for at in range(0, len(made), 10):  # small projections
        row = spark.range(1).select(*[m.alias(f"c{k}") for k, m in enumerate(made[at : at + 10])]).first()
        got += [tuple(x) for x in row]
    return {sql: (g, expect(w)) for (sql, w), g in zip(cases, got) if g != expect(w)}


def test_functions_and_operators(spark):
    assert run(spark, CALLS, "js") == {}


def test_strict_semantics(spark):
    assert run(spark, STRICT, "sqlite") == {}


@pytest.mark.parametrize("sql", ["json_keys('[4]')", "json_keys('{\"k\":1,\"k\":1}')", "uuid_blob('0a1b2c3d')", "json_extract('{', '$.a')"])
def test_errors(spark, sql):
    with pytest.raises(Exception):
        spark.range(1).select(lower(Env().value(parse(f"SELECT {sql}", True).items[0].expr)).alias("c")).collect()


def test_json_valid(spark):
    for x, want in [('{"k":[]}', 1), (" 3 ", 1), ("null", 1), (None, 0), ("", 0), ("{k:1}", 0), ("nothing", 0), ('{"k":1,"k":1}', 0)]:
        assert spark.range(1).select(scalar.json_valid(literal(x)).col).first()[0] == want, x


def wkb(*points, kind=1, srid=None):
    """Little-endian binary geometry as hex."""
    import struct

    head = struct.pack("<BI", 1, kind | (0x20000000 if srid else 0)) + (struct.pack("<I", srid) if srid else b"") + (struct.pack("<I", len(points)) if kind == 2 else b"")
    return (head + b"".join(struct.pack("<dd", *p) for p in points)).hex()


def test_geometry(spark):
    env = Env()
    q = lambda sql: spark.range(1).select(env.value(parse(f"SELECT {sql}", True).items[0].expr).col).first()[0]
    berth, marked, route = wkb((5.25, -60.5)), wkb((5.25, -60.5), srid=4326), wkb((0, 1), (2.5, 3), kind=2)
    assert q(f"st_x('{berth}')") == 5.25 and q(f"st_y('{marked}')") == -60.5 and q(f"st_x('{route}')") is None
    assert q(f"st_astext('{berth}')") == "POINT(5.25 -60.5)" and q(f"st_astext('{route}')") == "LINESTRING(0 1, 2.5 3)"
    assert q(f"st_asgeojson('{marked}')") == '{"type":"Point","coordinates":[5.25,-60.5]}'

"""Line deduplication by overlapping windows of three lines.

Lines are compared without spaces around them. Every three consecutive lines of a document that aren't all blank are
a window, known by two 64-bit hashes. A window that occurs more than once in the corpus is kept where it comes first, by
(doc_id, line number); the lines that its other occurrences cover, merged, are removed. Hashes are counted with partial
aggregates, and the windows are joined with the repeated ones only, so that a passage that every document holds makes no
large group; as both sides of that join are exchanged, adaptive execution can split a hot window.

With ``long_words``, windows of one and of two lines that hold more words than that count as well, in documents of any
length, so that a long passage on one or two lines between differing neighbours is found too.

A null text stays null and, without ``long_words``, a document of fewer than three lines stays as it is. A row without doc_id is left alone and
counts for nothing. Rows that share a doc_id are one place: they don't remove each other's lines at equal positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import _col, shuffled, written


def _windows(docs: DataFrame, doc_id: str, text: str, long_words: int | None = None) -> DataFrame:
    least = 3 if long_words is None else 1
    lines = docs.select(_col(docs, doc_id).alias("d"), F.transform(F.split(_col(docs, text), "\n", -1), lambda x: F.trim(x)).alias("l")).filter(f"d is not null and size(l) >= {least}")
    made = (
        "filter(transform(sequence(0, size(l) - 3), i -> case when l[i] != '' or l[i + 1] != '' or l[i + 2] != '' then"
        " struct(xxhash64(l[i], l[i + 1], l[i + 2]) as h1, xxhash64(17L, l[i + 2], l[i + 1], l[i]) as h2, i as at, 3 as n) end), w -> w is not null)"
    )
    if long_words is not None:
        words = lambda x: f"size(filter(split({x}, '[ \\\\t-\\\\r]+'), x -> x != ''))"
        # n words take 2n - 1 characters at least; shorter windows aren't split
        one = f"case when length(l[i]) > {2 * long_words} and {words('l[i]')} > {long_words} then struct(xxhash64(1L, l[i]) as h1, xxhash64(l[i], 18L) as h2, i as at, 1 as n) end"
        both = "concat(l[i], ' ', l[i + 1])"
        two = f"case when length({both}) > {2 * long_words} and {words(both)} > {long_words} then struct(xxhash64(2L, l[i], l[i + 1]) as h1, xxhash64(19L, l[i + 1], l[i]) as h2, i as at, 2 as n) end"
        some = lambda x, n: f"if(size(l) >= {n}, {x}, array())"
        single, double = (f"filter(transform(sequence(0, size(l) - {n}), i -> {x}), w -> w is not null)" for n, x in ((1, one), (2, two)))
        made = f"concat({single}, {some(double, 2)}, {some(made, 3)})"
    return lines.select("d", F.explode(F.expr(made)).alias("w")).select("d", "w.h1", "w.h2", "w.at", "w.n")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """The rows of docs with ``text`` without later repeats, and ``n_lines`` and ``n_removed`` (long) added."""
    repeated = _windows(docs, doc_id, text, long_words).groupBy("h1", "h2").agg(F.min(F.struct("d", "at")).alias("first"), F.count("*").alias("times")).filter("times > 1").select("h1", "h2", "first")
    repeated = written(repeated, "repeated-windows")
    later = _windows(docs, doc_id, text, long_words).join(repeated, ["h1", "h2"]).filter("first.d != d or first.at != at")
    covered = later.groupBy("d").agg(F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1))))).alias("covered"))
    gone = written(covered, "covered-lines").withColumnRenamed("d", "__d").withColumnRenamed("covered", "__covered")
    rows = docs.join(shuffled(gone), _col(docs, doc_id) == gone["__d"], "left")
    covered_lines = gone["__covered"]
    lines: Column = F.split(_col(docs, text), "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(covered_lines, s["i"]))
    out = {
        text: F.when(covered_lines.isNull(), _col(docs, text)).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n")),
        "n_lines": F.when(_col(docs, text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(F.size(covered_lines), F.lit(0)).cast("long"),
    }
    return rows.select(*[out.pop(c).alias(c) if c in out else _col(docs, c) for c in docs.columns], *[v.alias(k) for k, v in out.items()])

"""Connected components of an edge list, by contraction; every round is written to the shared folder.

In a round each vertex hooks onto its smallest neighbour, if that is smaller than itself, and follows the hooks of
others twice. The edges are relabelled with what was reached, and loops and repeats among them fall away, so that the
edges that a further round reads are few. A vertex is always relabelled with a vertex of its own component, and the
smallest one with itself, so that the labels are final once no edge is left. A round reads each edge once at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import drop_written, written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """From edges (a, b) to rows (v, root): the smallest vertex that v can reach, for every vertex of an edge.

    Loops and repeated edges do no harm; an edge without one of its ends is left out. No edges: no rows.
    """
    left = written(edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    labels, k = None, 0
    while True:
        ends = left.select(F.col("a").alias("v"), F.col("a").alias("w")).union(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hooks = written(ends.groupBy("v").agg(F.min("w").alias("to")), f"{label}-hooks-{k}")
        one = hooks.select(F.col("v").alias("to"), F.col("to").alias("next"))
        two = hooks.join(one, "to").select("v", F.col("next").alias("to"))
        far = written(two.join(two.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("root")), f"{label}-reached-{k}")
        if labels is None:
            fresh = far
        else:
            step = far.select(F.col("v").alias("root"), F.col("root").alias("far"))
            fresh = written(labels.join(step, "root", "left").select("v", F.coalesce("far", "root").alias("root")), f"{label}-{k}")
        moved = left.join(far.select(F.col("v").alias("a"), F.col("root").alias("x")), "a").join(far.select(F.col("v").alias("b"), F.col("root").alias("y")), "b")
        rest = written(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges-{k}")
        for old in (hooks, left, labels, None if fresh is far else far):
            if old is not None:
                drop_written(old)
        labels, left, k = fresh, rest, k + 1
        if left.isEmpty():
            drop_written(left)
            return labels

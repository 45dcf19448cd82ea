"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """Label every vertex that has an edge with a vertex of its component.

    ``edges`` has long columns a and b.  Returns (v, root): one row per vertex,
    equal roots exactly within a component.  Each round maps a vertex to its
    smallest neighbour (itself included), renames the edges and drops loops, so
    with hash-like ids the edge table shrinks by a constant factor a round.
    Every round is written to the shared folder; nothing is collected but one
    row count.  Null ends are ignored, repeated edges and loops are harmless.
    """
    work = stored(edges.where("a is not null and b is not null").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while True:
        both = work.union(work.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")))
        maps.append(hook)
        renamed = (
            work.join(hook.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
            .join(hook.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        work = stored(renamed)
        if work.isEmpty():
            break
    labels = maps.pop()
    while maps:
        step = labels.select(F.col("v").alias("root"), F.col("root").alias("further"))
        labels = maps.pop().join(step, "root", "left").select("v", F.coalesce("further", "root").alias("root"))
        labels = stored(labels)
    return labels

"""Connected components by minimum labels with shortcuts, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import landed


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, component) for every end; the component is its smallest id.

    Each round hooks the larger of two labels onto the smaller one and follows the chains that arise,
    so joins grow with the logarithm of the longest path. Edges inside a component leave the table.
    """
    edges = landed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = landed(
        edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component")),
        "labels",
    )
    # Every round takes at least one label away, so it ends, and with no edge left over.
    while not edges.isEmpty():
        # Every label that is the larger end of an edge gets its smallest partner; then labels are
        # followed to the end of their chains, twice as far each time.
        hooks = landed(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("then"))
            if hooks.join(further, "to", "left_semi").isEmpty():
                break
            hooks = landed(hooks.join(further, "to", "left").select("from", F.coalesce("then", "to").alias("to")), "hooks")
        moved = hooks.withColumnRenamed("from", "component")
        labels = landed(
            labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels"
        )
        a = hooks.select(F.col("from").alias("a"), F.col("to").alias("new_a"))
        b = hooks.select(F.col("from").alias("b"), F.col("to").alias("new_b"))
        moved = edges.join(a, "a", "left").join(b, "b", "left")
        x, y = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
        edges = landed(
            moved.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct(), "edges"
        )
    return labels

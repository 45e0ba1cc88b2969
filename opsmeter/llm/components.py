"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opsmeter.llm.common import remove, scratch, stored


def connected(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every end of ``edges (a, b)``: the smallest id it reaches.

    Each round hangs every vertex on the smallest of its neighbours and itself, follows
    two such steps, and renames the edges by the result, which merges at least every vertex
    that has a smaller neighbour; the edges shrink each round until none is left. Vertices
    only move to smaller ones, so the last one of a component is its smallest. Rows meet by
    key in partial sums (``min``) or joins that adaptive execution splits; nothing is
    collected, and each round's results are stored.

    Loops, repeated and reversed edges change nothing; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    with scratch(spark) as keep:
        placed = _contracted(edges)
        if placed is None:
            return spark.createDataFrame([], "id bigint, component_id bigint")
        keep(placed)
    return placed


def _contracted(edges: DataFrame) -> DataFrame | None:
    spark = edges.sparkSession
    edges = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
        .distinct(),
        "edges",
    )
    placed = None
    while not edges.isEmpty():
        parents = (
            edges.selectExpr("b AS id", "a AS parent")
            .union(edges.selectExpr("a AS id", "a AS parent"))
            .groupBy("id")
            .agg({"parent": "min"})
            .withColumnRenamed("min(parent)", "parent")
        )
        parents = stored(parents, "parents")
        above = parents.selectExpr("id AS parent", "parent AS root")
        jumped = stored(parents.join(above, "parent", "left").selectExpr(
            "id", "coalesce(root, parent) AS root"), "roots")
        remove(spark, parents.stored_at)
        before = [edges.stored_at, jumped.stored_at] + ([] if placed is None else [placed.stored_at])
        left = jumped.selectExpr("id AS a", "root AS new_a")
        right = jumped.selectExpr("id AS b", "root AS new_b")
        edges = stored(
            edges.join(left, "a").join(right, "b")
            .where("new_a <> new_b")
            .selectExpr("least(new_a, new_b) AS a", "greatest(new_a, new_b) AS b")
            .distinct(),
            "edges",
        )
        if placed is None:
            placed = jumped.selectExpr("id", "root AS component_id")
        else:
            moved = jumped.selectExpr("id AS component_id", "root")
            placed = placed.join(moved, "component_id", "left").selectExpr(
                "id", "coalesce(root, component_id) AS component_id"
            )
        placed = stored(placed, "placed")
        for path in before:  # no later round reads them
            remove(spark, path)
    return placed

"""Key checks that keep whole rows where they are.

A count window over the key would move every row, and put a key that holds a
third of the table into one task. Here only keys are shuffled, after map-side
aggregation, and the few offending keys are joined back. Spark sizes that join
at run time: a small key set is broadcast, a large one is a sort-merge join
whose row side adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: str, counted: str = "1") -> DataFrame:
    """Keys held by more than one row; nulls count as one key.

    ``counted`` names a column without nulls to count instead of the rows. Naming one
    that ``df`` computes in an aggregate keeps that aggregate as the other users of
    ``df`` see it, so that they share one shuffle.
    """
    sizes = df.groupBy(key).agg(F.expr(f"count({counted}) AS copies"))
    return sizes.where("copies > 1").select(key)


def unmatched_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent; a null child key is unmatched."""
    wanted = child.select(child_key).distinct()
    known = parent.selectExpr(f"{parent_key} AS known_key").where("known_key IS NOT NULL")
    return wanted.join(known.distinct(), F.expr(f"{child_key} = known_key"), "left_anti")


def mark_rows(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Add a boolean ``flag``: the row's key is one of ``keys`` (unique, null allowed)."""
    marked = keys.selectExpr(f"{keys.columns[0]} AS marked_key", "true AS is_marked")
    # The null-safe test is not the hash key the aggregate above left its rows by,
    # so both join inputs get their own exchange: the shape skew splitting needs.
    joined = df.join(marked, F.expr(f"{key} <=> marked_key"), "left")
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns], f"coalesce(is_marked, false) AS {flag}"
    )


def irregular_matches(fact: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """Keys of ``fact`` that match no row of ``dimension``, or several: ``odd_key``, ``matches``.

    A fact that needs nothing from a dimension but the inner join's effect can be
    weighed by this small frame instead of being shuffled to meet the dimension.
    """
    # both sides in one shuffle: counts per key, summed where they are first
    wanted = fact.selectExpr(f"{key} AS odd_key", "true AS is_wanted", "0L AS matches")
    known = dimension.selectExpr(f"{key} AS odd_key", "false AS is_wanted", "1L AS matches")
    return (
        wanted.unionByName(known)
        .where("odd_key IS NOT NULL")
        .groupBy("odd_key")
        .agg(F.max("is_wanted").alias("is_wanted"), F.sum("matches").alias("matches"))
        .where("is_wanted AND matches <> 1")
        .select("odd_key", "matches")
    )

"""Exact median without bringing the values together.

Spark's own exact percentile keeps every distinct value of a group in one
buffer. Here the middle is located digit by digit instead: three histograms of
at most 2^20 cells, each over the cell the previous one picked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 20
DIGITS = 3


def _cell(value: str, digit: int) -> str:
    return f"shiftright({value}, {DIGIT_BITS * digit})"


def _pick(cells: DataFrame) -> DataFrame:
    """The cell of each side that holds its rank, and the rank left inside that cell."""
    return (
        cells.selectExpr(
            "*", "sum(rows) OVER (PARTITION BY side ORDER BY cell ROWS UNBOUNDED PRECEDING) AS up_to"
        )
        .where("up_to - rows < rank AND rank <= up_to")
        .selectExpr("side", "cell", "rank - (up_to - rows) AS rank")
    )


def weighted_median(values: DataFrame, value: str, weight: str) -> DataFrame:
    """One row, ``median`` (double): the middle of ``value``, each counted ``weight`` times,
    the mean of the two middle ones for an even total, null for no rows.

    ``value`` is a bigint from 0 up to 2^60. ``values`` is read three times, so
    hand in a small projection or a stored table.
    """
    present = values.where(f"{value} IS NOT NULL").select(value, weight)
    # the lower middle (side 0) and the upper one (side 1), counted from 1
    cells = (
        present.groupBy(F.expr(f"{_cell(value, DIGITS - 1)} AS cell"))
        .agg(F.expr(f"sum({weight}) AS rows"))
        .selectExpr("*", "sum(rows) OVER () AS total")
        .selectExpr(
            "cell",
            "rows",
            "posexplode(array((total + 1) div 2, total div 2 + 1)) AS (side, rank)",
        )
    )
    picked = _pick(cells)
    for digit in reversed(range(DIGITS - 1)):
        # two rows at most, one per side
        near = F.broadcast(picked.withColumnRenamed("cell", "parent"))
        cells = (
            present.join(near, F.expr(f"{_cell(value, digit + 1)} = parent"))
            .groupBy("side", "rank", F.expr(f"{_cell(value, digit)} AS cell"))
            .agg(F.expr(f"sum({weight}) AS rows"))
        )
        picked = _pick(cells)
    return picked.agg(F.expr("avg(cell) AS median"))

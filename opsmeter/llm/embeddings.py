"""Near-duplicate embeddings by products of int8 tiles with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import configure, stored
from opsmeter.llm.components import connected

# vectors in a tile, about; two tiles and a strip of their products are in memory at a time
TILE = 4096
STRIP = 512
# above the rounding of all that the bounds leave out
SLACK = 2e-6
# sums of int8 products are exact in single precision up to this many dimensions
EXACT_SINGLE = 2**24 // 127**2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow or underflow."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their step per row, and each row's distance from what the codes stand for."""
    steps = np.abs(units).max(1) / 127
    codes = np.rint(units / steps[:, None]).astype(np.int8)
    errors = np.sqrt(((units - steps[:, None] * codes) ** 2).sum(1))
    return codes, steps, errors


def possible(
    left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach ``threshold``, going by their codes.

    With ``u = s q + r`` and unit vectors, the cosine differs from the product of the coded
    vectors by ``|r_u| |v| + |s_u q_u| |r_v|`` at most, that is by
    ``e_u + (1 + e_u) e_v``. Pairs below the threshold by more are ruled out for certain.
    """
    (a, a_step, a_error), (b, b_step, b_error) = left, right
    kind = np.float32 if a.shape[1] <= EXACT_SINGLE else np.float64
    products = (a.astype(kind) @ b.astype(kind).T) * (a_step.astype(kind)[:, None] * b_step.astype(kind)[None, :])
    bound = a_error[:, None] + (1 + a_error)[:, None] * b_error[None, :]
    return np.nonzero(products >= threshold - SLACK - bound.astype(kind))


def tile_links(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(i, j)`` of two tiles, or of one with itself (each pair once), that link.

    Candidates from the codes are computed anew in double precision.
    """
    other = left if right is None else right
    rows, columns = [], []
    for start in range(0, len(left["codes"]), STRIP):
        strip = tuple(left[k][start : start + STRIP] for k in ("codes", "steps", "errors"))
        i, j = possible(strip, (other["codes"], other["steps"], other["errors"]), threshold)
        i = i + start
        if right is None:
            i, j = i[i < j], j[i < j]
        for first in range(0, len(i), 1 << 15):
            some = slice(first, first + (1 << 15))
            cosine = np.einsum("nd,nd->n", left["units"][i[some]], other["units"][j[some]])
            keep = cosine >= threshold
            rows.append(i[some][keep])
            columns.append(j[some][keep])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (empty, empty)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row it reaches by the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _tile_table(classes: DataFrame, tiles: int, kind: str) -> DataFrame:
    """``tile, dim, ids, copies, raw``: the vectors of each tile as bytes."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        vectors = table["vector"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "tile": pa.array([table["tile"][0].as_py()], pa.int32()),
                "dim": pa.array([table["dim"][0].as_py()], pa.int32()),
                "ids": pa.array([table["rep"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "copies": pa.array([table["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "raw": pa.array([flat.astype(kind).tobytes()], pa.binary()),
            }
        )

    dealt = classes.withColumn("tile", F.expr(f"cast(pmod(xxhash64(rep), {tiles}) AS INT)"))
    return dealt.groupBy("tile", "dim").applyInArrow(
        gather, "tile int, dim int, ids binary, copies binary, raw binary"
    )


def _loaded(ids: bytes, copies: bytes, raw: bytes, dim: int, kind: str) -> dict:
    units = unit(np.frombuffer(raw, kind).reshape(-1, dim))
    codes, steps, errors = quantised(units)
    return {
        "ids": np.frombuffer(ids, "<i8"), "copies": np.frombuffer(copies, "<i8"),
        "units": units, "codes": codes, "steps": steps, "errors": errors,
    }


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    tile: int = TILE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors link when their cosine in double precision is ``threshold`` or more;
    ``n_links`` counts the other vectors a vector links with, the component is the smallest
    id reachable by links, and its own vector is kept.

    Equal vectors are one class, which keeps their number. Classes are dealt into tiles of
    about ``tile`` vectors; every pair of tiles is one task's step: products of int8
    codes, an error bound per vector that holds for certain, and full precision for the
    pairs that the bound leaves open. A step returns at most one row per vector, its number
    of links there and the smallest vector it reaches there, never the pairs.

    Vectors that are null, empty or zero, or that hold null or non-finite values, link with
    nothing, as do those without an id, whose component is null; all of them are kept.
    Only vectors of the same length are compared. A row listed twice counts as two
    vectors of one id. Further columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    configure(spark)
    single = dict(vectors.dtypes)[embedding] == "array<float>"
    kind, element = ("<f4", "FLOAT") if single else ("<f8", "DOUBLE")
    rows = vectors.selectExpr(
        f"cast(`{vec_id}` AS BIGINT) AS vec_id", f"cast(`{embedding}` AS ARRAY<{element}>) AS vector"
    )
    usable = """vec_id IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0)
        AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x)
            AND abs(x) < cast('Infinity' AS DOUBLE))"""
    rows = rows.selectExpr("vec_id", f"IF(coalesce({usable}, false), vector, NULL) AS vector")
    classes = stored(
        rows.where("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("vector")),
        "vectors",
    )
    tiles = max(1, -(-classes.count() // tile))
    table = stored(_tile_table(classes, tiles, kind), "tiles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left = _loaded(row["ids"], row["copies"], row["raw"], row["dim"], kind)
                same = row["i"] == row["j"]
                right = None if same else _loaded(
                    row["other_ids"], row["other_copies"], row["other_raw"], row["dim"], kind
                )
                i, j = tile_links(left, right, threshold)
                ids, copies = left["ids"], left["copies"]
                if right is not None:
                    j = j + len(ids)
                    ids = np.concatenate((ids, right["ids"]))
                    copies = np.concatenate((copies, right["copies"]))
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                linked = np.flatnonzero(links)
                roots = _roots(len(ids), i, j)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[linked]),
                        pa.array(links[linked].astype(np.int64)),
                        pa.array(ids[roots[linked]]),
                    ],
                    ["rep", "links", "root"],
                )

    left = table.selectExpr("*", f"explode(sequence(tile, {tiles - 1})) AS j").withColumnRenamed("tile", "i")
    right = table.selectExpr(
        "tile AS j", "dim", "ids AS other_ids", "copies AS other_copies", "raw AS other_raw",
        "explode(sequence(0, tile)) AS i",
    )
    # a tile paired with itself needs no second copy
    right = right.selectExpr(
        "i", "j", "dim", *[f"IF(i = j, NULL, {c}) AS {c}" for c in ("other_ids", "other_copies", "other_raw")]
    )
    cells = left.join(right, ["i", "j", "dim"])
    found = stored(cells.mapInArrow(link, "rep bigint, links bigint, root bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = connected(found.selectExpr("rep AS a", "root AS b")).withColumnRenamed("id", "rep")
    placed = stored(
        classes.join(links, "rep", "left")
        .join(reached, "rep", "left")
        .selectExpr(
            "vector", "coalesce(links, 0L) + copies - 1 AS links",
            "coalesce(component_id, rep) AS component",
        ),
        "placed",
    )
    return rows.join(placed, "vector", "left").selectExpr(
        "vec_id",
        "coalesce(links, 0L) AS n_links",
        "coalesce(component, vec_id) AS component_id",
        "coalesce(vec_id = coalesce(component, vec_id), true) AS kept",
    )

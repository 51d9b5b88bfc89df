"""Spatial joins through grid cells: an equi-join on cells, then the exact predicate. No inequality join of whole tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.contracts import ContractError
from quernstone.sources.shared import written

#: Points, and polygons or their corners, of a cell that are compared in one call, and pairs in a batch of what it returns.
BLOCK_POINTS, BLOCK_POLYGONS, BLOCK_CORNERS, BATCH_PAIRS = 8192, 1024, 131_072, 65_536
#: Cells (their three numbers and two counts) that are broadcast.
BROADCAST_CELLS = 200_000


def _whole(s: str) -> Column:
    return F.expr(f"{s}x0 is not null and {s}y0 is not null and {s}x1 is not null and {s}y1 is not null")


def _level(s: str, cell: float) -> Column:
    """The power of two by which ``cell`` must grow to be as wide as a box's longer side, 0 at least."""
    side = F.greatest(F.col(f"{s}x1") - F.col(f"{s}x0"), F.col(f"{s}y1") - F.col(f"{s}y0"))
    return F.coalesce(F.greatest(F.lit(0), F.ceil(F.log2(side / cell))).cast("int"), F.lit(0))  # the logarithm of 0, a point, is null


def _cells(df: DataFrame, s: str, cell: float) -> DataFrame:
    """A row for each cell ``_cx, _cy`` of the grid ``_on`` that a box meets."""
    size = F.pow(F.lit(2.0), F.col("_on")) * cell
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"{s}{a}0") / size), F.floor(F.col(f"{s}{a}1") / size)))
    return df.withColumn("_cx", span("x")).withColumn("_cy", span("y"))


def bbox_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes that meet (edges included): both sides have ``x0, y0, x1, y1`` prefixed ``l_`` or ``r_``.

    Boxes may be of any size. Each is put into the cells of the grid whose cells are at least as wide as its longer side (``cell``
    times a power of two, ``cell`` at least), which are four at most. Two boxes meet on the coarser of their grids: each side is also entered, by the
    cells of its own box, on the coarser grids that the other side has (a grid for each power of two, so few). A pair that shares several cells
    is found in the first of them only. Boxes with a null meet nothing.
    """
    sides = {"l_": left, "r_": right}
    own = {s: df.where(_whole(s)).withColumn("_level", _level(s, cell)) for s, df in sides.items()}
    # one number for each power of two that occurs
    there = {s: sorted(r._level for r in df.select("_level").distinct().collect()) for s, df in own.items()}

    def entered(s: str, other: str, strict: bool) -> DataFrame:
        """Entries on the levels of the other side that are above the box's own (or equal to it)."""
        up = F.array(*[F.lit(k) for k in there[other]]) if there[other] else F.array().cast("array<int>")
        on = F.filter(up, lambda k: (k > F.col("_level")) if strict else (k >= F.col("_level")))
        return own[s].withColumn("_on", F.explode(on))

    cells = lambda df, s: _cells(df, s, cell).drop("_level")
    meet = F.expr("l_x0 <= r_x1 and r_x0 <= l_x1 and l_y0 <= r_y1 and r_y0 <= l_y1")
    size = F.pow(F.lit(2.0), F.col("_on")) * cell
    first = (F.col("_cx") == F.greatest(F.floor(F.col("l_x0") / size), F.floor(F.col("r_x0") / size))) & (F.col("_cy") == F.greatest(F.floor(F.col("l_y0") / size), F.floor(F.col("r_y0") / size)))
    at_own = {s: cells(df.withColumn("_on", F.col("_level")), s) for s, df in own.items()}
    # the left box's level is at least the right one's, or below it
    found = [at_own["l_"].join(cells(entered("r_", "l_", False), "r_"), ["_on", "_cx", "_cy"]), cells(entered("l_", "r_", True), "l_").join(at_own["r_"], ["_on", "_cx", "_cy"])]
    columns = [*left.columns, *right.columns]
    return functools.reduce(DataFrame.unionAll, [f.where(meet & first).select(*columns) for f in found])


def inside(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Even-odd rule for points against a polygon's rings (NaN between them, so holes count); points on lower or left edges are inside."""
    cut = np.flatnonzero(np.isnan(px))
    if len(cut):
        edges = np.concatenate([[-1], cut, [len(px)]])
        parts = [inside(x, y, px[a + 1 : b], py[a + 1 : b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return np.logical_xor.reduce(parts)
    ax, ay, bx, by = px, py, np.roll(px, -1), np.roll(py, -1)
    out = np.zeros(len(x), bool)
    for k in range(len(ax)):
        if ay[k] != by[k]:
            crosses = (ay[k] > y) != (by[k] > y)
            out ^= crosses & (x < (bx[k] - ax[k]) * (y - ay[k]) / (by[k] - ay[k]) + ax[k])
    return out


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """``points``: ``point, x, y``; ``polygons``: ``polygon, px, py`` (arrays; a polygon's rings follow each other, NaN between them). Returns ``point, polygon``.

    As in ``bbox_join``, a polygon is put into four cells at most, of the grid that fits its size, and a point into the one cell where it lies of each
    grid that has polygons. A cell's points and its polygons are dealt into blocks, as many as their numbers need, and each
    block of points meets each block of polygons in one call. So pairs are first made there, out of columns, and no cell is one task.
    """
    corner = lambda f, c: f(F.filter(c, lambda v: ~F.isnan(v)))
    rings = polygons.select("polygon", *[F.col(c).cast("array<double>").alias(c) for c in ("px", "py")])
    boxes = rings.select("*", *[corner(f, c).alias(f"r_{c[1]}{k}") for c in ("px", "py") for k, f in ((0, F.array_min), (1, F.array_max))])
    boxes = boxes.where(_whole("r_")).withColumn("_on", _level("r_", cell))
    # one number for each power of two that occurs
    levels = sorted(r._on for r in boxes.select("_on").distinct().collect())
    grids = F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")
    size = F.pow(F.lit(2.0), F.col("_on")) * cell
    spots = points.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    spots = spots.withColumn("_on", F.explode(grids)).withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    boxes = _cells(boxes, "r_", cell)

    at = ["_on", "_cx", "_cy"]
    most = spots.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("_n"))
    most = most.join(boxes.groupBy(*at).agg(F.ceil(F.greatest(F.count("*") / BLOCK_POLYGONS, F.sum(F.size("px")) / BLOCK_CORNERS)).alias("_m")), at)
    most = written(most, "cells")
    most = most.hint("broadcast" if most.count() <= BROADCAST_CELLS else "merge")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    spots = spots.join(most, at).select(*at, F.expr("pmod(xxhash64(point, x, y), _n)").alias("_p"), upto("_m").alias("_q"), "point", "x", "y")
    boxes = boxes.join(most, at).select(*at, upto("_n").alias("_p"), F.expr("pmod(xxhash64(polygon, px, py), _m)").alias("_q"), "polygon", "px", "py", "r_x0", "r_y0", "r_x1", "r_y1")

    def run(spots: pa.Table, boxes: pa.Table) -> pa.Table:
        x, y = spots["x"].to_numpy(), spots["y"].to_numpy()
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        first, last = np.searchsorted(x, boxes["r_x0"].to_numpy(), "left"), np.searchsorted(x, boxes["r_x1"].to_numpy(), "right")
        low, high = boxes["r_y0"].to_numpy(), boxes["r_y1"].to_numpy()
        (xs, px), (ys, py) = ((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (boxes["px"].combine_chunks(), boxes["py"].combine_chunks()))
        kind = pa.schema([("point", spots["point"].type), ("polygon", boxes["polygon"].type)])
        out, held, n = [], [], 0
        for k in range(boxes.num_rows):
            part = y[first[k] : last[k]]
            near = np.flatnonzero((part >= low[k]) & (part <= high[k])) + first[k]
            near = near[inside(x[near], y[near], px[xs[k] : xs[k + 1]], py[ys[k] : ys[k + 1]])] if len(near) else near
            if len(near):
                held.append((order[near], np.full(len(near), k)))
                n += len(near)
            if held and (n >= BATCH_PAIRS or k == boxes.num_rows - 1):
                pair = [pa.array(np.concatenate(v)) for v in zip(*held, strict=True)]
                out += pa.table([spots["point"].take(pair[0]), boxes["polygon"].take(pair[1])], schema=kind).to_batches()
                held, n = [], 0
        return pa.Table.from_batches(out, schema=kind)

    kinds = {"point": dict(spots.dtypes)["point"], "polygon": dict(boxes.dtypes)["polygon"]}
    both = spots.groupBy(*at, "_p", "_q").cogroup(boxes.groupBy(*at, "_p", "_q"))
    return both.applyInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def logical_features(fragments: DataFrame, key: str, order: list[str], attributes: list[str], x: str, y: str) -> DataFrame:
    """Fragments of one feature together: its attributes (which must agree), parts in order, bounds and a digest of the parts.

    ``x`` and ``y`` are arrays of a fragment's coordinates. A feature's fragments are few.
    """
    part = F.struct(*order, F.col(x).alias("x"), F.col(y).alias("y"))
    kinds = [F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit("\u0000"))).alias(f"_{a}") for a in attributes]
    g = fragments.groupBy(key).agg(*[F.first(a).alias(a) for a in attributes], *kinds, F.sort_array(F.collect_list(part)).alias("parts"))
    bad = g.where(" or ".join(f"`_{a}` > 1" for a in attributes)).first() if attributes else None
    if bad is not None:
        raise ContractError(f"{bad[key]} has conflicting attributes")
    every = lambda c: F.flatten(F.transform("parts", lambda p: p[c]))
    bounds = [f(every(c)).alias(f"r_{c}{k}") for c in ("x", "y") for k, f in ((0, F.array_min), (1, F.array_max))]
    digest = F.sha2(F.to_json(F.transform("parts", lambda p: F.struct(p["x"], p["y"]))), 256).alias("parts_sha256")
    return g.select(key, *attributes, F.size("parts").alias("fragments"), *bounds, digest, "parts")


def features_in(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Features whose bounds meet a box, edges included; a box across the antimeridian (x0 > x1) is two."""
    rows = (F.col("r_y0") <= y1) & (F.col("r_y1") >= y0)
    east, west = F.col("r_x1") >= x0, F.col("r_x0") <= x1
    return features.where(rows & ((east & west) if x0 <= x1 else (east | west)))

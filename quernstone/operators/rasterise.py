"""Polygons and lines as cells of a grid: a scanline join of edges and rows, all in DataFrame functions.

Cell (row, col) covers ``[col, col + 1) x [row, row + 1)`` times ``cell``; row 0 begins at y = 0, and rows and columns may be negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """``key, ax, ay, bx, by``: the edges of all rings (arrays of ``x, y``), each ring closed. Rings of under three points have none."""
    ring = polygons.select(key, F.explode(rings).alias("r")).where(F.size("r") >= 3)
    corner = ring.select(key, "r", F.posexplode("r").alias("i", "a"))
    b = F.element_at("r", F.pmod(F.col("i") + 1, F.size("r")) + 1)
    return corner.select(key, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def polygon_runs(polygons: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``key, row, x0, x1``: what of each row's centre line lies inside, by the even-odd rule (so inner rings are holes).

    Every edge meets the rows whose centre lies between its ends (the lower end included); the crossings of a polygon's row, sorted, pair up.
    A row of a polygon is sorted in one task, however large the polygon is.
    """
    e = edges(polygons, key, rings)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    span = F.sequence((F.floor(low / cell - 0.5)).cast("long"), (F.ceil(high / cell - 0.5)).cast("long"))
    hit = e.where("ay <> by").select("*", F.explode(span).alias("row")).withColumn("at", (F.col("row") + 0.5) * cell)
    hit = hit.where("(ay > at) <> (by > at)").select(key, "row", (F.expr("(bx - ax) * (at - ay) / (by - ay) + ax")).alias("x0"))
    line = Window.partitionBy(key, "row").orderBy("x0")
    return hit.select(key, "row", "x0", F.lead("x0").over(line).alias("x1"), F.row_number().over(line).alias("_i")).where("_i % 2 = 1").drop("_i")


def rasterise_polygons(polygons: DataFrame, key: str, rings: str, order: str, value: str, cell: float) -> DataFrame:
    """``row, col, value``: cells whose centre is inside a polygon; of several the one of the highest ``order`` (then value) wins."""
    runs = polygon_runs(polygons, key, rings, cell)
    span = F.sequence(F.floor(F.col("x0") / cell - 0.5).cast("long"), F.ceil(F.col("x1") / cell - 0.5).cast("long"))
    centre = (F.col("col") + 0.5) * cell
    inside = runs.select(key, "row", "x0", "x1", F.explode(span).alias("col")).where((centre >= F.col("x0")) & (centre < F.col("x1"))).select(key, "row", "col")
    burnt = inside.join(polygons.select(key, F.col(order).alias("_o"), F.col(value).alias("_v")), key)
    return burnt.groupBy("row", "col").agg(F.max(F.struct("_o", "_v")).alias("_w")).select("row", "col", F.col("_w._v").alias("value"))


def rasterise_lines(lines: DataFrame, points: str, cell: float) -> DataFrame:
    """``row, col, length``: the length of all lines (arrays of ``x, y``) in each cell; segments are cut at every border of a cell."""
    seg = lines.select(F.col(points).alias("p")).where(F.size("p") >= 2).select("p", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "a"))
    b = F.element_at("p", F.col("i") + 2)
    seg = seg.select(F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")).where("xa <> xb or ya <> yb")

    def cuts(a: str, b: str):
        borders = F.sequence(F.ceil(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
        some = (F.col(a) != F.col(b)) & (F.ceil(F.least(a, b) / cell) <= F.floor(F.greatest(a, b) / cell))
        return F.when(some, F.transform(borders, lambda k: (k * cell - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.array().cast("array<double>"))

    t = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("xa", "xb"), cuts("ya", "yb")), lambda v: (v >= 0) & (v <= 1))))
    part = seg.withColumn("t", t).select("*", F.posexplode(F.slice("t", 1, F.size("t") - 1)).alias("j", "t0")).withColumn("t1", F.element_at("t", F.col("j") + 2))
    mid = (F.col("t0") + F.col("t1")) / 2
    at = lambda a, b: F.floor((F.col(a) + mid * (F.col(b) - F.col(a))) / cell).cast("long")
    length = (F.col("t1") - F.col("t0")) * F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    return part.select(at("ya", "yb").alias("row"), at("xa", "xb").alias("col"), length.alias("l")).groupBy("row", "col").agg(F.sum("l").alias("length"))

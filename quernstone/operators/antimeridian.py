"""Geometry across the antimeridian: rings and lines in longitudes from -180 to 180, cut there, in array functions.

Two neighbouring points more than 180 degrees apart are joined the short way round, so the edge crosses the antimeridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POINT = "struct<x double, y double>"


def _at(a: Column, i: Column) -> Column:
    return F.element_at(a, F.pmod(i, F.size(a)) + 1)


def unwrapped(features: DataFrame, key: str, points: str) -> DataFrame:
    """``key, u, was``: points with whole turns added, so that none is over 180 degrees from the one before; linear in their number.

    Only features that have such a pair are taken apart; a feature's points are put in order in one task. Keys must be unique and not null.
    """
    f = features.select(key, F.col(points).cast(f"array<{_POINT}>").alias("was"))
    jumps = F.exists(F.sequence(F.lit(1), F.greatest(F.size("was") - 1, F.lit(1))), lambda i: F.coalesce(F.abs(F.get("was", i)["x"] - F.get("was", i - 1)["x"]) > 180, F.lit(False)))
    f = f.withColumn("_jumps", F.coalesce(jumps, F.lit(False)))
    line = Window.partitionBy(key).orderBy("i")
    p = f.where("_jumps").select(key, F.posexplode("was").alias("i", "p")).withColumn("step", F.col("p.x") - F.lag("p.x").over(line))
    turn = F.sum(F.when(F.col("step") > 180, -360.0).when(F.col("step") < -180, 360.0).otherwise(0.0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    p = p.select(key, "i", (F.col("p.x") + turn).alias("x"), F.col("p.y").alias("y"))
    moved = p.groupBy(F.col(key).alias("_k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("_u"))
    return f.join(moved, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_u", "was").alias("u"), "was")


def _side(ring: Column, border: float, keep_below: bool) -> Column:
    """The part of a ring on one side of the meridian ``border``: each edge gives its start, if that is inside, and its crossing."""
    inside = (lambda p: p["x"] <= border) if keep_below else (lambda p: p["x"] >= border)

    def edge(a: Column, i: Column) -> Column:
        b = _at(ring, i + 1)
        cross = F.struct(F.lit(border).alias("x"), (a["y"] + (b["y"] - a["y"]) * (F.lit(border) - a["x"]) / (b["x"] - a["x"])).alias("y"))
        return F.array_compact(F.array(F.when(inside(a), F.struct(a["x"].alias("x"), a["y"].alias("y"))), F.when((a["x"] != b["x"]) & (inside(a) != inside(b)), cross)))

    return F.flatten(F.transform(ring, edge))


def ring_area(ring: Column) -> Column:
    """The area of a closed or open ring, without sign, in square degrees."""
    terms = F.transform(ring, lambda a, i: a["x"] * _at(ring, i + 1)["y"] - _at(ring, i + 1)["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def _moved(ring: Column, by: float) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + by).alias("x"), p["y"].alias("y")))


def cut_rings(features: DataFrame, key: str, ring: str) -> DataFrame:
    """``key, part, ring``: each ring cut at the antimeridian, parts from west to east of the unwrapped ring, longitudes back within -180 to 180.

    A ring that doesn't cross stays as it is (part 0). Rings are open (the last point isn't the first again) and must not go round a
    pole; parts of fewer than three points are left out. Concave rings that cross several times give a part
    a side, joined along the antimeridian; areas add up to the ring's.
    """
    u = unwrapped(features.where(F.size(ring) >= 3), key, ring)
    u = u.withColumns({"low": F.array_min(F.transform("u", lambda p: p["x"])), "high": F.array_max(F.transform("u", lambda p: p["x"]))})
    u = u.withColumn("u", F.when(F.col("low") < -180, _moved(F.col("u"), 360.0)).otherwise(F.col("u"))).withColumn("crosses", (F.col("low") < -180) | (F.col("high") > 180))
    west, east = _side(F.col("u"), 180.0, True), _moved(_side(F.col("u"), 180.0, False), -360.0)
    parts = u.withColumn("parts", F.when(F.col("crosses"), F.array(west, east)).otherwise(F.array("was")))
    return parts.select(key, F.posexplode("parts").alias("part", "ring")).where(F.size("ring") >= 3)


def cut_lines(features: DataFrame, key: str, line: str) -> DataFrame:
    """``key, part, line``: each line cut where it crosses the antimeridian, any number of times, parts in the line's order (both ends at the cut)."""
    f = features.select(key, F.col(line).alias("p")).where(F.size("p") >= 2)
    point = f.select(key, "p", F.posexplode("p").alias("i", "a")).withColumn("b", F.when(F.col("i") + 1 < F.size("p"), F.element_at("p", F.col("i") + 2)))
    jump = F.col("b.x") - F.col("a.x")
    edge = F.when(jump > 180, -180.0).when(jump < -180, 180.0)  # where the first part ends
    far = F.when(jump > 180, F.col("b.x") - 360).when(jump < -180, F.col("b.x") + 360)
    y = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (edge - F.col("a.x")) / (far - F.col("a.x"))
    rows = F.array_compact(F.array(
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("new"), F.col("a.x").alias("x"), F.col("a.y").alias("y")),
        F.when(edge.isNotNull(), F.struct(F.lit(1).alias("s"), F.lit(0).alias("new"), edge.alias("x"), y.alias("y"))),
        F.when(edge.isNotNull(), F.struct(F.lit(2).alias("s"), F.lit(1).alias("new"), (-edge).alias("x"), y.alias("y"))),
    ))
    flat = point.select(key, "i", F.explode(rows).alias("r")).select(key, "i", "r.*")
    flat = flat.withColumn("part", F.sum("new").over(Window.partitionBy(key).orderBy("i", "s").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return flat.groupBy(key, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"))  # a line's own points


def read_boxes(features: DataFrame, fid: str, west: float, south: float, east: float, north: float, box: tuple[str, str, str, str] = ("r_x0", "r_y0", "r_x1", "r_y1")) -> DataFrame:
    """Features whose box meets a window, edges included; a window across the antimeridian (west > east) is read as its two halves.

    A feature in both halves comes once; so does a feature id that several sources or parts hold, by its smallest row.
    """
    a, b, c, d = box
    meets = lambda w, e: (F.col(a) <= e) & (F.col(c) >= w) & (F.col(b) <= north) & (F.col(d) >= south)
    found = features.where(meets(west, east) if west <= east else meets(west, 180.0) | meets(-180.0, east))
    rest = [c for c in features.columns if c != fid]
    return found.groupBy(fid).agg(F.min(F.struct(*rest)).alias("_r")).select(fid, "_r.*").select(*features.columns)

"""Boxes stored so that a query box reads few files and row groups: quadtree levels, Morton keys, sorted Parquet."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each axis in a key, and of the coarse key that names a folder.
BITS, ZONE_BITS = 16, 3
#: Key ranges of a query box, all levels together: as many comparisons stay within what a filter is compiled for.
RANGES = 64

_MASKS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(c: Column) -> Column:
    """The 16 bits of a number at every second place."""
    c = c.cast("long")
    for shift, mask in _MASKS:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def morton(ix: Column, iy: Column) -> Column:
    """Bits of two numbers of ``BITS`` bits in turn: near cells have near keys."""
    return _spread(ix).bitwiseOR(F.shiftleft(_spread(iy), 1))


def _step(low: float, high: float) -> float:
    return (high - low) / (1 << BITS) or 1.0


def _cell(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor((c - low) / _step(low, high)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def write_index(features: DataFrame, path: str, domain: tuple[float, float, float, float], box: Sequence[str] = ("r_x0", "r_y0", "r_x1", "r_y1"), rows_per_file: int = 0) -> None:
    """Write ``features`` under ``path``: ``level`` (0: points; k: longest side up to 2 ** k cells), ``zone`` (leading bits), sorted by ``z``.

    ``z`` is the Morton key of the box's lower left corner over ``domain`` (``x0, y0, x1, y1``; corners outside count to the border's cells). A box of level
    k that meets a query box has its corner at most 2 ** k cells before it, so each level is searched in a window of its own and one
    large box doesn't widen the search for small ones. Rows with a null in their box are at level -1, which no search reads.
    One range exchange; a folder's files are ranges of keys.
    """
    spark, (x0, y0, x1, y1) = features.sparkSession, domain
    a, b, c, d = (F.col(v).cast("double") for v in box)
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    side = F.greatest((c - a) / _step(x0, x1), (d - b) / _step(y0, y1))
    level = F.when(known, F.when(side <= 0, 0).otherwise(F.greatest(F.ceil(F.log2(side)), F.lit(0)) + 1)).otherwise(-1).cast("int")
    z = F.when(known, morton(_cell(a, x0, x1), _cell(b, y0, y1))).otherwise(0)
    keyed = features.withColumns({"level": level, "z": z}).withColumn("zone", F.shiftright("z", 2 * (BITS - ZONE_BITS)).cast("int"))
    writer = keyed.repartitionByRange("level", "z").sortWithinPartitions("level", "z").write.partitionBy("level", "zone")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(f"{path}/rows")
    levels = [r.level for r in spark.read.parquet(f"{path}/rows").select("level").distinct().collect()]  # at most BITS + 2 levels or so
    spark.createDataFrame([(json.dumps({"domain": list(domain), "box": list(box), "levels": sorted(levels)}),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def key_ranges(ix0: int, iy0: int, ix1: int, iy1: int, most: int = 8) -> list[tuple[int, int]]:
    """Ranges of Morton keys that cover the cells of a window, ends included, at most ``most``: quadrants are cut breadth first, then neighbours merge."""
    whole, edge = [], [(0, 0, BITS)]
    while edge and len(whole) + len(edge) < 4 * most:
        cut = []
        for x, y, bits in edge:
            size = 1 << bits
            if x > ix1 or y > iy1 or x + size <= ix0 or y + size <= iy0:
                continue
            if bits == 0 or (x >= ix0 and y >= iy0 and x + size - 1 <= ix1 and y + size - 1 <= iy1):
                whole.append((x, y, bits))
            else:
                half = size >> 1
                cut += [(x + i * half, y + j * half, bits - 1) for j in (0, 1) for i in (0, 1)]
        edge = cut
    edge = [(x, y, b) for x, y, b in edge if not (x > ix1 or y > iy1 or x + (1 << b) <= ix0 or y + (1 << b) <= iy0)]
    at = lambda x, y: sum(((x >> k & 1) << (2 * k)) | ((y >> k & 1) << (2 * k + 1)) for k in range(BITS))
    ranges = sorted((at(x, y), at(x, y) + (1 << (2 * b)) - 1) for x, y, b in whole + edge)
    found = merged(ranges)
    while len(found) > most:  # the smallest gap closes
        k = min(range(len(found) - 1), key=lambda i: found[i + 1][0] - found[i][1])
        found[k : k + 2] = [(found[k][0], found[k + 1][1])]
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def search(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Stored rows whose box meets the query box, edges included; one across the antimeridian (x0 > x1) is two.

    Folders of other levels and zones aren't listed, key ranges reach the Parquet scan as pushed filters and skip row groups, and the
    exact test follows.
    """
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    (lx, ly, hx, hy), (a, b, c, d) = meta["domain"], meta["box"]
    rows = spark.read.parquet(f"{path}/rows")
    spans = [(x0, x1)] if x0 <= x1 else [(x0, math.inf), (-math.inf, x1)]
    near, exact, every = F.lit(False), F.lit(False), []
    clip = lambda v, low, high: int(min(max(math.floor((v - low) / _step(low, high)), 0), (1 << BITS) - 1)) if math.isfinite(v) else (0 if v < 0 else (1 << BITS) - 1)
    levels = [k for k in meta["levels"] if k >= 0]
    most = max(1, min(16, RANGES // max(1, len(levels) * len(spans))))
    for west, east in spans:
        for level in levels:
            back = 0 if level == 0 else 1 << (level - 1)
            reach = (clip(west - back * _step(lx, hx), lx, hx), clip(y0 - back * _step(ly, hy), ly, hy), clip(east, lx, hx), clip(y1, ly, hy))
            for low, high in key_ranges(*reach, most):
                zones = [low >> 2 * (BITS - ZONE_BITS), high >> 2 * (BITS - ZONE_BITS)]
                every.append((low, high))
                near |= (F.col("level") == level) & F.col("zone").between(*zones) & F.col("z").between(low, high)
        exact |= (F.col(a) <= east) & (F.col(c) >= west)
    # once more without folders, which the scan can't test: this form is what reaches the Parquet readers
    keys = F.lit(False)
    for low, high in merged(every):
        keys |= F.col("z").between(low, high)
    return rows.where(keys & near & exact & (F.col(b) <= y1) & (F.col(d) >= y0)).drop("level", "zone", "z")

"""Tiles of one field with what lies around them: borders are exchanged between tiles, so windows don't stop at a tile's edge."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.raster import OUTPUTS, access, terrain

#: What the furthest output (the nearest trail) looks at, in metres.
HALO = 100_000.0


def _strip(layer: str, cols: int, r0: Column, r1: Column, c0: Column, c1: Column) -> Column:
    """Rows r0..r1, columns c0..c1 (ends included) of a row-major array."""
    return F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.slice(layer, r * cols + c0 + 1, c1 - c0 + 1)))


def border_strips(tiles: DataFrame, layers: list[str], rows: int, cols: int, halo: int) -> DataFrame:
    """For each tile ``tx, ty`` and each tile within ``halo`` cells of it, itself too: what of the first lies in the second's padded grid.

    ``tx, ty`` (whom it is for)``, top, left`` (place in the padded grid)``, high, wide`` and the layers, cut. Field rows are
    ``ty * rows + r``, columns ``tx * cols + c``. Only strips move, not tiles; strips for tiles that don't exist are dropped by an equi-join.
    """
    down, across = math.ceil(halo / rows), math.ceil(halo / cols)
    steps = [(dx, dy) for dy in range(-down, down + 1) for dx in range(-across, across + 1)]
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    # row r of the sender is row r - dy * rows of the receiver's core, whose padded grid has -halo .. rows + halo - 1
    cut = tiles.select("tx", "ty", *layers, around.alias("d")).withColumns({
        "r0": F.greatest(F.lit(0), F.col("d.dy") * rows - halo), "r1": F.least(F.lit(rows - 1), F.col("d.dy") * rows + rows + halo - 1),
        "c0": F.greatest(F.lit(0), F.col("d.dx") * cols - halo), "c1": F.least(F.lit(cols - 1), F.col("d.dx") * cols + cols + halo - 1),
    })
    strips = cut.where("r0 <= r1 and c0 <= c1").select(
        (F.col("tx") + F.col("d.dx")).alias("tx"), (F.col("ty") + F.col("d.dy")).alias("ty"),
        (F.col("r0") - F.col("d.dy") * rows + halo).alias("top"), (F.col("c0") - F.col("d.dx") * cols + halo).alias("left"), (F.col("r1") - F.col("r0") + 1).alias("high"), (F.col("c1") - F.col("c0") + 1).alias("wide"),
        *[_strip(a, cols, F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1")).alias(a) for a in layers],
    )
    return strips.join(tiles.select("tx", "ty"), ["tx", "ty"], "left_semi")


def padded(strips: pd.DataFrame, layer: str, rows: int, cols: int, halo: int) -> np.ndarray:
    """The grid of one tile with its halo; NaN where no tile is."""
    out = np.full((rows + 2 * halo, cols + 2 * halo), np.nan)
    for top, left, high, wide, values in zip(strips.top, strips.left, strips.high, strips.wide, strips[layer], strict=True):
        out[top : top + high, left : left + wide] = np.array(values, float).reshape(high, wide)
    return out


def sample_field(tiles: DataFrame, blocks: DataFrame, rows: int, cols: int, cell: float = 250.0, halo: int | None = None) -> DataFrame:
    """``tiles``: ``tx, ty, elevation, access, trails`` (row-major arrays of rows x cols); ``blocks``: ``tx, ty, block, row, col, people``.

    Returns ``block`` and the values of its cell (``raster.OUTPUTS``), NaN as null, with windows over the whole field: each tile gets the
    border strips of the tiles around it (``halo`` cells, 100 km by default) and samples its own core. Cells of no tile are
    unknown. A tile's padded grid and its blocks meet in one task; both are bounded by the tile's size and the halo. A tile without
    blocks does nothing; one whose padded grid has no elevation gives nulls, and may have blocks without people only.
    """
    h = math.ceil(HALO / cell) if halo is None else halo
    layers = ["elevation", "access", "trails"]
    for tag, df in (("tiles", tiles), ("blocks", blocks)):
        if missing := {"tx", "ty"} - set(df.columns):
            raise ValueError(f"{tag} lack {sorted(missing)}")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"block": [], **{o: [] for o in OUTPUTS}})
        elevation = padded(left, "elevation", rows, cols, h)
        if np.isfinite(elevation).any():
            got = terrain(elevation, cell)
            got |= access(got["mountain"], padded(left, "access", rows, cols, h), padded(left, "trails", rows, cols, h), cell)
        elif (right.people > 0).any():
            raise ValueError(f"tile {key} has people but no elevation")
        else:
            got = {o: np.full(elevation.shape, np.nan) for o in OUTPUTS}
        r, c = right.row.to_numpy() + h, right.col.to_numpy() + h
        return pd.DataFrame({"block": right.block.to_numpy(), **{o: pd.Series(got[o][r, c], dtype="Float64").mask(np.isnan(got[o][r, c])) for o in OUTPUTS}})

    busy = blocks.select("tx", "ty").distinct()
    strips = border_strips(tiles, layers, rows, cols, h).join(busy, ["tx", "ty"], "left_semi")
    kind = f"block {dict(blocks.dtypes)['block']}, " + ", ".join(f"{o} double" for o in OUTPUTS)
    return strips.groupBy("tx", "ty").cogroup(blocks.groupBy("tx", "ty")).applyInPandas(run, kind)


def cells_to_tiles(cells: DataFrame, values: list[str], rows: int, cols: int, fill: float = float("nan")) -> DataFrame:
    """Cells ``row, col`` (of the field, any sign) with values, one each, as tiles ``tx, ty`` of row-major arrays; absent cells get ``fill``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["row"] % rows) * cols + pdf["col"] % cols
        out = {"tx": [pdf.tx.iloc[0]], "ty": [pdf.ty.iloc[0]]}
        for v in values:
            a = np.full(rows * cols, fill)
            a[at.to_numpy()] = pdf[v].to_numpy(float, na_value=np.nan)
            out[v] = [a]
        return pd.DataFrame(out)

    named = cells.select(F.floor(F.col("col") / cols).cast("int").alias("tx"), F.floor(F.col("row") / rows).cast("int").alias("ty"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *values)
    return named.groupBy("tx", "ty").applyInPandas(run, "tx int, ty int, " + ", ".join(f"`{v}` array<double>" for v in values))


def resample_bilinear(source: DataFrame, target: DataFrame, row_of: Column, col_of: Column) -> DataFrame:
    """``source``: ``row, col, value`` (no row: unknown, as a null value is); ``target``: cells ``row, col``, unique.

    ``row_of`` / ``col_of``: where a target cell's centre lies in the source, in source cells (0 is the centre of the first one), as
    columns over ``target``. Returns the target cells with ``value``: of the four source cells around, those that are known,
    weights made to add up to 1; null where none with a weight is. Each target cell asks for at most four cells by an
    equi-join, across tiles as within.
    """
    near = target.select("row", "col", row_of.cast("double").alias("y"), col_of.cast("double").alias("x"))
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    corner = lambda dy, dx: F.struct((F.floor("y") + dy).alias("r"), (F.floor("x") + dx).alias("c"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    asks = near.select("row", "col", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("a")).where("a.w > 0").select("row", "col", "a.*")
    known = source.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").cast("double").alias("v"))
    got = asks.join(known, ["r", "c"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    return target.select("row", "col").join(got, ["row", "col"], "left")

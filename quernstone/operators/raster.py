"""Raster windows over tiles: one row a tile, NumPy inside a grouped map, block cells sampled at the end."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import window_cells

RADII = (5, 10, 20, 40)
#: Access classes of land, and the weights of rings (fixed values).
OPEN, RESTRICTED, CLOSED, UNKNOWN = 1, 2, 3, 4
RING_WEIGHTS, TRAIL_WEIGHT, TRAIL_FAR_KM = (1.0, 0.75, 0.40), 0.40, 100.0
OUTPUTS = (
    *(f"relief_{r}km" for r in RADII), "slope", "mountain", "rugged", "open_5", "open_15", "open_30", "restricted_30", "closed_30", "unknown_30", "access_raw",
    "nearest_trail_km", "trail_10", "trail_25", "trail_raw",
)


def box_sum(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over odd ``size`` x ``size`` windows; zeros outside."""
    r = size // 2
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    rows, cols = np.arange(a.shape[0]), np.arange(a.shape[1])
    r0, r1 = np.clip(rows - r, 0, None), np.clip(rows + r + 1, None, a.shape[0])
    c0, c1 = np.clip(cols - r, 0, None), np.clip(cols + r + 1, None, a.shape[1])
    return s[np.ix_(r1, c1)] - s[np.ix_(r0, c1)] - s[np.ix_(r1, c0)] + s[np.ix_(r0, c0)]


def _extreme(a: np.ndarray, size: int, axis: int, pick) -> np.ndarray:
    """Running extreme over odd windows by doubling."""
    a = np.moveaxis(a, axis, 0)
    r, worst = size // 2, (-np.inf if pick is np.maximum else np.inf)
    v = np.concatenate([np.full((r, *a.shape[1:]), worst), a, np.full((r, *a.shape[1:]), worst)])
    span = 1
    while span * 2 <= size:
        v = pick(v[: len(v) - span], v[span:])
        span *= 2
    rest = size - span
    v = pick(v[: len(v) - rest], v[rest:]) if rest else v
    return np.moveaxis(v, 0, axis)


def relief(elevation: np.ndarray, size: int) -> np.ndarray:
    """Highest minus lowest valid cell of the window; NaN without valid cells."""
    valid = np.isfinite(elevation)
    high = _extreme(_extreme(np.where(valid, elevation, -np.inf), size, 0, np.maximum), size, 1, np.maximum)
    low = _extreme(_extreme(np.where(valid, elevation, np.inf), size, 0, np.minimum), size, 1, np.minimum)
    out = high - low
    return np.where(np.isfinite(out), out, np.nan)


def nearest_valid(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared Euclidean distance (in cells) to the nearest valid cell, and its row and column; infinite without any.

    Exact, in two passes: the nearest valid cell of each column, then the best of the row's columns, nearest columns first
    until none further away can be better.
    """
    h, w = valid.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(valid, rows, -1), 0)
    below = np.minimum.accumulate(np.where(valid, rows, 2 * h)[::-1], 0)[::-1]
    up, down = np.where(above >= 0, rows - above, np.inf), np.where(below < h, below - rows, np.inf)
    source = np.where(up <= down, above, below)
    column = np.minimum(up, down) ** 2
    best, row, col = column.copy(), source.copy(), np.broadcast_to(np.arange(w), (h, w)).copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        for there, here in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            far = column[:, there] + d * d
            take = far < best[:, here]
            best[:, here][take] = far[take]
            row[:, here][take] = source[:, there][take]
            col[:, here][take] = np.broadcast_to(np.arange(w)[there], far.shape)[take]
    return best, row, col


def fill_nearest(a: np.ndarray) -> np.ndarray:
    """Invalid cells take the value of the nearest valid cell (Euclidean distance)."""
    valid = np.isfinite(a)
    if not valid.any() or valid.all():
        return a.copy()
    _, row, col = nearest_valid(valid)
    return a[row, col]


def slope_degrees(elevation: np.ndarray, cell: float) -> np.ndarray:
    gy, gx = np.gradient(fill_nearest(elevation), cell)
    return np.degrees(np.arctan(np.hypot(gx, gy)))


def terrain(elevation: np.ndarray, cell: float, radii: Sequence[int] = RADII) -> dict[str, np.ndarray]:
    """Relief over ``radii`` km, slope, mountain cells (steep or of high relief over 5 km) and their share over 20 km.

    The share is of valid cells, NaN where the window has none.
    """
    valid = np.isfinite(elevation)
    if elevation.ndim != 2 or cell <= 0 or not valid.any():
        raise ValueError("a grid needs two dimensions, a cell size and a valid cell")
    out = {f"relief_{r}km": relief(elevation, window_cells(1000 * r, cell)) for r in radii}
    near = out.get("relief_5km")
    near = relief(elevation, window_cells(5000, cell)) if near is None else near
    slope = np.where(valid, slope_degrees(elevation, cell), np.nan)
    mountain = valid & ((slope >= 15) | (near >= 300))
    wide = window_cells(20000, cell)
    count = box_sum(valid.astype(float), wide)
    rugged = np.divide(box_sum(mountain.astype(float), wide), count, out=np.full(count.shape, np.nan), where=count > 0)
    return out | {"slope": slope, "mountain": mountain.astype(float), "rugged": rugged}


def access(mountain: np.ndarray, land: np.ndarray, trails: np.ndarray, cell: float) -> dict[str, np.ndarray]:
    """Mountain land by access class in rings (km2), length of mountain trails in rings and distance to the nearest (km).

    Rings are what an outer window has beyond the inner one, never negative. Trails further than 100 km are unknown.
    """
    if land.shape != mountain.shape or trails.shape != mountain.shape or np.any(np.isfinite(trails) & (trails < 0)):
        raise ValueError("grids must be aligned, and trails not negative")
    mask = mountain.astype(bool)
    window = lambda a, km: box_sum(a.astype(float), window_cells(1000 * km, cell))
    area = lambda code, km: window(mask & (land == code), km) * (cell / 1000) ** 2
    o5, o15, o30 = (area(OPEN, km) for km in (5, 15, 30))
    rings = (o5, np.maximum(o15 - o5, 0), np.maximum(o30 - o15, 0))
    length = np.where(mask & np.isfinite(trails), trails, 0.0)
    t10, t25 = window(length, 10), window(length, 25)
    far = np.sqrt(nearest_valid(length > 0)[0]) * cell / 1000
    return {
        "open_5": rings[0], "open_15": rings[1], "open_30": rings[2], "restricted_30": area(RESTRICTED, 30), "closed_30": area(CLOSED, 30), "unknown_30": area(UNKNOWN, 30),
        "access_raw": sum(w * r for w, r in zip(RING_WEIGHTS, rings, strict=True)), "nearest_trail_km": np.where(far <= TRAIL_FAR_KM, far, np.nan),
        "trail_10": t10, "trail_25": t25, "trail_raw": t10 + TRAIL_WEIGHT * np.maximum(t25 - t10, 0),
    }


def sample_tiles(tiles: DataFrame, blocks: DataFrame, cell: float = 250.0) -> DataFrame:
    """``tiles``: ``tile, rows, cols, elevation, access, trails`` (row-major arrays); ``blocks``: ``tile, block, row, col, people``.

    Returns ``block`` and the values of its cell, NaN as null. A tile meets its blocks in one task; tiles have a fixed size.
    A tile without any elevation gives nulls, and may have blocks without people only.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"block": [], **{o: [] for o in OUTPUTS}})
        t = left.iloc[0]
        shape = (int(t.rows), int(t.cols))
        grid = lambda v: np.array(v, float).reshape(shape)
        elevation = grid(t.elevation)
        if not np.isfinite(elevation).any():
            if (right.people > 0).any():
                raise ValueError(f"tile {key[0]} has people but no elevation")
            got = {o: np.full(shape, np.nan) for o in OUTPUTS}
        else:
            got = terrain(elevation, cell)
            got |= access(got["mountain"], grid(t.access), grid(t.trails), cell)
        r, c = right.row.to_numpy(), right.col.to_numpy()
        return pd.DataFrame({"block": right.block.to_numpy(), **{o: pd.Series(got[o][r, c], dtype="Float64").mask(np.isnan(got[o][r, c])) for o in OUTPUTS}})

    return tiles.groupBy("tile").cogroup(blocks.groupBy("tile")).applyInPandas(run, "block bigint, " + ", ".join(f"{o} double" for o in OUTPUTS))


def mosaic(layers: Sequence[Column]) -> Column:
    """Arrays of one grid laid over each other: the first that is valid wins, cell by cell."""
    valid = [F.transform(a, lambda v: F.when(~F.isnan(v), v)) for a in layers]
    return functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), valid)


def halo_tiles(x: Column, y: Column, size: float, halo: float) -> Column:
    """Tiles (structs ``tx, ty``) that need a position: its own, and those whose border is within ``halo`` of it."""
    span = lambda v: F.sequence(F.floor((v - halo) / size), F.floor((v + halo) / size))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.cast("int").alias("tx"), j.cast("int").alias("ty")))))


def tile_of(x, y, size: float = 100_000.0):
    """Tile column and row of a position."""
    return F.floor(x / size).cast("int"), F.floor(y / size).cast("int")


def finished_tiles(tiles: DataFrame, done: DataFrame, on: Sequence[str] = ("tile",)) -> DataFrame:
    """Tiles still to do, for a resumed build."""
    return tiles.join(done, list(on), "left_anti")


def tile_digests(blocks: DataFrame, tile: Sequence[str], block: str, values: Sequence[str]) -> DataFrame:
    """Per tile: blocks, a digest of their ids, and one of their ids with sampled values (nulls as empty text), in any order.

    Digests are of the number of rows and the sums of the rows' digests, in four parts, so they combine map-side whatever a tile's size.
    """
    line = F.concat_ws("|", F.col(block).cast("string"), *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    rows = blocks.select(*tile, F.sha2(F.col(block).cast("string"), 256).alias("_i"), F.sha2(line, 256).alias("_s"))
    part = lambda c, k: F.sum(F.conv(F.substring(c, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    whole = lambda c: F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[part(c, k) for k in range(4)]), 256)
    return rows.groupBy(*tile).agg(F.count("*").alias("n"), whole("_i").alias("ids_sha256"), whole("_s").alias("samples_sha256"))

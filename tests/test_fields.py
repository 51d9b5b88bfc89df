"""Windows across tiles, quantiles of huge groups, rasterisation, the spatial index, shards, numbering and reconstruction, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import antimeridian as M
from quernstone.operators import numbering as N
from quernstone.operators import ranks
from quernstone.operators import rasterise as Z
from quernstone.operators import reconstruct as O
from quernstone.operators import tiles as T
from quernstone.operators.contracts import ContractError
from quernstone.operators.domain import block_scores
from quernstone.operators.quantiles import exact_quantiles
from quernstone.operators.raster import OUTPUTS, access, terrain
from quernstone.operators.spatial import bbox_join, inside
from quernstone.sources.shared import written
from quernstone.sources.shards import Shards
from quernstone.sources.spatial_index import BITS, key_ranges, search, write_index


@pytest.fixture(params=["adaptive", "static"])
def modes(spark, request):
    """Each test runs with adaptive execution and without it, where partitions stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param == "adaptive").lower())
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def field(rows, cols, seed=0, holes=0.05):
    rng = np.random.default_rng(seed)
    e = rng.integers(0, 900, (rows, cols)).astype(float)
    e[rng.random((rows, cols)) < holes] = np.nan
    return e, rng.integers(0, 5, (rows, cols)).astype(float), rng.integers(0, 3, (rows, cols)) / 4


def as_cells(spark, e, a, t):
    rows = [(r, c, *(None if math.isnan(v) else float(v) for v in (e[r, c], a[r, c], t[r, c]))) for r in range(e.shape[0]) for c in range(e.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, elevation double, access double, trails double")


@pytest.mark.parametrize(("side", "tile", "cell"), [(24, 8, 2500.0), (12, 12, 4000.0), (20, 5, 9000.0)])
def test_field_is_the_uncut_field(spark, side, tile, cell):
    e, a, t = field(side, side, side)
    h = math.ceil(T.HALO / cell)
    pad = lambda v: np.pad(v, h, constant_values=np.nan)
    want = terrain(pad(e), cell)
    want |= access(want["mountain"], pad(a), pad(t), cell)
    tiles = T.cells_to_tiles(as_cells(spark, e, a, t), ["elevation", "access", "trails"], tile, tile)
    at = [(r, c) for r in range(side) for c in range(side)]
    blocks = spark.createDataFrame([(c // tile, r // tile, k, r % tile, c % tile, 1) for k, (r, c) in enumerate(at)], "tx int, ty int, block long, row int, col int, people int")
    got = T.sample_field(tiles, blocks, tile, tile, cell).collect()
    assert len(got) == side * side
    near = {"nearest_trail_km", "trail_10", "trail_25", "trail_raw"}  # beyond the halo less the inner window, trails may be missed
    for r in got:
        row, col = at[r.block]
        for o in OUTPUTS:
            w = want[o][row + h, col + h]
            if o in near and o == "nearest_trail_km" and not w <= 90:
                continue
            assert (r[o] is None and math.isnan(w)) or r[o] == pytest.approx(w, abs=1e-9), (o, row, col)


def test_field_with_missing_tiles_and_blocks(spark):
    e, a, t = field(8, 8, 3, 0)
    tiles = T.cells_to_tiles(as_cells(spark, e, a, t), ["elevation", "access", "trails"], 4, 4).where("not (tx = 1 and ty = 1)")
    block = lambda *rows: spark.createDataFrame(list(rows), "tx int, ty int, block long, row int, col int, people int")
    assert T.sample_field(tiles, block((1, 1, 5, 0, 0, 1)), 4, 4, 5000.0).count() == 0  # no such tile
    r = T.sample_field(tiles, block((0, 0, 5, 3, 3, 1)), 4, 4, 5000.0, halo=4).first()
    cut = np.where(np.add.outer(np.arange(8) // 4, np.arange(8) // 4) == 2, np.nan, e)
    want = terrain(np.pad(cut, ((4, 0), (4, 0)), constant_values=np.nan)[:12, :12], 5000.0)
    assert r.relief_20km == want["relief_20km"][7, 7] and r.slope == pytest.approx(want["slope"][7, 7])
    with pytest.raises(ValueError):
        T.sample_field(tiles.drop("tx"), block((0, 0, 1, 0, 0, 1)), 4, 4)


def test_bilinear(spark):
    rng = np.random.default_rng(4)
    grid = rng.random((12, 15))
    known = rng.random((12, 15)) > 0.3
    source = spark.createDataFrame([(r, c, float(grid[r, c]) if k else None) for (r, c), k in np.ndenumerate(known)], "row long, col long, value double")
    target = spark.createDataFrame([(r, c) for r in range(-2, 18) for c in range(-1, 22)], "row long, col long")
    got = {(r.row, r.col): r.value for r in T.resample_bilinear(source, target, F.col("row") * 0.75 - 0.5, F.col("col") * 0.7).collect()}
    for (r, c), v in got.items():
        y, x = r * 0.75 - 0.5, c * 0.7
        top = weight = 0.0
        for i, j in itertools.product((0, 1), (0, 1)):
            a, b = math.floor(y) + i, math.floor(x) + j
            w = (y - math.floor(y) if i else 1 - (y - math.floor(y))) * (x - math.floor(x) if j else 1 - (x - math.floor(x)))
            if w > 0 and 0 <= a < 12 and 0 <= b < 15 and known[a, b]:
                top, weight = top + w * grid[a, b], weight + w
        assert v is None if weight == 0 else v == pytest.approx(top / weight)


@pytest.mark.parametrize("most", [7, 60, 10_000])
def test_quantiles(modes, most):
    rng = np.random.default_rng(most)
    groups = {"ties": rng.integers(0, 5, 900), "hot": np.r_[np.full(600, 3.5), rng.random(300) * 10], "wide": rng.lognormal(0, 6, 800), "small": rng.random(5), "one": [2.0], None: rng.random(400), "same": np.full(300, -1.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("nothing", None)]
    df = modes.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"low": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", wanted, by=["g"], most=most).collect()}
    assert set(got) == {*groups, "nothing"} and got["nothing"].mid is None
    for g, values in groups.items():
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12), (g, name)
    every = [v for _, v in rows if v is not None]
    r = exact_quantiles(df, "v", wanted, most=most).first()
    assert [r[n] for n in wanted] == pytest.approx([np.quantile(every, q) for q in wanted.values()])
    assert exact_quantiles(df.limit(0), "v", wanted, by=["g"]).count() == 0


def test_polygons_as_cells(spark):
    rng = np.random.default_rng(5)
    polygons = []
    for k in range(12):
        x, y = rng.uniform(-20, 40, 2)
        angle = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        ring = [(x + 14 * np.cos(v) * rng.uniform(0.5, 1), y + 11 * np.sin(v) * rng.uniform(0.5, 1)) for v in angle]
        hole = [(x - 1.5, y - 1.0), (x + 2.0, y - 1.25), (x + 1.0, y + 2.0)]
        polygons.append((k, int(rng.integers(0, 4)), float(k), [[{"x": float(a), "y": float(b)} for a, b in r] for r in (ring, hole)]))
    polygons += [(90, 9, 90.0, []), (91, 9, 91.0, [[{"x": 1.0, "y": 1.0}]]), (92, 9, 92.0, None)]
    df = spark.createDataFrame(polygons, "k long, o int, v double, rings array<array<struct<x double, y double>>>")
    for cell in (1.0, 0.7):
        got = {(r.row, r.col): r.value for r in Z.rasterise_polygons(df, "k", "rings", "o", "v", cell).collect()}
        n = int(70 / cell)
        rows, cols = np.meshgrid(np.arange(-n, n), np.arange(-n, n), indexing="ij")
        px, py = (cols.ravel() + 0.5) * cell, (rows.ravel() + 0.5) * cell
        want = {}
        for _, _, v, rings in sorted((p for p in polygons[:12]), key=lambda p: (p[1], p[2])):
            xs = np.concatenate([[*(q["x"] for q in r), np.nan] for r in rings])[:-1]
            ys = np.concatenate([[*(q["y"] for q in r), np.nan] for r in rings])[:-1]
            want |= {(int(a), int(b)): v for a, b in zip(rows.ravel()[inside(px, py, xs, ys)], cols.ravel()[inside(px, py, xs, ys)], strict=True)}
        assert got == want


def test_lines_as_cells(spark):
    rng = np.random.default_rng(6)
    lines = [[{"x": float(a), "y": float(b)} for a, b in rng.uniform(-9, 9, (rng.integers(2, 6), 2))] for _ in range(20)]
    lines += [[{"x": 0.5, "y": 0.5}, {"x": 4.5, "y": 0.5}], [{"x": 1.5, "y": -3.0}, {"x": 1.5, "y": 2.0}], [{"x": 1.0, "y": 1.0}] * 2, [], None, [{"x": 0.0, "y": 0.25}, {"x": 3.0, "y": 0.25}]]
    df = spark.createDataFrame([(v,) for v in lines], "p array<struct<x double, y double>>")
    got = {(r.row, r.col): r.length for r in Z.rasterise_lines(df, "p", 1.5).collect()}
    want = {}
    for line in (v for v in lines if v):
        for a, b in zip(line[:-1], line[1:], strict=True):
            steps = 20_000
            t = (np.arange(steps) + 0.5) / steps
            cells = zip(np.floor((a["y"] + t * (b["y"] - a["y"])) / 1.5).astype(int), np.floor((a["x"] + t * (b["x"] - a["x"])) / 1.5).astype(int), strict=True)
            for cell in cells:
                want[cell] = want.get(cell, 0) + math.hypot(b["x"] - a["x"], b["y"] - a["y"]) / steps
    want = {k: v for k, v in want.items() if v > 2e-3}
    assert set(want) <= set(got) and all(got[k] == pytest.approx(want.get(k, 0), abs=5e-3) for k in got)
    assert sum(got.values()) == pytest.approx(sum(math.hypot(b["x"] - a["x"], b["y"] - a["y"]) for v in lines if v for a, b in zip(v[:-1], v[1:], strict=True)))


def test_boxes_of_any_size_meet(modes):
    rng = np.random.default_rng(7)

    def boxes(n, sizes):
        at, side = rng.uniform(-50, 50, (n, 2)), rng.choice(sizes, (n, 2)) * rng.random((n, 2))
        return [(k, *map(float, (x, y, x + w, y + h))) for k, ((x, y), (w, h)) in enumerate(zip(at, side, strict=True))]

    left, right = boxes(150, [0, 1, 5, 2000]), boxes(200, [0, 0.5, 30])
    left += [(900, 0.0, 0.0, None, 1.0), (901, -1e6, -1e6, 1e6, 1e6)]  # one across everything
    frame = lambda rows, s: modes.createDataFrame(rows, f"{s}id long, {s}x0 double, {s}y0 double, {s}x1 double, {s}y1 double")
    got = [(r.l_id, r.r_id) for r in bbox_join(frame(left, "l_"), frame(right, "r_"), 1.0).select("l_id", "r_id").collect()]
    want = [(a[0], b[0]) for a in left for b in right if a[3] is not None and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
    assert sorted(got) == sorted(want)
    assert bbox_join(frame(left, "l_").limit(0), frame(right, "r_"), 1.0).count() == 0


def test_key_ranges_cover_their_window():
    rng = random.Random(8)
    key = lambda x, y: sum(((x >> k & 1) << (2 * k)) | ((y >> k & 1) << (2 * k + 1)) for k in range(BITS))
    for most in (1, 3, 16):
        for _ in range(40):
            x0, y0 = rng.randrange(1 << BITS), rng.randrange(1 << BITS)
            x1, y1 = min((1 << BITS) - 1, x0 + rng.randrange(1 << rng.randrange(1, BITS))), min((1 << BITS) - 1, y0 + rng.randrange(1 << rng.randrange(1, BITS)))
            ranges = key_ranges(x0, y0, x1, y1, most)
            assert len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
            for _ in range(30):
                k = key(rng.randint(x0, x1), rng.randint(y0, y1))
                assert any(a <= k <= b for a, b in ranges)


def scan(df):
    """Files and rows that the plan's scan has read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metric = lambda k: leaves.apply(0).metrics().get(k).get().value()
    return metric("numFiles"), metric("numOutputRows")


def test_spatial_index_reads_little(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 20_000
    x, y, side = rng.uniform(-180, 180, n), rng.uniform(-90, 90, n), rng.choice([0, 0.01, 0.3, 40], n, p=[0.5, 0.3, 0.19, 0.01])
    rows = [(k, float(a), float(b), float(a + s), float(b + s * 0.7)) for k, (a, b, s) in enumerate(zip(x, y, side, strict=True))] + [(n, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    path = f"file://{tmp_path}/index"
    write_index(df, path, (-180.0, -90.0, 180.0, 90.0))
    for x0, y0, x1, y1 in [(3, 4, 3.5, 4.5), (-180, -90, 180, 90), (170, -10, -175, 20), (10, 10, 10, 10), (250, 0, 260, 5), (-30, 50, 20, 52)]:
        found = search(spark, path, x0, y0, x1, y1)
        meets = lambda r: (r[1] <= x1 and r[3] >= x0) if x0 <= x1 else (r[1] <= x1 or r[3] >= x0)  # noqa: B023, E731
        want = sorted(r[0] for r in rows[:n] if meets(r) and r[2] <= y1 and r[4] >= y0)
        assert sorted(r.id for r in found.collect()) == want and found.columns == df.columns
    whole, small = scan(search(spark, path, -180, -90, 180, 90)), scan(search(spark, path, 3, 4, 3.5, 4.5))
    assert whole[1] >= n and small[0] < whole[0] / 8 and small[1] < whole[1] / 8
    leaf = search(spark, path, 3, 4, 3.5, 4.5)._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "GreaterThanOrEqual(z," in leaf.metadata().get("PushedFilters").get() and "zone" in leaf.metadata().get("PartitionFilters").get()


def test_shards_resume_and_mend(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("shard"), "id", (F.col("id") * 2).alias("v"))
    s = Shards(spark, f"file://{tmp_path}/built", {"id": "bigint", "v": "bigint"})
    calls = []

    def make(todo):
        calls.append(sorted(r.shard for r in todo.collect()))
        return df.join(todo, "shard")

    names = df.select("shard").distinct()
    whole = sorted(map(tuple, df.select("id", "v", "shard").collect()))
    assert sorted(r.shard for r in s.build(names.where("shard < '3'"), make).collect()) == ["0", "1", "2"]
    with pytest.raises(ContractError):
        s.build(spark.createDataFrame([("99",)], "shard string"), make)  # no rows
    s.build(names, make)
    assert calls == [["0", "1", "2"], ["99"], ["3", "4", "5", "6"]] and sorted(map(tuple, s.read().collect())) == whole
    rows = tmp_path / "built" / "rows"
    for f in (rows / "shard=4").iterdir():  # deleted
        f.unlink()
    part = next(f for f in (rows / "shard=1").iterdir() if f.name.startswith("part"))
    part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])  # torn
    for f in (rows / "shard=1").iterdir():
        if f.name.endswith(".crc"):
            f.unlink()
    other = spark.range(3).select("id", F.col("id").alias("v"))
    other.write.mode("overwrite").parquet(f"file://{rows}/shard=6")  # of other content
    state = {r.shard: r.status for r in s.status().collect()}
    assert state == {"0": "verified", "1": "missing", "2": "verified", "3": "verified", "4": "missing", "5": "verified", "6": "damaged"}
    with pytest.raises(ContractError):
        s.read()
    s.build(names, make)
    assert calls[-1] == ["1", "4", "6"] and sorted(map(tuple, s.read().collect())) == whole
    assert s.build(names, make).count() == 0 and len(calls) == 4
    assert {r.status for r in s.status("changed").collect()} == {"stale"}
    s.build(names.where("shard = '2'"), make, "changed")
    assert {r.shard: r.status for r in s.status("changed").collect()}["2"] == "verified"


def test_numbers_and_pages(modes):
    rng = random.Random(10)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0])) for k in range(500)]
    df = modes.createDataFrame(rows, "k long, g string, v double").repartition(7)
    got = {r.k: (r.n, r.all) for r in N.numbered(df, ["v", "k"], "n", by=["g"], start=0, total="all").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == [(i, len(own)) for i in range(len(own))]
    assert N.numbered(df.limit(0), ["k"]).count() == 0
    sums = {r.k: (r.upto, r.upto_all) for r in N.accumulated(df, ["k"], {"upto": "k"}, by=["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(r[0] for r in rows if r[1] == g)
        assert [sums[k] for k in own] == [(sum(own[: i + 1]), sum(own)) for i in range(len(own))]
    inventory = N.pages(df, "k", 60)
    assert [(r.page, r.rows, r.first_key, r.last_key) for r in inventory.orderBy("page").collect()] == [(p, min(60, 500 - 60 * p), 60 * p, min(60 * p + 59, 499)) for p in range(9)]
    came = df.select("k", F.floor(F.col("k") / 60).alias("page"))
    N.assert_pages(inventory, came, "page", "k")
    bad = came.where("k <> 61 and page <> 4").withColumn("page", F.when(F.col("k") == 125, 3).otherwise(F.col("page"))).withColumn("k", F.when(F.col("k") == 310, 300).otherwise(F.col("k")))
    assert {r.page: r.status for r in N.checked_pages(inventory, bad, "page", "k").collect() if r.status != "complete"} == {1: "short", 2: "short", 3: "surplus", 4: "missing", 5: "other_keys"}
    with pytest.raises(ContractError):
        N.assert_pages(inventory, bad, "page", "k")


@pytest.mark.parametrize(("rows", "buckets"), [(250_000, 64), (100, 64), (10, 4)])
def test_ranks_by_window_bucket_and_range(modes, monkeypatch, rows, buckets):
    """However many distinct values there are for a task, ranks are the same."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", rows)
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    rng = random.Random(rows)
    data = [(k, rng.choice(["a", None, "b"]), rng.choice([None, *map(float, range(150))])) for k in range(900)]
    df = modes.createDataFrame(data, "k long, g string, v double").repartition(5)
    got = {r.k: r.place for r in ranks.competition_rank(df, "v", "place", by=["g"]).collect()}
    every = {r.k: r.pct for r in ranks.max_rank_percentile(df, "v", "pct").collect()}
    known = [v for *_, v in data if v is not None]
    for k, g, v in data:
        own = [x for _, h, x in data if h == g and x is not None]
        assert got[k] == (None if v is None else 1 + sum(x > v for x in own))
        assert every[k] is None if v is None else every[k] == pytest.approx(100 * sum(x <= v for x in known) / len(known))


def test_order_faults(spark):
    keys = [1, 2, 3, 3, 5, None, 7, 6, 8, 9]
    df = spark.createDataFrame([(k, v, [1, 2], [1] if k == 4 else [3, 4]) for k, v in enumerate(keys)], "i long, key long, a array<int>, b array<int>").repartitionByRange(3, "i").sortWithinPartitions("i")
    got = sorted((r.fault, r.key) for r in N.order_faults(written(df, "payload"), "key", ["a", "b"]).collect())
    assert got == [("not_ascending", 3), ("not_ascending", 6), ("null_key", None), ("ragged", 5)]
    assert N.order_faults(written(df.limit(0), "payload"), "key").count() == 0


def test_planted_drift_is_found(modes):
    rng = random.Random(11)
    rows = [(k, rng.choice([None, 0, 1, 2, 50]), rng.choice([None, -1e-10, 0.0, *map(float, range(9))]), rng.random(), rng.random() < 0.8) for k in range(400)]
    df = modes.createDataFrame(rows, "k long, w int, a double, b double, inside boolean").repartition(5)
    built = written(block_scores(df, "k", "w", {"a": 0.6, "b": 0.4}, F.col("inside")), "built")
    again = O.reconstructed_scores(df, "k", "w", {"a": 0.6, "b": 0.4}, F.col("inside"))
    tolerances = {"a_pct": 1e-9, "b_pct": 1e-9, "composite": 1e-9}
    assert O.assert_reconstructed(built, again, "k", tolerances) is built
    moved = built.withColumn("composite", F.when(F.col("k") == 17, F.coalesce("composite", F.lit(0.0)) + 0.01).otherwise(F.col("composite"))).where("k <> 18")
    assert {(r.k, r.column) for r in O.differences(moved, again, "k", tolerances).collect()} == {(17, "composite"), *((18, c) for c in tolerances)}
    with pytest.raises(ContractError):
        O.assert_reconstructed(moved, again, "k", tolerances)


def test_permuted_rows_are_the_same_rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("g"))
    a, b = O.permuted(df, 1, 5), O.permuted(df, 2, 3)
    assert [r.id for r in a.collect()] != [r.id for r in b.collect()] and sorted(a.collect()) == sorted(b.collect()) == sorted(df.collect())


@pytest.mark.parametrize("parts", [2, 4, 16])
def test_front_does_not_hang_on_partitions(modes, monkeypatch, parts):
    """Points near one front, so that every block holds some of it."""
    monkeypatch.setattr(ranks, "BLOCK", 64)
    rng = np.random.default_rng(parts)
    x = rng.random((3000, 3))
    x = np.round(x / x.sum(1, keepdims=True), 2) if parts != 4 else rng.random((3000, 3))
    df = modes.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)] + [(9999, None, 2.0, 2.0)], "k long, a double, b double, c double").repartition(parts)
    modes.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.k: r.pareto for r in ranks.pareto_flags(df, "k", ["a", "b", "c"]).collect()}
    finally:
        modes.conf.set("spark.sql.shuffle.partitions", "4")
    want = [not ((x >= p).all(1) & (x > p).any(1)).any() for p in x]
    assert [got[k] for k in range(3000)] == want and got[9999] is False


def test_rings_at_the_antimeridian(spark):
    rng = np.random.default_rng(12)
    rings, whole = [], []
    for k in range(60):
        n = int(rng.integers(3, 10))
        angle, x, y = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(150, 210), rng.uniform(-60, 60)
        p = [(x + 20 * np.cos(a), y + 9 * np.sin(a)) for a in angle]
        whole.append(p)
        rings.append((k, [{"x": float((a + 180) % 360 - 180), "y": float(b)} for a, b in p]))
    rings += [(90, []), (91, None), (92, [{"x": 179.0, "y": 0.0}, {"x": -179.0, "y": 1.0}])]
    df = spark.createDataFrame(rings, "k long, ring array<struct<x double, y double>>")
    got = M.cut_rings(df, "k", "ring").select("k", "part", "ring", M.ring_area(F.col("ring")).alias("area")).collect()
    for k, p in enumerate(whole):
        own = [r for r in got if r.k == k]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
        assert sum(r.area for r in own) == pytest.approx(area)
        assert all(-180 <= q.x <= 180 for r in own for q in r.ring)
        crosses = min(a for a, _ in p) < 180 < max(a for a, _ in p)
        assert len(own) == (2 if crosses else 1)
        for r in own:  # no part spans the world
            assert max(q.x for q in r.ring) - min(q.x for q in r.ring) <= 41
    assert {r.k for r in got} == set(range(60))


def test_lines_at_the_antimeridian(spark):
    xs = [170.0, 175.0, 185.0, 178.0, 190.0, 200.0]  # unwrapped: crosses three times
    line = [{"x": float((x + 180) % 360 - 180), "y": float(i)} for i, x in enumerate(xs)]
    df = spark.createDataFrame([(1, line), (2, [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}]), (3, [{"x": 1.0, "y": 1.0}]), (4, None)], "k long, line array<struct<x double, y double>>")
    got = {(r.k, r.part): [(p.x, p.y) for p in r.line] for r in M.cut_lines(df, "k", "line").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)} and got[2, 0] == [(1.0, 1.0), (2.0, 2.0)]
    assert got[1, 0] == [(170.0, 0.0), (175.0, 1.0), (180.0, 1.5)] and got[1, 1][0] == (-180.0, 1.5) and got[1, 3][-1] == (-160.0, 5.0)
    long = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for v in got.values() for a, b in zip(v[:-1], v[1:], strict=True))
    assert long == pytest.approx(math.sqrt(2) + sum(math.hypot(b - a, 1) for a, b in zip(xs[:-1], xs[1:], strict=True)))


def test_windows_across_the_antimeridian_read_once(spark):
    f = spark.createDataFrame([(1, 170.0, 0.0, 179.0, 1.0), (2, -179.0, 0.0, -170.0, 1.0), (3, -180.0, 0.0, 180.0, 1.0), (3, -180.0, 0.0, 180.0, 1.0), (4, 0.0, 0.0, 1.0, 1.0)], "fid long, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert sorted(r.fid for r in M.read_boxes(f, "fid", 175.0, 0.0, -175.0, 1.0).collect()) == [1, 2, 3]
    assert sorted(r.fid for r in M.read_boxes(f, "fid", -1.0, 0.0, 1.0, 1.0).collect()) == [3, 4]

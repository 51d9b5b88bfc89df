"""Queries for fields, indexes, numbering, shards and reconstruction, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import antimeridian as M
from quernstone.operators import numbering as N
from quernstone.operators import rasterise as Z
from quernstone.operators import reconstruct as O
from quernstone.operators import tiles as T
from quernstone.operators.domain import aggregate_blocks, block_scores
from quernstone.operators.quantiles import exact_quantiles
from quernstone.plans.catalog import query, r6, t
from quernstone.sources.shared import Scratch, new_path, written
from quernstone.sources.shards import Shards, shard_digests
from quernstone.sources.spatial_index import search, write_index

# a field in tiles

#: One field of 48 x 48 cells of 1 km from the line items.
SIDE, TILE = 48, 24
_FIELD = f"""WITH c AS (SELECT (l_partkey % {SIDE})::INT AS r, (l_orderkey % {SIDE})::INT AS c, min(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.i AS r, b.i AS c, coalesce(v, 0) % 900 AS e, coalesce(q, 0) % 5 AS land, coalesce(q, 0) % 3 / 10 AS trail FROM range({SIDE}) a(i), range({SIDE}) b(i) LEFT JOIN c ON c.r = a.i AND c.c = b.i)"""


def _cells(spark, d) -> DataFrame:
    """``row, col, elevation, access, trails`` of every cell of the field; cells without line items are 0."""
    li = t(spark, d, "lineitem").groupBy((F.col("l_partkey") % SIDE).cast("long").alias("row"), (F.col("l_orderkey") % SIDE).cast("long").alias("col")).agg(F.min("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    grid = spark.range(SIDE * SIDE).select(F.expr(f"id div {SIDE}").alias("row"), F.expr(f"id % {SIDE}").alias("col"))
    g = grid.join(li, ["row", "col"], "left")
    v, q = F.coalesce("v", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return g.select("row", "col", (v % 900).alias("elevation"), (q % 5).alias("access"), (q % 3 / 10).alias("trails"))


_NEAR = ", ".join(f"max(b.e) FILTER (WHERE far <= {far}) - min(b.e) FILTER (WHERE far <= {far}) AS relief{km}" for km, far in ((5, 4), (10, 8), (20, 17), (40, 35)))


@query(_FIELD + f""", near AS (SELECT a.r, a.c, {_NEAR} FROM g a, g b, LATERAL (SELECT greatest(abs(a.r - b.r), abs(a.c - b.c)) AS far) GROUP BY 1, 2),
slope AS (SELECT a.r, a.c, degrees(atan(sqrt(pow((d.e - u.e) / 2000, 2) + pow((k.e - l.e) / 2000, 2)))) AS slope FROM g a
  JOIN g u ON u.c = a.c AND u.r = greatest(a.r - 1, 0) JOIN g d ON d.c = a.c AND d.r = least(a.r + 1, {SIDE - 1})
  JOIN g l ON l.r = a.r AND l.c = greatest(a.c - 1, 0) JOIN g k ON k.r = a.r AND k.c = least(a.c + 1, {SIDE - 1})),
m AS (SELECT g.*, relief5, relief10, relief20, relief40, slope, slope >= 15 OR relief5 >= 300 AS mountain FROM g JOIN near USING (r, c) JOIN slope USING (r, c)),
w AS (SELECT a.r, a.c, avg(b.mountain::INT) FILTER (WHERE far <= 17) AS rugged, count(*) FILTER (WHERE far <= 4 AND b.mountain AND b.land = 1) AS o5, count(*) FILTER (WHERE far <= 13 AND b.mountain AND b.land = 1) AS o15, count(*) FILTER (WHERE far <= 26 AND b.mountain AND b.land = 1) AS o30,
    count(*) FILTER (WHERE far <= 26 AND b.mountain AND b.land = 2) AS restricted, coalesce(sum(b.trail) FILTER (WHERE far <= 8 AND b.mountain), 0) AS t10, coalesce(sum(b.trail) FILTER (WHERE far <= 22 AND b.mountain), 0) AS t25, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) FILTER (WHERE b.mountain AND b.trail > 0) AS nearest
  FROM m a, m b, LATERAL (SELECT greatest(abs(a.r - b.r), abs(a.c - b.c)) AS far) GROUP BY 1, 2)
SELECT s_suppkey AS block, round(relief5, 6) AS relief_5km, round(relief10, 6) AS relief_10km, round(relief20, 6) AS relief_20km, round(relief40, 6) AS relief_40km, round(slope, 6) AS slope, mountain::INT::DOUBLE AS mountain, round(rugged, 6) AS rugged,
  o5::DOUBLE AS open_5, (o15 - o5)::DOUBLE AS open_15, (o30 - o15)::DOUBLE AS open_30, restricted::DOUBLE AS restricted_30, round(o5 + 0.75 * (o15 - o5) + 0.4 * (o30 - o15), 6)::DOUBLE AS access_raw, round(nearest, 6) AS nearest_trail_km, round(t10, 6) AS trail_10, round(t25, 6) AS trail_25, round(t10 + 0.4 * (t25 - t10), 6) AS trail_raw
FROM supplier JOIN m ON r = s_suppkey * 7 % {SIDE} AND c = s_suppkey * 13 % {SIDE} JOIN w USING (r, c)""")
def field_windows(spark, d):
    """Terrain, access and trails of one field in four tiles, as if it weren't cut, sampled at a block for each supplier."""
    tiles = T.cells_to_tiles(_cells(spark, d), ["elevation", "access", "trails"], TILE, TILE)
    k = F.col("s_suppkey")
    row, col = k * 7 % SIDE, k * 13 % SIDE
    blocks = t(spark, d, "supplier").select(F.floor(col / TILE).cast("int").alias("tx"), F.floor(row / TILE).cast("int").alias("ty"), k.alias("block"), (row % TILE).cast("int").alias("row"), (col % TILE).cast("int").alias("col"), F.lit(1).alias("people"))
    shown = ("relief_5km", "relief_10km", "relief_20km", "relief_40km", "slope", "mountain", "rugged", "open_5", "open_15", "open_30", "restricted_30", "access_raw", "nearest_trail_km", "trail_10", "trail_25", "trail_raw")
    return T.sample_field(tiles, blocks, TILE, TILE, 1000.0).select("block", *[r6(o, o) for o in shown])


@query(f"""WITH s AS (SELECT (l_partkey % {SIDE})::BIGINT AS r, (l_orderkey % {SIDE})::BIGINT AS c, min(l_extendedprice) AS v FROM lineitem WHERE (l_partkey % {SIDE} + l_orderkey % {SIDE}) % 5 <> 0 GROUP BY 1, 2),
t AS (SELECT o_custkey % 61 AS r, o_orderkey % 61 AS c FROM orders GROUP BY ALL), a AS (SELECT r, c, r * 0.75 + 0.3 AS y, c * 0.75 - 0.2 AS x FROM t),
k AS (SELECT a.r, a.c, floor(y) + i AS sr, floor(x) + j AS sc, CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM a, range(2) p(i), range(2) q(j))
SELECT k.r AS "row", k.c AS col, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS value FROM k LEFT JOIN s ON s.r = sr AND s.c = sc GROUP BY 1, 2""")
def resampled_grid(spark, d):
    """A grid of line items with holes, at cells of 0.75 and moved; target cells are those that an order falls into."""
    li = t(spark, d, "lineitem")
    row, col = F.col("l_partkey") % SIDE, F.col("l_orderkey") % SIDE
    source = li.where((row + col) % 5 != 0).groupBy(row.cast("long").alias("row"), col.cast("long").alias("col")).agg(F.min("l_extendedprice").alias("value"))
    target = t(spark, d, "orders").select((F.col("o_custkey") % 61).alias("row"), (F.col("o_orderkey") % 61).alias("col")).distinct()
    return T.resample_bilinear(source, target, F.col("row") * 0.75 + 0.3, F.col("col") * 0.75 - 0.2).select("row", "col", r6("value", "value"))


# quantiles of huge groups

_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)))


@query(f"SELECT NULL AS flag, {_Q} FROM lineitem UNION ALL SELECT l_returnflag, {_Q} FROM lineitem GROUP BY 1")
def order_statistics(spark, d):
    """Quantiles of all line items as one group, and by flag; no task sorts more than 5,000 values."""
    li, wanted = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    every = exact_quantiles(li, "l_extendedprice", wanted, most=5000).select(F.lit(None).cast("string").alias("flag"), *wanted)
    return every.unionByName(exact_quantiles(li, "l_extendedprice", wanted, by=["flag"], most=5000)).select("flag", *[r6(c, c) for c in wanted])


# rasterisation

#: Rings around a corner that each supplier has: a quadrilateral and a hole.
_RINGS = (((0.0, 0.0), (23.5, 3.25), (15.0, 18.5), (-2.25, 12.0)), ((6.0, 5.0), (10.25, 5.5), (10.0, 9.75), (6.5, 9.0)))


def _polygons(spark, d):
    x, y = F.col("s_suppkey") * 37 % 211, F.col("s_nationkey") * 8.25
    point = lambda p: F.struct((x + p[0]).cast("double").alias("x"), (y + p[1]).alias("y"))
    return t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.array(*[F.array(*map(point, r)) for r in _RINGS]).alias("rings"))


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for r in _RINGS for a, b in zip(r, (*r[1:], r[0]), strict=True))


@query(f"""WITH p AS (SELECT s_suppkey, s_acctbal, (s_suppkey * 37 % 211)::DOUBLE AS x, s_nationkey * 8.25::DOUBLE AS y FROM supplier),
e(ax, ay, cx, cy) AS (VALUES {_EDGES}),
c AS (SELECT s_suppkey, s_acctbal, x, y, floor(x)::BIGINT + i AS col, floor(y)::BIGINT + j AS r FROM p, range(-4, 26) u(i), range(-2, 21) v(j)),
hits AS (SELECT s_suppkey, any_value(s_acctbal) AS o, r, col, count(*) FILTER (WHERE (y + ay > r + 0.5) <> (y + cy > r + 0.5) AND col + 0.5 < (x + cx - (x + ax)) * (r + 0.5 - (y + ay)) / (y + cy - (y + ay)) + (x + ax)) AS n FROM c, e GROUP BY s_suppkey, r, col)
SELECT r AS "row", col, arg_max(s_suppkey, (o, s_suppkey)) AS value FROM hits WHERE n % 2 = 1 GROUP BY 1, 2""")
def polygon_cells(spark, d):
    """Polygons with holes, burnt in order of the balance; the last wins."""
    return Z.rasterise_polygons(_polygons(spark, d), "s_suppkey", "rings", "s_acctbal", "s_suppkey", 1.0)


@query("""WITH l AS (SELECT c_custkey, (c_custkey % 97 + 0.31)::DOUBLE AS x, (c_nationkey * 4 + 0.17)::DOUBLE AS y FROM customer),
s AS (SELECT x AS xa, y AS ya, x + 5.4 AS xb, y + 3.7 AS yb FROM l UNION ALL SELECT x + 5.4, y + 3.7, x + 1.9, y + 6.2 FROM l),
c AS (SELECT s.*, floor(least(xa, xb))::BIGINT + i AS col, floor(least(ya, yb))::BIGINT + j AS r FROM s, range(8) u(i), range(6) v(j)),
k AS (SELECT r, col, greatest(0, least((col - xa) / (xb - xa), (col + 1 - xa) / (xb - xa)), least((r - ya) / (yb - ya), (r + 1 - ya) / (yb - ya))) AS t0, least(1, greatest((col - xa) / (xb - xa), (col + 1 - xa) / (xb - xa)), greatest((r - ya) / (yb - ya), (r + 1 - ya) / (yb - ya))) AS t1, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS whole FROM c)
SELECT r AS "row", col, round(sum((t1 - t0) * whole), 6) AS length FROM k WHERE t1 - t0 > 1e-9 GROUP BY 1, 2""")
def line_cells(spark, d):
    """Length of polylines in each cell."""
    x, y = F.col("c_custkey") % 97 + 0.31, F.col("c_nationkey") * 4 + 0.17
    points = F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((0, 0), (5.4, 3.7), (1.9, 6.2))])
    cells = Z.rasterise_lines(t(spark, d, "customer").select(points.alias("p")), "p", 1.0)
    return cells.where("length > 1e-8").select("row", "col", r6("length", "length"))


# a spatial index

#: West, south, east, north; the second crosses the antimeridian of the index.
_WINDOWS = {"inside": (20.0, 30_000.0, 23.0, 36_000.0), "across": (48.0, 5_000.0, 2.0, 20_000.0)}
_BOXES = "WITH b AS (SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1)"


@query(_BOXES + """ SELECT 'inside' AS name, l_orderkey FROM b WHERE x0 <= 23 AND x1 >= 20 AND y0 <= 36000 AND y1 >= 30000 UNION ALL SELECT 'across', l_orderkey FROM b WHERE (x1 >= 48 OR x0 <= 2) AND y0 <= 20000 AND y1 >= 5000""")
def indexed_boxes(spark, d):
    """Orders as boxes of their line items, stored by quadtree level and key; two windows read back."""
    boxes = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("r_x0"), F.min("l_extendedprice").alias("r_y0"), F.max("l_quantity").alias("r_x1"), F.max("l_extendedprice").alias("r_y1"))
    path = new_path(spark, "boxes")
    write_index(written(boxes, "boxes"), path, (0.0, 0.0, 64.0, 131_072.0))
    found = [search(spark, path, *w).select(F.lit(n).alias("name"), "l_orderkey") for n, w in _WINDOWS.items()]
    return found[0].unionByName(found[1])


# numbering, pages, payloads


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS among FROM orders")
def order_numbers(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return N.numbered(o, ["o_totalprice", "o_orderkey"], "place", by=["o_orderstatus"], total="among").select("o_orderkey", "place", "among")


_PAGES = "WITH n AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS page FROM orders)"


@query(_PAGES + " SELECT page, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey) || chr(10)) AS keys_sha256 FROM n GROUP BY 1")
def order_pages(spark, d):
    return N.pages(t(spark, d, "orders"), "o_orderkey", 50)


@query(_PAGES + """, got AS (SELECT page + CASE WHEN o_orderkey % 911 = 5 THEN 1 ELSE 0 END AS page, o_orderkey AS k FROM n WHERE o_orderkey % 397 <> 3 AND page % 40 <> 7 UNION ALL SELECT page, o_orderkey FROM n WHERE o_orderkey % 401 = 9 UNION ALL SELECT 1000000 + page, o_orderkey FROM n WHERE o_orderkey % 997 = 1),
w AS (SELECT page, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS k FROM n GROUP BY 1), h AS (SELECT page, count(*) AS m, string_agg(k::VARCHAR, ',' ORDER BY k) AS j FROM got GROUP BY 1)
SELECT page, CASE WHEN n IS NULL THEN 'unexpected' WHEN m IS NULL THEN 'missing' WHEN m < n THEN 'short' WHEN m > n THEN 'surplus' WHEN j <> k THEN 'other_keys' ELSE 'complete' END AS status FROM w FULL JOIN h USING (page)""")
def arrived_pages(spark, d):
    """Pages that came incomplete, twice, under another number or not at all are found by their inventory."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    n = written(N.numbered(o.select("o_orderkey"), ["o_orderkey"], "n", start=0).select("o_orderkey", F.floor(F.col("n") / 50).cast("long").alias("page")), "arrived")
    came = n.where((k % 397 != 3) & (F.col("page") % 40 != 7)).select("o_orderkey", (F.col("page") + F.when(k % 911 == 5, 1).otherwise(0)).alias("page"))
    came = came.unionByName(n.where(k % 401 == 9)).unionByName(n.where(k % 997 == 1).withColumn("page", F.col("page") + 1_000_000))
    return N.checked_pages(N.pages(o, "o_orderkey", 50), came, "page", "o_orderkey")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 7 THEN o_orderkey - 300 WHEN o_orderkey % 1013 = 11 THEN NULL ELSE o_orderkey END AS k, o_orderkey % 499 = 3 AS ragged FROM orders),
l AS (SELECT *, lag(k) OVER (ORDER BY o_orderkey) AS before FROM p)
SELECT o_orderkey, 'not_ascending' AS fault FROM l WHERE k <= before UNION ALL SELECT o_orderkey, 'null_key' FROM l WHERE k IS NULL UNION ALL SELECT o_orderkey, 'ragged' FROM l WHERE ragged""")
def payload_faults(spark, d):
    """Orders stored in order with keys out of place, null keys and arrays of unequal length."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    key = F.when(k % 1009 == 7, k - 300).when(k % 1013 == 11, None).otherwise(k)
    two = F.array(F.lit(1), F.lit(2))
    stored = written(o.select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("o_orderkey", key.alias("key"), two.alias("a"), F.when(k % 499 == 3, F.array(F.lit(1))).otherwise(two).alias("b")), "payload")
    faults = N.order_faults(stored, "key", ["a", "b"])
    named = stored.select(F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("place"), "o_orderkey")
    return faults.join(named, ["part", "place"]).select("o_orderkey", "fault")


# shards

_SHARD_COLUMNS = {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint"}


@query("""WITH d AS (SELECT 's' || l_suppkey % 8 AS shard, sha256('["' || l_orderkey || '","' || l_linenumber || '","' || l_partkey || '","' || l_suppkey || '"]') AS d FROM lineitem)
SELECT shard, count(*) AS rows, sha256(count(*) || ',' || sum(('0x' || d[1:16])::UBIGINT)::VARCHAR || ',' || sum(('0x' || d[17:32])::UBIGINT)::VARCHAR || ',' || sum(('0x' || d[33:48])::UBIGINT)::VARCHAR || ',' || sum(('0x' || d[49:64])::UBIGINT)::VARCHAR) AS digest, 'verified' AS status FROM d GROUP BY 1""")
def verified_shards(spark, d):
    """Line items in eight shards, built in two goes; what the second finds verified it leaves alone."""
    kinds = dict(t(spark, d, "lineitem").dtypes)
    li = t(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("shard"), *_SHARD_COLUMNS)
    s = Shards(spark, new_path(spark, "shards"), {c: kinds[c] for c in _SHARD_COLUMNS})
    names = li.select("shard").distinct()
    make = lambda todo: li.join(todo, "shard")
    s.build(names.where("shard < 's4'"), make)
    s.build(names, make)
    digests = shard_digests(s.read(), "shard", list(_SHARD_COLUMNS))
    return digests.join(s.status().select("shard", "status"), "shard").select("shard", "rows", "digest", "status")


# reconstruction


@query("""WITH b AS (SELECT 'n' || c_nationkey AS area, count(*) AS blocks FROM customer GROUP BY 1) SELECT area, blocks, 0::BIGINT AS differing, false AS base_differs FROM b""")
def reconstructed_blocks(spark, d):
    """Customers as blocks of nations: scores and bases made twice, by two algorithms; how many differ."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("area"), (k % 13).alias("pop"), F.when(k % 11 != 0, F.abs(F.round("c_acctbal", 1))).alias("a"), (k % 23 / 7).alias("b"), (F.col("c_mktsegment") != "MACHINERY").alias("inside"))
    parts = {"a": 0.6, "b": 0.4}
    built = written(block_scores(c, "c_custkey", "pop", parts, F.col("inside")), "built")
    again = O.reconstructed_scores(c, "c_custkey", "pop", parts, F.col("inside"))
    off = O.differences(built, again, "c_custkey", {"a_pct": 1e-9, "b_pct": 1e-9, "composite": 1e-9})
    scored = written(c.join(built, "c_custkey"), "scored")
    one = aggregate_blocks(scored, ["area"], "pop", F.lit(True))
    areas = O.differences(one, O.reconstructed_areas(scored, "area", "pop", F.lit(True)), "area", {"covered": 0, "base_micros": 0, "magnitude": 1e-9}).select(F.col("area").alias("_area")).distinct()
    per = c.join(off.select(F.col("c_custkey").alias("_k")), k == F.col("_k"), "left").groupBy("area").agg(F.count_distinct("c_custkey").alias("blocks"), F.count("_k").alias("differing"))
    return per.join(areas, F.col("area") == F.col("_area"), "left").select("area", "blocks", "differing", F.col("_area").isNotNull().alias("base_differs"))


# the antimeridian

_SHAPE = ((0.0, 0.0), (9.0, 2.0), (7.5, 8.0), (1.0, 5.0))


@query(f"""WITH f AS (SELECT c_custkey, (165 + c_custkey % 25)::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer),
s(i, dx, dy) AS (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_SHAPE))}),
p AS (SELECT c_custkey, i, x + dx AS x, y + dy AS y FROM f, s), e AS (SELECT a.*, b.x AS bx, b.y AS by, a.x * b.y - b.x * a.y AS area FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND b.i = (a.i + 1) % 4),
w AS (SELECT c_custkey, min(x) AS low, max(x) AS high, round(abs(sum(area)) / 2, 6) AS area FROM e GROUP BY 1)
SELECT c_custkey, CASE WHEN low < 180 AND high > 180 THEN 2 ELSE 1 END::BIGINT AS parts, area, round(CASE WHEN low < 180 AND high > 180 THEN -180 WHEN low >= 180 THEN low - 360 ELSE low END, 6)::DOUBLE AS west, round(CASE WHEN low < 180 AND high > 180 THEN 180 WHEN low >= 180 THEN high - 360 ELSE high END, 6)::DOUBLE AS east FROM w""")
def antimeridian_parts(spark, d):
    """Quadrilaterals around the antimeridian, cut there: their parts' areas add up to the whole."""
    k = F.col("c_custkey")
    wrap = lambda v: F.when(v > 180, v - 360).otherwise(v)
    ring = F.array(*[F.struct(wrap((165 + k % 25 + x).cast("double")).alias("x"), (F.col("c_nationkey") + y).cast("double").alias("y")) for x, y in _SHAPE])
    parts = M.cut_rings(t(spark, d, "customer").select("c_custkey", ring.alias("ring")), "c_custkey", "ring")
    # a corner on the antimeridian itself may be a part without area
    parts = parts.withColumn("area", M.ring_area(F.col("ring"))).where("area > 1e-9").select("c_custkey", "area", F.array_min(F.transform("ring", lambda p: p["x"])).alias("w"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("e"))
    return parts.groupBy("c_custkey").agg(F.count("*").alias("parts"), F.round(F.sum("area"), 6).alias("area"), F.round(F.min("w"), 6).alias("west"), F.round(F.max("e"), 6).alias("east"))

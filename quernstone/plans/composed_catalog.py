"""Queries for composed steps of a build and for migrations, on stand-in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import composed as C
from quernstone.operators.contracts import ContractError, assert_unique, fail_open, multiset_difference
from quernstone.plans.catalog import query, r6, t
from quernstone.sources.migration import Migration
from quernstone.sources.shared import new_path, written
from quernstone.sources.snapshots import open_current, publish


def _two(c, width: int = 2):
    return F.lpad(c.cast("string"), width, "0")


# the national gate

_SHA = "sha256(count(*) || " + " || ".join(f"',' || sum(('0x' || h[{1 + 16 * k}:{16 + 16 * k}])::UBIGINT)::VARCHAR" for k in range(4)) + ")"


@query(f"""WITH b AS (SELECT 'S' || c_nationkey AS state, c_nationkey AS n, c_custkey % 7 AS w, sha256(lpad((CASE WHEN c_nationkey = 8 THEN 7 ELSE c_nationkey END)::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 12, '0')) AS h FROM customer),
g AS (SELECT state, any_value(n) AS n, count(*) AS blocks, sum(w)::BIGINT AS population, {_SHA} AS keys_sha256 FROM b GROUP BY 1)
SELECT state, blocks, population, keys_sha256, CASE WHEN n = 24 THEN 'unexpected' WHEN n = 8 THEN 'wrong_state' WHEN n % 9 = 1 THEN 'blocks' WHEN n % 9 = 2 THEN 'population' WHEN n % 9 = 3 THEN 'keys' ELSE 'complete' END AS status FROM g
UNION ALL SELECT 'S99', 0, 0, NULL, 'missing'""")
def national_gate(spark, d):
    """Customers as blocks of nations against expectations that differ on purpose."""
    n = F.col("c_nationkey")
    b = t(spark, d, "customer").select(F.concat(F.lit("S"), n.cast("string")).alias("state"), F.concat(_two(F.when(n == 8, 7).otherwise(n)), _two(F.col("c_custkey"), 12)).alias("geoid"), (F.col("c_custkey") % 7).alias("people"))
    own = F.concat(F.lit("S"), F.left("geoid", F.lit(2)).cast("int").cast("string"))
    nothing = spark.createDataFrame([], "state string, blocks bigint, population bigint, keys_sha256 string")
    found = written(C.national_gate(b, nothing, "geoid", "state", "people", own).drop("status"), "found")
    k = F.substring("state", 2, 9).cast("int") % 9
    want = found.where("state <> 'S24'").select("state", (F.col("blocks") + (k == 1).cast("int")).alias("blocks"), (F.col("population") - (k == 2).cast("int")).alias("population"), F.when(k == 3, "other").otherwise(F.col("keys_sha256")).alias("keys_sha256"))
    want = want.unionByName(spark.createDataFrame([("S99", 1, 1, None)], want.schema))
    return C.national_gate(b, want, "geoid", "state", "people", own)


# the attached release


@query("""SELECT lpad(c_nationkey::VARCHAR, 2, '0') || 'N' || lpad(c_custkey::VARCHAR, 12, '0') AS place_id, CASE WHEN c_nationkey >= 20 THEN 'outside_scope' WHEN c_nationkey = 5 AND c_custkey % 10 = 0 THEN 'unavailable' WHEN c_custkey % 3 = 0 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN c_nationkey = 5 AND c_custkey % 10 = 0 THEN 0 ELSE 1 - (c_custkey % 3 = 0)::INT * 0.05 END::DOUBLE AS coverage, CASE WHEN NOT (c_nationkey = 5 AND c_custkey % 10 = 0) THEN c_acctbal END AS magnitude FROM customer""")
def attached_release(spark, d):
    """A release whose codes of one state are older than the table's, and which lacks some rows that it may lack."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    code = lambda kind: F.concat(_two(n), kind, _two(k, 12))
    c = t(spark, d, "customer")
    frame = c.select(code(F.lit("N")).alias("place_id"), n.alias("state"), k.alias("k"))
    partial = k % 3 == 0
    release = c.where(~((n == 5) & (k % 10 == 0))).select(code(F.when(n == 9, "O").otherwise("N")).alias("place_id"), F.col("c_acctbal").alias("magnitude"), F.when(partial, "partial").otherwise("complete").alias("status"), (1 - partial.cast("int") * 0.05).cast("double").alias("coverage"))
    gone = spark.createDataFrame([("09O" + "9" * 12, None, "zero_population", 0.0)], release.schema)
    own = C.reconciled_release(frame, written(release.unionByName(gone), "release"), "place_id", "state", 9, "09", 12, gone, (F.col("status") == "zero_population") & (F.col("coverage") == 0) & F.col("magnitude").isNull())
    out = C.attach_release(frame, own, "place_id", F.col("state") < 20, {"magnitude": "double"}, "status", "coverage", (F.col("state") == 5) & (F.col("k") % 10 == 0))
    return out.select("place_id", "status", "coverage", "magnitude")


# the ranking sidecar

KNOTS = ((5.0, 0.0), (8.0, 0.5), (20.0, 1.0))


@query("""WITH h AS (SELECT o_custkey, count(*) AS months, 1e6 / avg(o_totalprice::DECIMAL(18,2))::DOUBLE AS area FROM orders GROUP BY 1),
c AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS place_id, c_name AS name, c_custkey AS k, months, area, CASE WHEN months < 9 THEN NULL WHEN area <= 5 THEN 0 WHEN area >= 20 THEN 1 WHEN area <= 8 THEN (area - 5) / 6 ELSE 0.5 + (area - 8) / 24 END AS u
  FROM customer LEFT JOIN h ON o_custkey = c_custkey WHERE NOT (c_nationkey >= 20 AND c_custkey % 4 = 0))
SELECT place_id, name, months AS housing_valid_months, round(u, 6) AS u_housing, round(u * 0.45 + CASE WHEN k % 7 <> 0 THEN (k % 50) / 50 END * 0.35 + (k % 31) / 31 * 0.2, 6) AS u_affordability FROM c""")
def ranking_sidecar(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = t(spark, d, "customer").select(F.concat(_two(n), _two(k, 9)).alias("place_id"), F.col("c_name").alias("name"), n.cast("string").alias("state"), n.alias("n"), k.alias("k"))
    bundle = c.where("not (n >= 20 and k % 4 = 0)").select(F.col("place_id").alias("county_fips"), F.when(F.col("k") % 7 != 0, F.col("k") % 50 / 50).alias("u_rpp"), (F.col("k") % 31 / 31).alias("u_property_tax"))
    price = F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    market = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("housing_valid_months"), price.alias("median_ppsf"))
    market = c.join(market, "k").select(F.col("place_id").alias("county_fips"), "housing_valid_months", F.lit(1.0).alias("median_active_listings"), "median_ppsf", (1e6 / F.col("median_ppsf")).alias("area"))
    out = C.ranking_sidecar(c.drop("n", "k"), bundle, market, KNOTS, [f"{x:02d}" for x in range(20)], legacy=("09",))
    return out.select("place_id", "name", "housing_valid_months", r6("u_housing", "u_housing"), r6("u_affordability", "u_affordability"))


# enrichments that may fail


@query("""SELECT c_custkey, n_name AS nation, NULL::VARCHAR AS segment, 'segments is not unique' AS warning FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def fail_open_enrichments(spark, d):
    """One enrichment breaks its contract: its column is null, the other one is there."""
    c = t(spark, d, "customer")
    nation = lambda df: df.join(assert_unique(t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")), ["c_nationkey"]), "c_nationkey", "left")
    segment = lambda df: df.join(assert_unique(c.select("c_nationkey", F.col("c_mktsegment").alias("segment")), ["c_nationkey"]), "c_nationkey", "left")
    base, warnings = fail_open(c.select("c_custkey", "c_nationkey"), {"nations": (nation, {"nation": "string"}), "segments": (segment, {"segment": "string"})})
    said = ", ".join(f"{name} is not unique" for name, text in warnings.items() if "not unique" in text)
    return base.select("c_custkey", "nation", "segment", F.lit(said).alias("warning"))


# a migration


def _mean(scored: DataFrame) -> DataFrame:
    """The older aggregate: the mean of scores rounded to two digits."""
    rounded = F.bround(F.col("score"), 2).cast("decimal(20,4)")
    return scored.groupBy("area").agg(F.bround((F.sum(rounded * F.col("people")) / F.sum("people")).cast("double"), 2).alias("mean"), F.sum("people").alias("people"))


@query("""SELECT c_nationkey AS area, (sum((c_acctbal * 100)::BIGINT * (c_custkey % 5 + 1)) // sum(c_custkey % 5 + 1))::BIGINT AS base, sum(c_custkey % 5 + 1)::BIGINT AS people FROM customer GROUP BY 1""")
def migrated_areas(spark, d):
    """A published build of blocks and areas moves to whole-number bases; the old aggregates are made again before the pointer changes."""
    blocks = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("area"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 5 + 1).alias("people"))
    root = new_path(spark, "release")
    old = written(blocks, "blocks")
    publish(spark, root, {"blocks": (old, ["c_custkey"]), "areas": (written(_mean(old), "areas"), ["area"])}, {"version": "1"})

    def make(tables):
        points = F.rint(F.col("score") * 100).cast("long")
        areas = tables["blocks"].withColumn("points", points).groupBy("area").agg(F.expr("sum(points * people) div sum(people)").alias("base"), F.sum("people").alias("people"))
        return {"blocks": (tables["blocks"], ["c_custkey"]), "areas": (written(areas, "areas"), ["area"])}

    def check(was, now):
        if not multiset_difference(_mean(now["blocks"]).select("area", "mean", "people"), was["areas"].select("area", "mean", "people")).isEmpty():
            raise ContractError("the old aggregates can't be made again")

    Migration(spark, root, "bases", ["blocks", "areas"], make, check).run()
    return open_current(spark, root, "areas").select("area", "base", "people")

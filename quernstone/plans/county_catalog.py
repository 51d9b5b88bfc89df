"""Queries of the county measures and of the preference evaluation on stand-in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import county as C
from quernstone.operators import places as L
from quernstone.operators import preference as P
from quernstone.plans.catalog import query, r6, t
from quernstone.sources.shared import written

# preference evaluation

_PLACES = """WITH n AS (SELECT o_custkey, count(*) AS months FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS place_id, c_mktsegment AS state, c_nationkey, (c_acctbal * 20)::BIGINT AS population, months, c_nationkey * 20.0::DOUBLE AS listings, CASE WHEN c_custkey % 11 <> 0 THEN 0.85::DOUBLE + (c_custkey % 16) / 100 END AS crime,
  (c_custkey * 7 % 101) / 100 AS u1, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey * 13 % 101) / 100 END AS u2, (c_custkey * 29 % 101) / 100 AS u3, (c_custkey * 31 % 101) / 100 AS u4, (c_custkey * 37 % 101) / 100 AS u5, (c_custkey * 41 % 101) / 100 AS u6,
  CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey * 2.0::DOUBLE END AS jan, c_custkey % 40 AS heat FROM customer LEFT JOIN n ON o_custkey = c_custkey)"""


def _places(spark, d):
    k, months = F.col("c_custkey"), t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("housing_valid_months"))
    u = {p: (k * m % 101) / 100 for p, m in zip(P.PILLARS, (7, 13, 29, 31, 37, 41), strict=True)} | {"health": F.when(k % 17 != 0, (k * 13 % 101) / 100)}
    return t(spark, d, "customer").join(months, "c_custkey", "left").select(
        k.alias("place_id"), F.col("c_mktsegment").alias("state"), F.rint(F.col("c_acctbal") * 20).cast("long").alias("population"), "housing_valid_months", (F.col("c_nationkey") * 20.0).alias("median_active_listings"),
        F.when(k % 11 != 0, 0.85 + (k % 16) / 100).alias("crime_coverage"), *[v.alias(f"u_{p}") for p, v in u.items()],
        F.when(k % 13 != 0, F.col("c_nationkey") * 2.0).alias("jan_avg_temp_f"), F.lit(None).cast("double").alias("jul_avg_temp_f"), (k % 40).cast("double").alias("extreme_heat_days"), F.lit(1.0).alias("extreme_cold_days"),
    )


_CUSTOM = _PLACES + """, s AS (SELECT *, u1 * 0.15::DOUBLE + u2 * 0.10::DOUBLE + u3 * 0.45::DOUBLE + u4 * 0.15::DOUBLE + u5 * 0.05::DOUBLE + u6 * 0.10::DOUBLE AS v,
  CASE WHEN u2 IS NULL THEN 'missing_core' WHEN crime IS NULL OR crime < 0.9 THEN 'crime_coverage' WHEN population IS NULL OR population < 25000 THEN 'population' END AS a FROM p),
r AS (SELECT *, CASE WHEN a IS NULL THEN v END AS active, coalesce(a, CASE WHEN months IS NULL OR months < 5 THEN 'valid_months' WHEN listings < 100 THEN 'active_listings' WHEN population < 40000 THEN 'population' WHEN state = 'HOUSEHOLD' THEN 'state_exclusion'
  WHEN place_id IN (30, 31, 32, 33, 34, 35, 36, 37, 38, 39) THEN 'region_exclusion' WHEN jan IS NULL OR jan < 12 OR heat > 36 THEN 'climate' WHEN u1 < 0.1 THEN 'min_safety' WHEN u5 < 0.05 THEN 'min_lifestyle' END) AS reason FROM s),
k AS (SELECT *, CASE WHEN a IS NULL THEN rank() OVER (PARTITION BY a IS NULL ORDER BY active DESC) END AS national_rank, CASE WHEN reason IS NULL THEN rank() OVER (PARTITION BY reason IS NULL ORDER BY active DESC) END AS filtered_rank FROM r)"""
_OPTIONS = P.Options(preset="affordability", min_population=40_000, min_valid_months=5, exclude_states=("HOUSEHOLD",), exclude_region="thirties", climate={"min_jan_temp_f": 12, "max_extreme_heat_days": 36}, min_pillars={"safety": 0.1, "lifestyle": 0.05}, regions={"thirties": range(30, 40)})


@query(_CUSTOM + """ SELECT place_id, round(active, 9) AS active_value, reason IS NULL AS eligible, reason, national_rank, filtered_rank, CASE WHEN reason IS NULL THEN NOT EXISTS (SELECT 1 FROM k q WHERE q.reason IS NULL
  AND q.u1 >= k.u1 AND q.u2 >= k.u2 AND q.u3 >= k.u3 AND q.u4 >= k.u4 AND q.u5 >= k.u5 AND q.u6 >= k.u6 AND (q.u1 > k.u1 OR q.u2 > k.u2 OR q.u3 > k.u3 OR q.u4 > k.u4 OR q.u5 > k.u5 OR q.u6 > k.u6)) END AS pareto_optimal FROM k""")
def preference_custom_view(spark, d):
    return P.evaluate_places(_places(spark, d), _OPTIONS).withColumn("active_value", F.round("active_value", 9))


@query(_PLACES + """, r AS (SELECT *, CASE WHEN u2 IS NULL THEN 'missing_active' WHEN population IS NULL OR population < 25000 THEN 'population' END AS a FROM p), s AS (SELECT *, coalesce(a, CASE WHEN state NOT IN ('MACHINERY', 'BUILDING') THEN 'state_filter' END) AS reason FROM r)
SELECT place_id, CASE WHEN a IS NULL THEN round(u2, 9) END AS active_value, reason IS NULL AS eligible, reason, CASE WHEN a IS NULL THEN rank() OVER (PARTITION BY a IS NULL ORDER BY u2 DESC) END AS national_rank,
  CASE WHEN reason IS NULL THEN rank() OVER (PARTITION BY reason IS NULL ORDER BY u2 DESC) END AS filtered_rank, NULL::BOOLEAN AS pareto_optimal FROM s""")
def preference_pillar_view(spark, d):
    return P.evaluate_places(_places(spark, d), P.Options(view="health", include_states=(" machinery", "BUILDING"))).withColumn("active_value", F.round("active_value", 9))


@query(_CUSTOM + """ SELECT count(*)::BIGINT AS reference_count, count(national_rank)::BIGINT AS national_count, count(*) FILTER (WHERE reason IS NULL OR reason IN ('state_exclusion', 'region_exclusion', 'climate', 'min_safety', 'min_lifestyle'))::BIGINT AS eligible_count, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS filtered_count FROM k""")
def preference_counts(spark, d):
    return P.evaluation_counts(P.evaluate_places(_places(spark, d), _OPTIONS)).drop("exclusions")


@query(_CUSTOM + " SELECT place_id, filtered_rank FROM k WHERE reason IS NULL ORDER BY filtered_rank, place_id LIMIT 25")
def ranked_places(spark, d):
    return P.ranked_places(_places(spark, d), _OPTIONS, limit=25).select("place_id", "filtered_rank")


# county measures


@query("""SELECT lpad(c_nationkey::VARCHAR, 2, '0') || CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS county_fips, (c_acctbal * 10)::BIGINT AS population FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey < 20""")
def county_population(spark, d):
    pep = t(spark, d, "customer").select(F.when(F.col("c_mktsegment") != "MACHINERY", "050").otherwise("040").alias("SUMLEV"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATE"), F.col("c_custkey").cast("string").alias("COUNTY"), F.rint(F.col("c_acctbal") * 10).alias("E"))
    return C.population(pep, [f"{k:02d}" for k in range(20)], "2025", "E").select("county_fips", "population")


@query("""SELECT c_custkey AS county_fips, round(1 - p / 100, 6) AS u_hazard, CASE WHEN p IS NULL THEN 'missing' ELSE 'complete' END AS hazard_status, CASE WHEN g BETWEEN 1 AND 10 THEN round((10 - g) / 9, 6) END AS u_community_context
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 101 END AS p, c_nationkey AS g FROM customer)""")
def county_context(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(k.alias("place_id"), F.col("c_mktsegment").alias("state"), F.when(k % 5 != 0, k % 101).alias("res_hazard_npctl"), F.col("c_nationkey").alias("community_conditions_group"))
    return C.runtime_context(c).select("county_fips", r6("u_hazard", "u_hazard"), "hazard_status", r6("u_community_context", "u_community_context"))


_SERIES = """s AS (SELECT (o_custkey % 12)::BIGINT AS ori, (o_custkey % 12 // 2)::BIGINT AS county, CASE WHEN o_orderkey % 2 = 0 THEN 'violent-crime' ELSE 'property-crime' END AS family, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS offenses, 1000 + 100 * (o_custkey % 12) AS pop,
  CASE WHEN (o_custkey % 12 + month(o_orderdate)) % 17 = 0 THEN 0 WHEN o_custkey % 12 = 9 THEN 700 ELSE 1000 + 100 * (o_custkey % 12) END AS part FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY ALL)"""


@query(f"""WITH {_SERIES}, a AS (SELECT county, ori, family, y, count(DISTINCT m) = 12 AS whole, sum(pop) AS pop, sum(CASE WHEN part > 0 THEN offenses END) AS off, sum(CASE WHEN part > 0 THEN part END) AS part FROM s GROUP BY 1, 2, 3, 4),
cells AS (SELECT county, ori, family, y FROM (SELECT DISTINCT county, ori FROM s), (VALUES ('violent-crime'), ('property-crime')) f(family), (VALUES (1996), (1997), (1998)) v(y)),
g AS (SELECT county, family, y, bool_and(coalesce(whole, false)) AS whole, sum(pop) AS pop, sum(off) AS off, sum(part) AS part FROM cells LEFT JOIN a USING (county, ori, family, y) GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN whole AND pop > 0 THEN coalesce(part / pop, 0) END AS cover FROM g),
k AS (SELECT county, bool_and(coalesce(cover >= 0.9, false)) AS ok, min(cover) AS low, sum(off) FILTER (WHERE family = 'violent-crime') / (sum(part) FILTER (WHERE family = 'violent-crime') / 12.0::DOUBLE) * 100000 AS v, sum(off) FILTER (WHERE family = 'property-crime') / (sum(part) FILTER (WHERE family = 'property-crime') / 12.0::DOUBLE) * 100000 AS p FROM c GROUP BY 1),
r AS (SELECT county, ok, CASE WHEN ok THEN low END AS low, CASE WHEN ok THEN v END AS v, CASE WHEN ok THEN p END AS p, count(*) FILTER (WHERE ok) OVER () AS n FROM k),
u AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN n = 1 THEN 1 ELSE (rank() OVER (PARTITION BY ok ORDER BY v DESC) - 1 + (count(*) OVER (PARTITION BY ok, v) - 1) / 2.0) / (n - 1) END AS uv, CASE WHEN NOT ok THEN NULL WHEN n = 1 THEN 1 ELSE (rank() OVER (PARTITION BY ok ORDER BY p DESC) - 1 + (count(*) OVER (PARTITION BY ok, p) - 1) / 2.0) / (n - 1) END AS up FROM r)
SELECT county AS county_fips, round(v, 6) AS crime_violent_rate, round(p, 6) AS crime_property_rate, round(low, 6) AS crime_coverage, round(0.6 * uv + 0.4 * up, 6) AS u_crime, CASE WHEN ok THEN 'complete' ELSE 'below_coverage_or_missing' END AS crime_status FROM u""")
def county_crime(spark, d):
    o, ori = t(spark, d, "orders"), F.col("o_custkey") % 12
    family = F.when(F.col("o_orderkey") % 2 == 0, "violent-crime").otherwise("property-crime")
    s = o.groupBy(ori.alias("ori"), family.alias("family"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("offenses"))
    people = 1000 + 100 * F.col("ori")
    part = F.when((F.col("ori") + F.col("month")) % 17 == 0, 0).when(F.col("ori") == 9, 700).otherwise(people)
    s = s.select("ori", F.expr("ori div 2").alias("county_fips"), "family", "year", "month", "offenses", people.alias("population"), part.alias("participated"))
    return C.crime(s, (1996, 1997, 1998)).select("county_fips", *[r6(c, c) for c in ("crime_violent_rate", "crime_property_rate", "crime_coverage", "u_crime")], "crime_status")


@query("""SELECT c_custkey AS county_fips, CASE WHEN tax > 0 AND value > 0 THEN round(tax / value, 6) END AS property_tax_rate, CASE WHEN tax > 0 AND value > 0 THEN 'complete' ELSE 'missing_or_invalid_denominator' END AS property_tax_status
FROM (SELECT c_custkey, c_acctbal AS tax, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey * 1000 END AS value FROM customer WHERE c_custkey % 7 <> 0)""")
def county_property_tax(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    tax = c.where("c_custkey % 7 <> 0").select(k.alias("county_fips"), F.col("c_acctbal").alias("estimate"))
    value = c.where("c_custkey % 6 <> 0").select(k.alias("county_fips"), (F.col("c_nationkey") * 1000).alias("estimate"))
    return C.property_tax(tax, value).withColumn("property_tax_rate", F.round("property_tax_rate", 6))


@query("""SELECT lpad(c_nationkey::VARCHAR, 2, '0') || c_custkey AS county_fips, round(coalesce(m.i, s.i), 6) AS rpp_index, CASE WHEN m.i IS NOT NULL THEN 'metropolitan' ELSE 'state' END AS rpp_geography_type, CASE WHEN coalesce(m.i, s.i) IS NOT NULL THEN 'complete' ELSE 'missing' END AS rpp_status
FROM customer LEFT JOIN (SELECT s_suppkey AS b, s_acctbal AS i FROM supplier WHERE s_suppkey % 4 <> 0) m ON c_custkey % 30 = b LEFT JOIN (SELECT n_nationkey AS k, n_regionkey + 90.0::DOUBLE AS i FROM nation WHERE n_nationkey % 6 <> 0) s ON k = c_nationkey""")
def county_price_parities(spark, d):
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    c = t(spark, d, "customer").select(F.concat(two("c_nationkey"), F.col("c_custkey").cast("string")).alias("county_fips"), (F.col("c_custkey") % 30).alias("cbsa_id"))
    metro = t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("cbsa_id"), F.col("s_acctbal").alias("index"))
    state = t(spark, d, "nation").where("n_nationkey % 6 <> 0").select(two("n_nationkey").alias("state_fips"), (F.col("n_regionkey") + 90.0).alias("index"))
    return C.price_parities(c, c, metro, state).withColumn("rpp_index", F.round("rpp_index", 6))


@query("""WITH j AS (SELECT o_custkey AS k, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS prior, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS now, max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS wage FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, CASE WHEN c_nationkey > 0 AND c_custkey % 9 <> 0 THEN (6 * (c_custkey % 3) + 15) / (c_nationkey * 10) END AS share FROM customer)
SELECT k AS county_fips, CASE WHEN now > 0 THEN round((now - prior) / prior, 6) END AS employment_growth, CASE WHEN now > 0 THEN round(wage, 2) END AS average_weekly_wage, round(share, 6) AS commute_under_30_share, CASE WHEN now > 0 AND share IS NOT NULL THEN 'complete' ELSE 'missing_component' END AS employment_status FROM j JOIN c USING (k) WHERE prior > 0""")
def county_employment(spark, d):
    def book(year):
        o = t(spark, d, "orders").where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("w"))
        text = lambda c: F.col(c).cast("string")
        rows = o.select(F.lit("County").alias("Area Type"), F.lit("0").alias("Own"), F.lit("10").alias("NAICS"), F.lit("A").alias("Qtr"), F.lit("00").alias("St"), text("o_custkey").alias("Cnty"), text("n").alias("Annual Average Employment"), text("w").alias("Annual Average Weekly Wage"))
        return C.annual_jobs(rows.unionByName(rows.withColumn("Own", F.lit("5")))).withColumn("county_fips", F.col("county_fips").cast("long"))

    k = F.col("c_custkey")
    table = t(spark, d, "customer").select(k.alias("county_fips"), (F.col("c_nationkey") * 10).alias("e001"), *[F.when((k % 9 != 0) if j == 4 else F.lit(True), k % 3 + j - 2).alias(f"e00{j}") for j in range(2, 8)])
    out = C.employment(book(1997), book(1998), C.commute(table))
    return out.select("county_fips", r6("employment_growth", "employment_growth"), F.round("average_weekly_wage", 2).alias("average_weekly_wage"), r6("commute_under_30_share", "commute_under_30_share"), "employment_status")


@query("""SELECT CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 5, '0') ELSE p_partkey::VARCHAR END AS county_fips, (p_size - 5) / 40 AS broadband_100_20, CASE WHEN p_size BETWEEN 5 AND 45 THEN 'complete' ELSE 'missing_or_invalid' END AS broadband_status FROM part WHERE p_type = 'ECONOMY'""")
def county_broadband(spark, d):
    p = t(spark, d, "part").select(F.lit("Total").alias("area_data_type"), F.lit("County").alias("geography_type"), F.col("p_partkey").cast("string").alias("geography_id"), F.when(F.col("p_type") == "ECONOMY", "Any Terrestrial").otherwise("Fiber").alias("technology"), F.lit("R").alias("biz_res"), ((F.col("p_size") - 5) / 40).cast("string").alias("speed_100_20"))
    return C.broadband(p).select("county_fips", "broadband_100_20", "broadband_status")


@query("""WITH st AS (SELECT s_suppkey AS station, s_nationkey AS county, s_acctbal AS heat, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 2 END AS cold, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 3 END AS jan, s_acctbal / 4 AS jul FROM supplier),
g AS (SELECT county, count(*) AS n, avg(jan) AS jan, avg(jul) AS jul, avg(heat) AS heat, avg(cold) AS cold FROM st WHERE cold IS NOT NULL AND jan IS NOT NULL GROUP BY 1)
SELECT n_nationkey AS county_fips, round(jan, 6) AS jan_avg_temp_f, round(jul, 6) AS jul_avg_temp_f, round(heat, 6) AS extreme_heat_days, round(cold, 6) AS extreme_cold_days, coalesce(n, 0)::BIGINT AS climate_station_count, CASE WHEN n > 0 THEN 'complete_in_county_station_mean' ELSE 'missing_no_qualifying_in_county_station' END AS climate_coverage_status FROM nation LEFT JOIN g ON county = n_nationkey""")
def county_climate(spark, d):
    s, k, v = t(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_acctbal")
    annual = s.select(k.alias("station"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), v.alias("heat"), F.when(k % 7 != 0, v / 2).alias("cold"))
    month = lambda m, c: s.select(k.alias("station"), F.lit(m).alias("month"), c.alias("normal"))
    found = C.stations(annual, month("01", F.when(k % 5 != 0, v / 3)).unionByName(month("07", v / 4)).unionByName(month("04", v)))
    out = C.climate(t(spark, d, "nation").select(F.col("n_nationkey").alias("county_fips")), found, s.select(k.alias("station"), F.col("s_nationkey").alias("county_fips")))
    return out.select("county_fips", *[r6(c, c) for c in C.CLIMATE_MEASURES], "climate_station_count", "climate_coverage_status")


_WATER = """WITH sys AS (SELECT s_suppkey AS k, 'AA' || lpad(s_suppkey::VARCHAR, 6, '0') AS id, (s_suppkey * 37 % 5000)::DOUBLE AS people, CASE s_suppkey % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'retail' END AS class FROM supplier WHERE s_suppkey * 37 % 5000 > 0),
b AS (SELECT l_suppkey AS k, l_partkey % 40 AS block, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
blocks AS (SELECT b.k, block, '01' || lpad((block % 9 + 1)::VARCHAR, 3, '0') AS county, q FROM b JOIN sys USING (k) WHERE class = 'retail' AND k % 13 <> 0),
prov AS (SELECT k, CASE k % 3 WHEN 0 THEN 'supplied' WHEN 1 THEN 'modeled' ELSE 'mixed' END AS p FROM sys WHERE k % 13 <> 0), bad AS (SELECT k FROM sys WHERE k % 4 = 0),
part AS (SELECT k, county, sum(q) AS part FROM blocks WHERE county <> '09001' GROUP BY 1, 2), split AS (SELECT k, county, p, people * part / sum(part) OVER (PARTITION BY k) AS a FROM part JOIN sys USING (k) JOIN prov USING (k)),
got AS (SELECT county, sum(a) AS a, sum(CASE WHEN k IN (SELECT k FROM bad) THEN a ELSE 0 END) AS v, count(DISTINCT p) AS kinds, min(p) AS p FROM split GROUP BY 1),
open AS (SELECT k, people, CASE WHEN k % 26 = 0 THEN 2 ELSE 1 END AS served FROM sys WHERE class = 'unknown' OR (class = 'retail' AND k NOT IN (SELECT k FROM split))),
unc AS (SELECT county, sum(CASE WHEN served = 1 THEN people ELSE 0 END) AS u, bool_or(served = 2) AS amb FROM open, (VALUES ('01001', 0), ('01002', 1)) w(county, odd) WHERE served = 2 OR k % 2 = odd GROUP BY 1),
bl AS (SELECT block, county, max(q) AS most, sum(q) AS every FROM blocks GROUP BY 1, 2), proxy AS (SELECT county, sum(most) AS most, sum(every) AS every FROM bl GROUP BY 1),
c AS (SELECT '01' || lpad(i::VARCHAR, 3, '0') AS county FROM range(1, 10) r(i) UNION ALL SELECT '09001'),
f AS (SELECT c.county, coalesce(a, 0) AS a, v, kinds, p, coalesce(u, 0) AS u, coalesce(amb, false) AS amb, most, every FROM c LEFT JOIN got USING (county) LEFT JOIN unc USING (county) LEFT JOIN proxy USING (county))
SELECT county AS county_fips, round(CASE WHEN a > 0 THEN v / a END, 6) AS water_violation_share, round(most / 1e6, 9) AS public_water_coverage, round(CASE WHEN a + u > 0 THEN a / (a + u) END, 6) AS water_allocation_coverage, CASE WHEN kinds = 1 THEN p WHEN kinds > 1 THEN 'mixed' END AS water_boundary_provenance,
  round((every - most) / every, 6) AS water_overlap_duplicate_share_proxy,
  CASE WHEN county = '09001' THEN 'missing_legacy_geography' WHEN amb THEN 'ambiguous_served_counties' WHEN a + u = 0 THEN 'missing_no_allocatable_systems' WHEN a / (a + u) < 0.9 THEN 'below_allocation_coverage' ELSE 'complete' END AS water_status FROM f"""


@query(_WATER)
def county_water(spark, d):
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    pwsid = lambda c: F.concat(F.lit("AA"), F.lpad(c.cast("string"), 6, "0"))
    whole = F.when(k % 10 == 0, "?").when(k % 10 <= 3, "Y").otherwise("N")
    systems = s.select(pwsid(k).alias("PWSID"), F.lit("AA").alias("PRIMACY_AGENCY_CODE"), F.lit("A").alias("PWS_ACTIVITY_CODE"), F.lit("CWS").alias("PWS_TYPE_CODE"), (k * 37 % 5000).cast("string").alias("POPULATION_SERVED_COUNT"), whole.alias("IS_WHOLESALER_IND"), F.lit("Y").alias("SUBMISSION_STATUS_CODE"))
    service = s.select(pwsid(k).alias("PWSID"), F.when(k % 10 == 1, "WH").when(k % 10 == 2, "RA").otherwise("MH").alias("SERVICE_AREA_TYPE_CODE"))
    found = C.water_systems(systems, service)
    listed = s.where("s_suppkey % 13 <> 0")
    kinds = listed.select(pwsid(k).alias("PWSID"), F.explode(F.when(k % 3 == 0, F.array(F.lit("System Sourced"))).when(k % 3 == 1, F.array(F.lit("Modeled"))).otherwise(F.array(F.lit("Modeled"), F.lit("System Sourced")))).alias("Symbology_Field"))
    block = F.col("l_partkey") % 40
    geo = F.concat(F.lit("01"), F.lpad((block % 9 + 1).cast("string"), 3, "0"), F.lpad(block.cast("string"), 10, "0"))
    blocks = t(spark, d, "lineitem").select(geo.alias("GEOID20"), F.concat(pwsid(F.col("l_suppkey")), F.lit(" ; ZZ")).alias("PWSID"), F.col("l_quantity").cast("string").alias("Pop20_AW"))
    active = found.where("class = 'retail'").join(listed.select(pwsid(k).alias("PWSID")), "PWSID", "left_semi")
    bad = s.where("s_suppkey % 4 = 0").select(pwsid(k).alias("PWSID"), k.alias("VIOLATION_ID"), F.lit("06/01/2024").alias("NON_COMPL_PER_BEGIN_DATE"), F.lit("").alias("NON_COMPL_PER_END_DATE"), F.lit("Y").alias("IS_HEALTH_BASED_IND"))
    bad = bad.unionByName(s.where("s_suppkey % 4 = 1").select(pwsid(k), k, F.lit("06/01/2024"), F.lit("12/31/2024"), F.lit("Y")).toDF(*bad.columns))
    ansi = F.when(k % 26 == 0, F.array(F.lit("001"), F.lit("002"))).when(k % 2 == 0, F.array(F.lit("001"))).otherwise(F.array(F.lit("002")))
    areas = s.select(pwsid(k).alias("PWSID"), F.explode(ansi).alias("ANSI_ENTITY_CODE"))
    counties = spark.range(1, 11).select(F.expr("if(id = 10, '09001', concat('01', lpad(id, 3, '0')))").alias("county_fips"), F.lit(1e6).alias("base_2020"))
    out = C.water(counties, found, C.violating_systems(bad, "2025-01-01", "2025-12-31"), C.boundary_provenance(kinds), C.served_blocks(blocks, active), areas, {"AA": "01"})
    return out.select("county_fips", *[F.round(c, 6).alias(c) for c in ("water_violation_share",)], F.round("public_water_coverage", 9).alias("public_water_coverage"), r6("water_allocation_coverage", "water_allocation_coverage"), "water_boundary_provenance", r6("water_overlap_duplicate_share_proxy", "water_overlap_duplicate_share_proxy"), "water_status")


_BUILD = """WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS a, c_custkey % 23 AS b, c_custkey % 31 AS c, c_acctbal AS d, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 19 END AS e, c_custkey % 29 AS f, c_custkey % 11 AS g, c_custkey % 7 AS h, round(c_acctbal / 1000, 1) AS i,
  CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 101 / 100 END AS hazard, c_custkey % 51 / 50 AS crime, CASE WHEN c_custkey % 12 <> 0 THEN c_custkey % 41 / 40 END AS water, c_nationkey / 25 AS context, c_custkey % 61 / 60 AS band, c_nationkey % 5 / 4 AS home FROM customer),
u AS (SELECT *, RANKED FROM m),
p AS (SELECT *, (ua + ub + uc) / 3 AS care, 0.5 * uf + 0.25 * ug + 0.25 * uh AS jobs FROM u)
SELECT k AS county_fips, round(care, 6) AS u_healthcare, round(jobs, 6) AS u_employment, round(hazard * 0.5 + crime * 0.35 + water * 0.15, 6) AS u_safety, round(care * 0.6 + context * 0.4, 6) AS u_health, round(jobs * 0.6 + band * 0.4, 6) AS u_opportunity, round(ui, 6) AS u_lifestyle, round(ud, 6) AS u_rpp, round(ue, 6) AS u_property_tax,
  CASE WHEN care IS NULL THEN 'missing_component' ELSE 'complete' END AS healthcare_status, CASE WHEN hazard + crime + water + care + context + jobs + band + ui + home IS NOT NULL THEN 'complete_public_core' ELSE 'partial_public_core' END AS coverage_status FROM p""".replace(
    "RANKED", ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}{' DESC' if c in 'de' else ''}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY {c} IS NULL) - 1) END AS u{c}" for c in "abcdefghi")
)


def _built(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    stage = lambda **m: c.select(k.alias("county_fips"), *[v.cast("double").alias(n) for n, v in m.items()])
    n, v = F.col("c_nationkey"), F.col("c_acctbal")
    stages = [
        stage(provider_primary_care=F.when(k % 9 != 0, n), provider_mental_health=k % 23, provider_dental=k % 31), stage(rpp_index=v), stage(property_tax_rate=F.when(k % 8 != 0, k % 19)),
        stage(employment_growth=k % 29, average_weekly_wage=k % 11, commute_under_30_share=k % 7), stage(mountain_magnitude=F.round(v / 1000, 1)), stage(u_hazard=F.when(k % 10 != 0, k % 101 / 100)), stage(u_crime=k % 51 / 50),
        stage(u_water=F.when(k % 12 != 0, k % 41 / 40)), stage(u_community_context=n / 25), stage(broadband_100_20=k % 61 / 60), stage(homeschool_utility=n % 5 / 4),
    ]
    return C.finish_counties(C.calibrate_counties(C.assemble(c.select(k.alias("county_fips")), stages)))


@query(_BUILD)
def county_build(spark, d):
    """Stages joined, ranked and mixed into pillars."""
    shown = ("u_healthcare", "u_employment", "u_safety", "u_health", "u_opportunity", "u_lifestyle", "u_rpp", "u_property_tax")
    return _built(spark, d).select("county_fips", *[r6(c, c) for c in shown], "healthcare_status", "coverage_status")


@query("""SELECT k AS county_fips, 'u_rpp' AS utility FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 = 7)""")
def county_calibration_drift(spark, d):
    """Utilities moved off their rank are found, and no others."""
    b = _built(spark, d).withColumn("u_rpp", F.when(F.col("county_fips") % 50 == 7, F.col("u_rpp") + 1e-9).otherwise(F.col("u_rpp")))
    b = b.withColumns({c: F.lit(None).cast("double") for c in ("crime_violent_rate", "crime_property_rate", "u_crime_violent", "u_crime_property")})
    return C.calibration_drift(b)


# places

_STATES = {f"{k:02d}": f"S{k}" for k in range(0, 25, 2)}


@query("""SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS place_id, CASE WHEN c_nationkey % 2 = 0 THEN 'S' || c_nationkey ELSE '??' END AS state, coalesce(n.code, '00000') AS county_fips, coalesce(n.n, 'Unknown County') AS county_name, n.grp AS community_conditions_group,
  (CASE WHEN a IN ('valid', 'not_applicable') THEN 1 ELSE 0 END + 1)::INT AS available, CASE WHEN a = 'missing' OR a = 'invalid' THEN 'partial' ELSE 'complete' END AS quality
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'missing' WHEN 2 THEN 'invalid' ELSE 'valid' END AS a FROM customer)
LEFT JOIN (SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 2, '0') || '000' AS code, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' County' ELSE '' END AS n, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 10 END AS grp FROM nation WHERE n_nationkey % 5 <> 0) n ON n_nationkey = c_nationkey AND c_custkey < 1000000""")
def scored_grains(spark, d):
    """Customers as tracts of nations as counties."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rating = F.when(k % 4 == 0, "Not Applicable").when(k % 4 == 1, "Insufficient Data").when(k % 4 == 2, "Not Applicable").otherwise("Very Low")
    tracts = t(spark, d, "customer").select(F.concat(two(n), F.lpad(k.cast("string"), 9, "0")).alias("tract_id"), F.when(k % 4 >= 2, k * 1.0).alias("alrb_a"), rating.alias("ealr_a"), F.abs("c_acctbal").alias("alrb_b"), F.lit("Very High").alias("ealr_b"))
    counties = t(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(two(F.col("n_nationkey")), F.lit("000")).alias("county_fips"), F.col("n_name").alias("county"), F.when(F.col("n_nationkey") % 3 == 0, " County ").alias("county_type"), F.lit("").alias("state"), F.lit(1.0).alias("alrb_a"))
    group = t(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.concat(two(F.col("n_nationkey")), F.lit("000")).alias("county_fips"), (F.col("n_nationkey") % 10).alias("community_conditions_group"))
    got = L.score_grains(tracts, counties, group, ["a", "b"], _STATES)[0]
    return got.select("place_id", "state", "county_fips", "county_name", "community_conditions_group", F.col("res_hazard_available_count").alias("available"), F.col("res_hazard_data_quality").alias("quality"))


def _levels(spark, d):
    s = t(spark, d, "supplier")
    lines = F.explode(F.array(F.lit(1), F.lit(2), F.lit(9)))
    raw = s.select(F.concat(F.lit(' "'), F.lpad((F.col("s_suppkey") + 1).cast("string"), 5, "0"), F.lit('"')).alias("GeoFIPS"), F.concat("s_name", F.lit(" *")).alias("GeoName"), F.lit("MARPP").alias("TableName"), F.lit("Index").alias("Unit"), lines.alias("LineCode"), "s_nationkey")
    raw = raw.withColumn("2024", (90 + F.col("s_nationkey") + F.col("LineCode")).cast("string"))
    rest = raw.limit(1).select(F.explode(F.array(F.lit("98765"), F.lit("00000"))).alias("GeoFIPS"), F.lit("rest").alias("GeoName"), "TableName", "Unit", "s_nationkey").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("LineCode"), F.lit("88").alias("2024"))
    return L.price_levels(raw.unionByName(rest), "2024", {1: "all_items", 2: "goods"}, "98765")


@query("""SELECT lpad((s_suppkey + 1)::VARCHAR, 5, '0') AS geography_id, s_name AS geography_name, (91 + s_nationkey)::DOUBLE AS all_items, (92 + s_nationkey)::DOUBLE AS goods FROM supplier UNION ALL SELECT '98765', 'rest', 88.0::DOUBLE, 88.0::DOUBLE""")
def price_levels(spark, d):
    return _levels(spark, d)


_ASSIGNED = """WITH c AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 12, '0') AS county, c_nationkey AS st, c_custkey % 40 AS metro FROM customer)"""


def _assigned(spark, d, **how):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = t(spark, d, "customer").select(F.concat(F.lpad(n.cast("string"), 2, "0"), F.lpad(k.cast("string"), 12, "0")).alias("county_fips"), F.lpad((k % 40).cast("string"), 5, "0").alias("cbsa_id"))
    return L.assign_price_levels(c, c, _levels(spark, d), "98765", [f"{x:02d}" for x in range(20)], ["20", "21"], **how)


@query(_ASSIGNED + """ SELECT county AS county_fips, CASE WHEN st < 20 THEN CASE WHEN s_suppkey IS NOT NULL THEN lpad(metro::VARCHAR, 5, '0') ELSE '98765' END END AS geography_id, CASE WHEN st < 20 THEN CASE WHEN s_suppkey IS NOT NULL THEN 'metropolitan' ELSE 'nonmetropolitan' END END AS geography_type,
  CASE WHEN st < 20 THEN 'complete' WHEN st < 22 THEN 'outside_scope' ELSE 'unmatched_geography' END AS coverage_status, CASE WHEN st < 20 THEN coalesce(91 + s_nationkey, 88)::DOUBLE END AS all_items FROM c LEFT JOIN supplier ON s_suppkey + 1 = metro""")
def assigned_price_levels(spark, d):
    return _assigned(spark, d).select("county_fips", "geography_id", "geography_type", "coverage_status", "all_items")


@query(_ASSIGNED + """ SELECT county || '000001' AS tract_id, CASE WHEN st < 20 THEN CASE WHEN s_suppkey IS NOT NULL THEN 'metropolitan' ELSE 'state' END END AS geography_type, CASE WHEN st < 20 THEN coalesce(91 + s_nationkey, 70 + st)::DOUBLE END AS all_items, CASE WHEN st < 20 THEN 'complete' WHEN st < 22 THEN 'outside_scope' ELSE 'unmatched_geography' END AS coverage_status
FROM c LEFT JOIN supplier ON s_suppkey + 1 = metro UNION ALL SELECT '99999000001', NULL, NULL, 'unmatched_geography'""")
def inherited_price_levels(spark, d):
    own = spark.range(25).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("state_fips"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("geography_id"), F.lit("x").alias("geography_name"), (70.0 + F.col("id")).alias("all_items"), F.lit(1.0).alias("goods"))
    a = _assigned(spark, d, state_levels=own)
    tracts = a.select(F.concat("county_fips", F.lit("000001")).alias("tract_id")).unionByName(spark.range(1).select(F.lit("99999000001").alias("tract_id")))
    return L.inherit_price_levels(tracts, a).select("tract_id", "geography_type", "all_items", "coverage_status")


# the whole build out of its stages

_YEARS = (1996, 1997, 1998)
_RELEASE = """WITH c AS (SELECT c_custkey % 100000 AS k, min(c_nationkey) AS n, max(c_acctbal) AS v FROM customer GROUP BY 1),
o AS (SELECT o_custkey % 100000 AS k, count(*) AS orders, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS prior, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS now, max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS wage,
  count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 2 = 0) AS viol, count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 2 = 1) AS prop FROM orders GROUP BY 1),
s AS (SELECT p_partkey % 100000 AS k, max(p_size) AS s FROM part GROUP BY 1),
st AS (SELECT s_suppkey * 17 % 1000 AS k, count(*) AS stations, avg(s_acctbal) AS heat FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 GROUP BY 1),
x AS (SELECT c.*, coalesce(orders, 0) AS orders, prior, now, wage, coalesce(viol, 0)::DOUBLE AS viol, coalesce(prop, 0)::DOUBLE AS prop, s, stations, heat, (round_even(abs(v), 0) + 1)::BIGINT AS pop, (500 + k % 7 * 10)::DOUBLE AS people, k % 11 <> 3 AS ok,
    (SELECT i FROM (SELECT s_suppkey AS b, s_acctbal AS i FROM supplier WHERE s_suppkey % 4 <> 0) WHERE b = k % 30) AS metro FROM c LEFT JOIN o USING (k) LEFT JOIN s USING (k) LEFT JOIN st USING (k)),
m AS (SELECT *, orders::DOUBLE / pop * 100000 AS a, (k % 23)::DOUBLE / pop * 100000 AS b, (k % 31)::DOUBLE / pop * 100000 AS c, coalesce(metro, CASE WHEN k // 1000 % 6 <> 0 THEN 90 + k // 1000 % 10 END)::DOUBLE AS d,
    CASE WHEN k % 7 <> 0 AND k % 6 <> 0 AND v > 0 AND n > 0 THEN v / (n * 1000) END AS e, CASE WHEN prior > 0 AND now > 0 THEN (now - prior)::DOUBLE / prior END AS f, CASE WHEN prior > 0 AND now > 0 THEN wage END AS g,
    CASE WHEN prior > 0 AND n > 0 AND k % 9 <> 0 THEN (6 * (k % 3) + 15)::DOUBLE / (n * 10) END AS h, round(v / 1000, 1) AS i, CASE WHEN ok THEN viol / (36 * people / 12.0::DOUBLE) * 100000 END AS q, CASE WHEN ok THEN prop / (36 * people / 12.0::DOUBLE) * 100000 END AS r,
    CASE WHEN k % 10 <> 0 THEN 1 - k % 101 / 100.0::DOUBLE END AS hazard, CASE WHEN n BETWEEN 1 AND 10 THEN (10 - n) / 9.0::DOUBLE END AS context, CASE WHEN k // 1000 = 9 THEN 'missing_legacy_geography' WHEN k % 13 = 0 THEN 'missing_no_allocatable_systems' ELSE 'complete' END AS water_status,
    (s - 1) / 49.0::DOUBLE AS band, n % 5 / 4.0::DOUBLE AS home FROM x),
w AS (SELECT *, CASE WHEN water_status = 'complete' THEN 1.0::DOUBLE - (k % 4 = 0)::INT END AS water FROM m),
u AS (SELECT *, RANKED FROM w),
z AS (SELECT *, (ua + ub + uc) / 3 AS care, 0.5 * uf + 0.25 * ug + 0.25 * uh AS jobs, 0.6 * uq + 0.4 * ur AS crime FROM u)
SELECT lpad(k::VARCHAR, 5, '0') AS county_fips, pop AS population, round(care, 6) AS u_healthcare, round(jobs, 6) AS u_employment, round(crime, 6) AS u_crime, round(hazard * 0.5 + crime * 0.35 + water * 0.15, 6) AS u_safety, round(care * 0.6 + context * 0.4, 6) AS u_health, round(jobs * 0.6 + band * 0.4, 6) AS u_opportunity,
  round(ui, 6) AS u_lifestyle, round(ud, 6) AS u_rpp, round(ue, 6) AS u_property_tax, round(heat, 6) AS extreme_heat_days, CASE WHEN ok THEN 'complete' ELSE 'below_coverage_or_missing' END AS crime_status, water_status, CASE WHEN stations > 0 THEN 'complete_in_county_station_mean' ELSE 'missing_no_qualifying_in_county_station' END AS climate_coverage_status,
  CASE WHEN hazard + crime + water + care + context + jobs + band + ui + home IS NOT NULL THEN 'complete_public_core' ELSE 'partial_public_core' END AS coverage_status FROM z""".replace(
    "RANKED", ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER () = 1 THEN 1 ELSE (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}{' DESC' if c in 'deqr' else ''}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / (count({c}) OVER () - 1) END END AS u{c}" for c in "abcdefghiqr")
)


@query(_RELEASE)
def county_release(spark, d):
    """Customers as counties: population, context, crime, providers, taxes, prices, jobs, broadband, water and climate through the build's own stages, joined, ranked, mixed and validated."""
    k = F.col("k")
    code = F.lpad(k.cast("string"), 5, "0")
    c = written(t(spark, d, "customer").groupBy((F.col("c_custkey") % 100_000).alias("k")).agg(F.min("c_nationkey").alias("n"), F.max("c_acctbal").alias("v")).withColumn("fips", code), "counties")
    orders = t(spark, d, "orders").withColumn("k", F.col("o_custkey") % 100_000)
    per = written(c.select("k", "fips").join(orders.groupBy("k").agg(F.count("*").alias("orders")), "k", "left"), "per-county")
    text = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    base = c.select(F.col("fips").alias("county_fips"))

    pep = c.select(F.lit("050").alias("SUMLEV"), F.left("fips", F.lit(2)).alias("STATE"), F.right("fips", F.lit(3)).alias("COUNTY"), (F.rint(F.abs("v")) + 1).alias("E"))
    population = written(C.population(pep, [f"{x:02d}" for x in range(100)], "2025", "E"), "population")
    context = C.runtime_context(c.select(F.col("fips").alias("place_id"), text("n").alias("state"), F.when(k % 10 != 0, k % 101).alias("res_hazard_npctl"), F.when(F.col("n").between(1, 10), F.col("n")).alias("community_conditions_group")))

    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(y).alias("year"), F.lit(m).alias("month")) for f in C.FAMILIES for y in _YEARS for m in range(1, 13)]))
    families = list(C.FAMILIES)
    family = F.when(F.col("o_orderkey") % 2 == 0, families[0]).otherwise(families[1])
    reported = orders.groupBy("k", family.alias("family"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("offenses"))
    series = c.select("k", "fips", grid.alias("g")).select("k", "fips", "g.*").join(reported, ["k", "family", "year", "month"], "left")
    people = (500 + k % 7 * 10).cast("double")
    series = series.select(text("k").alias("ori"), F.col("fips").alias("county_fips"), "family", "year", "month", F.coalesce("offenses", F.lit(0)).alias("offenses"), people.alias("population"), F.when(k % 11 == 3, people * 0.8).otherwise(people).alias("participated"))
    crime = C.crime(series, _YEARS)

    care = C.providers(per.select(F.col("fips"), text(F.coalesce("orders", F.lit(0))).alias("primary_care"), text(k % 31).alias("dental")), c.select("fips", text(k % 23).alias("mental_health")))
    care = C.provider_rates(care.join(population.select("county_fips", "population"), "county_fips")).drop("population")
    tax = C.property_tax(c.where("k % 7 <> 0").select(F.col("fips").alias("county_fips"), F.col("v").alias("estimate")), c.where("k % 6 <> 0").select(F.col("fips").alias("county_fips"), (F.col("n") * 1000).alias("estimate")))
    metro = t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("cbsa_id"), F.col("s_acctbal").alias("index"))
    state = spark.range(100).where("id % 6 <> 0").select(F.lpad(text("id"), 2, "0").alias("state_fips"), (90.0 + F.col("id") % 10).alias("index"))
    prices = C.price_parities(base, c.select(F.col("fips").alias("county_fips"), (k % 30).alias("cbsa_id")), metro, state)

    def book(year):
        o = orders.where(F.year("o_orderdate") == year).groupBy("k").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("w"))
        own = F.lpad(text("k"), 5, "0")
        return C.annual_jobs(o.select(F.lit("County").alias("Area Type"), F.lit("0").alias("Own"), F.lit("10").alias("NAICS"), F.lit("A").alias("Qtr"), F.left(own, F.lit(2)).alias("St"), F.right(own, F.lit(3)).alias("Cnty"), text("n").alias("Annual Average Employment"), text("w").alias("Annual Average Weekly Wage")))

    table = c.select(F.col("fips").alias("county_fips"), (F.col("n") * 10).alias("e001"), *[F.when((k % 9 != 0) if j == 4 else F.lit(True), k % 3 + j - 2).alias(f"e00{j}") for j in range(2, 8)])
    jobs = C.employment(book(1997), book(1998), C.commute(table))
    speed = t(spark, d, "part").groupBy((F.col("p_partkey") % 100_000).alias("k")).agg(F.max("p_size").alias("s"))
    band = C.broadband(speed.select(F.lit("Total").alias("area_data_type"), F.lit("County").alias("geography_type"), text("k").alias("geography_id"), F.lit("Any Terrestrial").alias("technology"), F.lit("R").alias("biz_res"), text((F.col("s") - 1) / 49.0).alias("speed_100_20")))

    pwsid = F.concat(F.lit("AA"), "fips")
    systems = C.water_systems(c.select(pwsid.alias("PWSID"), F.lit("AA").alias("PRIMACY_AGENCY_CODE"), F.lit("A").alias("PWS_ACTIVITY_CODE"), F.lit("CWS").alias("PWS_TYPE_CODE"), text(100 + k % 900).alias("POPULATION_SERVED_COUNT"), F.lit("N").alias("IS_WHOLESALER_IND"), F.lit("Y").alias("SUBMISSION_STATUS_CODE")), c.select(pwsid.alias("PWSID"), F.lit("RA").alias("SERVICE_AREA_TYPE_CODE")))
    bad = c.where("k % 4 = 0").select(pwsid.alias("PWSID"), k.alias("VIOLATION_ID"), F.lit("06/01/2024").alias("NON_COMPL_PER_BEGIN_DATE"), F.lit("").alias("NON_COMPL_PER_END_DATE"), F.lit("Y").alias("IS_HEALTH_BASED_IND"))
    blocks = c.where("k % 13 <> 0").select(F.concat("fips", F.lit("0000000001")).alias("GEOID20"), pwsid.alias("PWSID"), F.lit("50").alias("Pop20_AW"))
    nowhere = spark.createDataFrame([], "PWSID string, ANSI_ENTITY_CODE string")
    water = C.water(c.select(F.col("fips").alias("county_fips"), F.lit(1000.0).alias("base_2020")), systems, C.violating_systems(bad, "2025-01-01", "2025-12-31"), C.boundary_provenance(c.select(pwsid.alias("PWSID"), F.lit("System Sourced").alias("Symbology_Field"))), C.served_blocks(blocks, systems), nowhere, {"AA": "01"})

    s, sk, heat = t(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_acctbal")
    annual = s.select(sk.alias("station"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), heat.alias("heat"), F.when(sk % 7 != 0, heat / 2).alias("cold"))
    month = lambda m, v: s.select(sk.alias("station"), F.lit(m).alias("month"), v.alias("normal"))
    found = C.stations(annual, month("01", F.when(sk % 5 != 0, heat / 3)).unionByName(month("07", heat / 4)))
    climate = C.climate(base, found, s.select(sk.alias("station"), F.lpad(text(sk * 17 % 1000), 5, "0").alias("county_fips")))
    rest = c.select(F.col("fips").alias("county_fips"), F.round(F.col("v") / 1000, 1).alias("mountain_magnitude"), (F.col("n") % 5 / 4.0).alias("homeschool_utility"))

    frame = C.assemble(base, [population, context, crime, care, tax, prices, jobs, band, water, climate, rest])
    done = written(C.finish_counties(C.calibrate_counties(frame), ["crime_status", "water_status"]), "release")
    C.validate_counties(done, _YEARS)
    shown = ("u_healthcare", "u_employment", "u_crime", "u_safety", "u_health", "u_opportunity", "u_lifestyle", "u_rpp", "u_property_tax", "extreme_heat_days")
    return done.select("county_fips", "population", *[r6(x, x) for x in shown], "crime_status", "water_status", "climate_coverage_status", "coverage_status")

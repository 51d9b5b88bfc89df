"""Queries over the driver tables, each an operator on a stand-in column, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scalars as S
from quernstone.operators import aggregates as A
from quernstone.operators import contracts as C
from quernstone.operators import enrich as E
from quernstone.operators import ranks as R
from quernstone.operators import raster as G
from quernstone.operators import scores as P
from quernstone.operators.quantiles import exact_quantiles
from quernstone.sources.store import Page, Store
from quernstone.streaming.windows import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ranks and calibration


@query("""WITH n AS (SELECT *, count(*) OVER () AS n FROM part)
SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 0 WHEN n > 1 THEN 100.0 * (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 - 1) / (n - 1) ELSE 0 END, 6) AS pct FROM n""")
def avg_tie_percentile(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") - 1).alias("size"))
    return R.average_tie_percentile(p, "size", "pct", force_zero=True).select("p_partkey", r6("pct", "pct"))


@query("""WITH n AS (SELECT *, count(*) OVER () AS n FROM customer)
SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 - 1) / (n - 1), 6) AS u FROM n""")
def ecdf_utility_inverted(spark, d):
    return R.ecdf(t(spark, d, "customer"), "c_acctbal", "u", invert=True).select("c_custkey", r6("u", "u"))


@query("""WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_retailprice END AS v FROM part),
k AS (SELECT *, count(v) OVER (PARTITION BY p_brand) AS n FROM s)
SELECT p_partkey, round(CASE WHEN v IS NULL THEN NULL WHEN n = 1 THEN 1.0 ELSE
  (rank() OVER (PARTITION BY p_brand ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0 - 1) / (n - 1) END, 6) AS u FROM k""")
def ecdf_finite_subset(spark, d):
    p = t(spark, d, "part").withColumn("v", F.when(F.col("p_size") > 5, F.col("p_retailprice")))
    return R.ecdf(p, "v", "u", by=["p_brand"]).select("p_partkey", r6("u", "u"))


@query("SELECT c_custkey, round(100 * cume_dist() OVER (ORDER BY c_acctbal), 6) AS pct FROM customer")
def max_rank_percentile(spark, d):
    return R.max_rank_percentile(t(spark, d, "customer"), "c_acctbal", "pct").select("c_custkey", r6("pct", "pct"))


@query("""WITH v AS (SELECT p_size, sum(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_retailprice END::DECIMAL(28,6)) AS w FROM part GROUP BY 1),
k AS (SELECT p_size, (sum(w) OVER (ORDER BY p_size) - w)::DOUBLE AS below, (sum(w) OVER ())::DOUBLE AS total FROM v)
SELECT p_partkey, round_even(100.0 * below / total * 100, 0) / 100 AS pct FROM part JOIN k USING (p_size)""")
def weighted_lower_rank(spark, d):
    p = t(spark, d, "part").withColumn("w", F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("p_retailprice")))
    return R.weighted_lower_percentile(p, "p_size", "w", "pct").select("p_partkey", "pct")


@query("""WITH v AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1),
k AS (SELECT p_size, sum(n) OVER (ORDER BY p_size DESC)::DOUBLE AS tail, sum(n) OVER ()::DOUBLE AS total FROM v)
SELECT p_partkey, round_even(log10(total / tail) * 1e4, 0) / 1e4 AS magnitude FROM part JOIN k USING (p_size)""")
def inclusive_tail_magnitude(spark, d):
    return R.inclusive_tail_magnitude(t(spark, d, "part"), "p_size", "magnitude").select("p_partkey", "magnitude")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC)::BIGINT AS place FROM orders")
def competition_rank(spark, d):
    return R.competition_rank(t(spark, d, "orders"), "o_totalprice", "place").select("o_orderkey", "place")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)::BIGINT AS place FROM customer")
def competition_rank_grouped(spark, d):
    return R.competition_rank(t(spark, d, "customer"), "c_acctbal", "place", by=["c_mktsegment"]).select("c_custkey", "place")


@query("""SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM supplier q WHERE q.s_acctbal >= s.s_acctbal AND q.s_nationkey >= s.s_nationkey
  AND (q.s_acctbal > s.s_acctbal OR q.s_nationkey > s.s_nationkey)) AS pareto FROM supplier s""")
def pareto_frontier(spark, d):
    return R.pareto_flags(t(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).select("s_suppkey", "pareto")


@query("""WITH v AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1)
SELECT p_size, n::BIGINT AS n, sum(n) OVER (ORDER BY p_size)::BIGINT AS upto FROM v""")
def cumulative_distinct(spark, d):
    v = t(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return R.running_sums(v, "p_size", {"upto": "n"}).select("p_size", "n", F.col("upto").cast("long").alias("upto"))


# row aggregates and the ensemble

_LISTS = """WITH o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM (SELECT user_id, least(greatest(value, 0), 100) AS v FROM events WHERE value IS NOT NULL))"""


@query(_LISTS + """ SELECT user_id, round(sum(v * exp(-0.45 * i)) / sum(exp(-0.45 * i)), 6) AS spectral,
  round(sum(CASE WHEN i < ceil(n * 0.25) THEN v END) / max(ceil(n * 0.25)), 6) AS worst, round(100 * pow(avg(pow(v / 100, 4)), 0.25), 6) AS power FROM o GROUP BY user_id""")
def hazard_row_aggregates(spark, d):
    """Values beyond the scale count as its end."""
    bounded = F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0))
    e = t(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.collect_list(bounded).alias("v"))
    v = F.col("v")
    return e.select("user_id", r6(S.spectral(v), "spectral"), r6(S.worst_mean(v), "worst"), r6(S.power_mean(v), "power"))


@query("""WITH o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM (SELECT user_id, 100 * value / (SELECT max(value) FROM events) AS v FROM events WHERE value IS NOT NULL))
SELECT user_id, round(sum(v * exp(-0.45 * i)) / sum(exp(-0.45 * i)), 6) AS spectral,
  round(sum(CASE WHEN i < ceil(n * 0.25) THEN v END) / max(ceil(n * 0.25)), 6) AS worst, round(100 * pow(avg(pow(v / 100, 4)), 0.25), 6) AS power FROM o GROUP BY user_id""")
def hazard_row_aggregates_scaled(spark, d):
    events, v = t(spark, d, "events").where("value is not null"), F.col("v")
    most = F.broadcast(events.agg(F.max("value").alias("most")))
    e = events.crossJoin(most).groupBy("user_id").agg(F.collect_list(F.lit(100) * F.col("value") / F.col("most")).alias("v"))
    return e.select("user_id", r6(S.spectral(v), "spectral"), r6(S.worst_mean(v), "worst"), r6(S.power_mean(v), "power"))


_PAIRS = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL WHEN l_tax > 0.06 THEN 'NaN'::DOUBLE WHEN l_tax > 0.055 THEN 'Infinity'::DOUBLE ELSE l_tax - 0.01 * (l_linenumber = 7)::INT END AS raw,
  CASE l_linenumber WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Not Applicable' WHEN 3 THEN 'No Expected Annual Losses' WHEN 4 THEN 'Insufficient Data' WHEN 5 THEN 'odd' WHEN 6 THEN 'Very High' END AS rating FROM lineitem)"""
#: State of every combination, as a table: what is there (null, not finite, negative, zero, positive) by rating.
_STATES = """(VALUES ('Very Low', 'invalid', 'invalid', 'invalid', 'valid', 'valid'), ('Very High', 'invalid', 'invalid', 'invalid', 'valid', 'valid'), ('No Expected Annual Losses', 'invalid', 'invalid', 'invalid', 'valid', 'invalid'),
  ('Not Applicable', 'not_applicable', 'invalid', 'invalid', 'invalid', 'invalid'), ('Insufficient Data', 'missing', 'invalid', 'invalid', 'invalid', 'invalid'), ('odd', 'invalid', 'invalid', 'invalid', 'invalid', 'invalid'),
  (NULL, 'missing', 'invalid', 'invalid', 'valid', 'valid')) AS s(named, none, odd, below, zero, above)"""
_STATE = "CASE WHEN raw IS NULL THEN none WHEN NOT isfinite(raw) THEN odd WHEN raw < 0 THEN below WHEN raw = 0 THEN zero ELSE above END"


def _pairs(spark, d):
    n, tax = F.col("l_linenumber"), F.col("l_tax")
    raw = F.when(tax > 0.07, None).when(tax > 0.06, float("nan")).when(tax > 0.055, float("inf")).otherwise(tax - 0.01 * (n == 7).cast("int"))
    rating = F.when(n == 1, "Very Low").when(n == 2, P.NOT_APPLICABLE).when(n == 3, P.NO_LOSS).when(n == 4, P.NO_DATA).when(n == 5, "odd").when(n == 6, "Very High")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), rating.alias("rating"))


@query(f"SELECT l_orderkey, l_linenumber, {_STATE} AS state FROM {_PAIRS} JOIN {_STATES} ON rating IS NOT DISTINCT FROM named")
def hazard_availability(spark, d):
    return _pairs(spark, d).select("l_orderkey", "l_linenumber", P.availability(F.col("raw"), F.col("rating")).alias("state"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN NOT isfinite(raw) THEN NULL WHEN {_STATE} = 'valid' OR ({_STATE} = 'invalid' AND none <> 'invalid') THEN raw END AS kept
FROM {_PAIRS} JOIN {_STATES} ON rating IS NOT DISTINCT FROM named""")
def hazard_raw_values(spark, d):
    return _pairs(spark, d).select("l_orderkey", "l_linenumber", P.normalised_raw(F.col("raw"), F.col("rating")).alias("kept"))


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal >= 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END END AS v FROM customer),
n AS (SELECT *, count(v) OVER () AS n FROM v)
SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN v = 0 THEN 0 ELSE round(100.0 * (rank() OVER (PARTITION BY v IS NULL ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (n - 1), 6) END AS pct FROM n""")
def property_loss_percentile(spark, d):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    c = t(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, float("nan")).when((k % 5 == 0) & (v >= 0), 0.0).otherwise(v).alias("v"))
    return P.property_loss_percentile(c, "v", "pct").select("c_custkey", r6("pct", "pct"))


@query("""WITH cells AS (SELECT o_custkey, o_orderstatus || o_orderpriority AS h, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS raw FROM orders GROUP BY ALL),
kinds AS (SELECT DISTINCT o_orderstatus || o_orderpriority AS h FROM orders),
long AS (SELECT c_custkey AS k, kinds.h, CASE WHEN kinds.h LIKE 'P%' THEN NULL ELSE raw END AS raw, CASE WHEN kinds.h LIKE 'P%' THEN 'missing' WHEN raw IS NULL THEN 'not_applicable' ELSE 'valid' END AS state
  FROM customer CROSS JOIN kinds LEFT JOIN cells ON o_custkey = c_custkey AND cells.h = kinds.h),
n1 AS (SELECT k, raw, (rank() OVER (PARTITION BY h ORDER BY raw) - 1 + (count(*) OVER (PARTITION BY h, raw) - 1) / 2.0) AS r, count(*) OVER (PARTITION BY h) AS n FROM long WHERE state = 'valid'),
p AS (SELECT k, CASE WHEN raw = 0 OR n = 1 THEN 0 ELSE 100.0 * r / (n - 1) END AS v FROM n1 UNION ALL SELECT k, 0 FROM long WHERE state = 'not_applicable'),
o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v DESC) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM p),
a AS (SELECT k, count(*) AS available, round(sum(v * exp(-0.45 * i)) / sum(exp(-0.45 * i)), 9) AS s, round(sum(CASE WHEN i < ceil(n * 0.25) THEN v END) / max(ceil(n * 0.25)), 9) AS w, round(100 * pow(avg(pow(v / 100, 4)), 0.25), 9) AS m FROM o GROUP BY k),
c AS (SELECT *, count(*) OVER () AS n FROM a),
q AS (SELECT k, available, n, 100.0 * (rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / (n - 1) AS sp, 100.0 * (rank() OVER (ORDER BY w) - 1 + (count(*) OVER (PARTITION BY w) - 1) / 2.0) / (n - 1) AS wp, 100.0 * (rank() OVER (ORDER BY m) - 1 + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / (n - 1) AS mp FROM c),
z AS (SELECT *, round(sp + wp + mp - greatest(sp, wp, mp) - least(sp, wp, mp), 9) AS mid FROM q)
SELECT k AS custkey, round(100.0 * (rank() OVER (ORDER BY mid) - 1 + (count(*) OVER (PARTITION BY mid) - 1) / 2.0) / (n - 1), 6) AS score, round(greatest(sp, wp, mp) - least(sp, wp, mp), 6) AS spread, available::INT AS available,
  CASE WHEN available = (SELECT count(*) FROM kinds) THEN 'complete' ELSE 'partial' END AS quality FROM z""")
def hazard_ensemble(spark, d):
    o = t(spark, d, "orders").withColumn("hazard", F.concat("o_orderstatus", "o_orderpriority"))
    cells = o.groupBy(F.col("o_custkey").alias("custkey"), "hazard").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("raw"))
    kinds = o.select("hazard").distinct().agg(F.sort_array(F.collect_set("hazard")).alias("hs"))
    n = kinds.select(F.size("hs")).first()[0]  # one row: the table's kinds
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(F.broadcast(kinds)).select("custkey", F.explode("hs").alias("hazard"))
    out = F.col("hazard").startswith("P")
    long = base.join(cells, ["custkey", "hazard"], "left").select("custkey", "hazard", F.when(~out, F.col("raw")).alias("raw"), F.when(out, "missing").when(F.col("raw").isNull(), "not_applicable").otherwise("valid").alias("state"))
    return P.ensemble(long, "custkey", n).select("custkey", r6("score", "score"), r6("spread", "spread"), "available", "quality")


# weighted aggregation


@query("""SELECT c_nationkey, round_even(sum(CASE WHEN p_size <> 7 THEN l_extendedprice::DECIMAL(16,4) * l_quantity::DECIMAL(14,4) END)::DOUBLE / sum(CASE WHEN p_size <> 7 THEN l_quantity END::DECIMAL(20,4))::DOUBLE * 1e2, 0) / 1e2 AS price,
  round(coalesce(sum(CASE WHEN p_size <> 7 THEN l_quantity END::DECIMAL(20,4)), 0)::DOUBLE / sum(l_quantity::DECIMAL(20,4))::DOUBLE, 6) AS coverage,
  CASE WHEN c_nationkey = 5 THEN 'outside_scope' WHEN sum(l_quantity) = 0 THEN 'zero_population' WHEN coverage >= 1 - 1e-9 THEN 'complete' WHEN coverage >= 0.9 THEN 'partial' ELSE 'insufficient_coverage' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY c_nationkey""")
def weighted_geo_means(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    o, c, p = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "part").select("p_partkey", "p_size")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    j = j.withColumn("price", F.when(F.col("p_size") != 7, F.col("l_extendedprice")))
    w = A.weighted_means(j, ["c_nationkey"], "l_quantity", {"price": 2})
    return w.select("c_nationkey", "price", r6("price_coverage", "coverage")).withColumn("status", A.coverage_status(F.col("c_nationkey") != 5, F.lit(1), F.col("coverage")))


@query("""WITH s AS (SELECT p_brand, sum((45 * (p_partkey % 10) + 20 * (p_size % 7) + 35 * (p_size % 3)) * p_size)::BIGINT * 100 AS top, sum(p_size)::BIGINT AS pop FROM part GROUP BY 1)
SELECT p_brand, (top // pop + CASE WHEN 2 * (top % pop) > pop OR (2 * (top % pop) = pop AND (top // pop) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS micros FROM s""")
def half_even_base(spark, d):
    p = t(spark, d, "part")
    units = (45 * (F.col("p_partkey") % 10) + 20 * (F.col("p_size") % 7) + 35 * (F.col("p_size") % 3)) * F.col("p_size")
    g = p.groupBy("p_brand").agg((F.sum(units) * 100).alias("top"), F.sum("p_size").alias("pop"))
    return g.select("p_brand", A.half_even_quotient(F.col("top"), F.col("pop")).alias("micros"))


@query("""SELECT p_brand, count(*) FILTER (WHERE p_size < 10)::BIGINT AS small, count(*) FILTER (WHERE p_type = 'ECONOMY')::BIGINT AS economy,
  round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY 1""")
def conditional_counts_quantiles(spark, d):
    p = t(spark, d, "part")
    counts = A.conditional_counts(p, ["p_brand"], {"small": F.col("p_size") < 10, "economy": F.col("p_type") == "ECONOMY"})
    prices = exact_quantiles(p, "p_retailprice", {"p50": 0.5, "p95": 0.95}, by=["p_brand"]).select(F.col("p_brand").alias("_b"), r6("p50", "p50"), r6("p95", "p95"))
    return counts.join(prices, F.expr("p_brand <=> _b")).drop("_b")


@query("""SELECT l_orderkey, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS q1, min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS q2, min(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS q3,
  min(CASE WHEN l_linenumber = 4 THEN l_quantity END) AS q4, min(CASE WHEN l_linenumber = 5 THEN l_quantity END) AS q5 FROM lineitem GROUP BY 1""")
def line_code_pivot(spark, d):
    return A.pivot_codes(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2, 3, 4, 5], F.col("l_quantity"), "q")


@query("""WITH u AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS m, sum(l_quantity) - max(l_quantity) AS rest FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, sum(m) AS served, round(sum(rest) / nullif(sum(m), 0), 6) AS overlap FROM u GROUP BY 1""")
def overlap_proxy(spark, d):
    u = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("m"), (F.sum("l_quantity") - F.max("l_quantity")).alias("rest"))
    return u.groupBy("l_suppkey").agg(F.sum("m").alias("served"), r6(F.try_divide(F.sum("rest"), F.sum("m")), "overlap"))


@query("SELECT l_suppkey, sum(m) AS total FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def max_then_sum(spark, d):
    return A.max_then_sum(t(spark, d, "lineitem"), ["l_partkey"], ["l_suppkey"], F.col("l_quantity"), "total")


@query("""SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*)::BIGINT FROM orders GROUP BY 2""")
def status_histogram(spark, d):
    return A.status_histogram(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice FROM orders),
l AS (SELECT strftime(max((month || '-01')::DATE) - INTERVAL 11 MONTH, '%Y-%m') AS first FROM m)
SELECT o_custkey, round(median(o_totalprice), 6) AS median, count(DISTINCT month)::BIGINT AS months FROM m, l WHERE month >= first GROUP BY 1""")
def trailing_12_month_metrics(spark, d):
    o = t(spark, d, "orders").withColumn("month", S.month_text(F.col("o_orderdate")))
    return A.trailing_medians(o, "o_custkey", "month", "o_totalprice").select("o_custkey", r6("median", "median"), "months")


@query("""WITH m AS (SELECT user_id % 20 AS bucket, event_type, date_trunc('day', ts) AS day, count(*) AS n, sum(value::DECIMAL(18,4)) AS v, bool_and(value IS NOT NULL AND value >= 0) AS ok FROM events GROUP BY ALL)
SELECT bucket::BIGINT AS bucket, event_type, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS n, round(1000 * sum(CASE WHEN ok THEN v END)::DOUBLE / nullif(sum(CASE WHEN ok THEN n END), 0), 4) AS rate,
  round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS coverage FROM m GROUP BY 1, 2""")
def pooled_rates(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 20).alias("bucket"), "event_type", F.date_trunc("day", "ts").alias("day"), "value")
    ok = F.coalesce(F.col("value") >= 0, F.lit(False))
    m = e.groupBy("bucket", "event_type", "day").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v"), F.bool_and(ok).alias("ok"))
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return m.groupBy("bucket", "event_type").agg(
        F.sum(F.coalesce(good("n"), F.lit(0))).alias("n"), F.round(F.try_divide(1000 * F.sum(good("v")).cast("double"), F.sum(good("n"))), 4).alias("rate"), r6(F.count_if("ok") / F.count("*"), "coverage")
    )


@query("""WITH w AS (SELECT l_orderkey, l_suppkey, l_extendedprice::DECIMAL(18,2) AS p, sum(l_extendedprice::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)
SELECT l_suppkey, round(sum(round(o_totalprice * (p::DOUBLE / s::DOUBLE), 2)::DECIMAL(18,2))::DOUBLE, 2) AS allocated FROM w JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def allocation_shares(spark, d):
    li, o = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice"), t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    a = E.allocate(li.join(o, "l_orderkey"), ["l_orderkey"], F.col("l_extendedprice"), F.col("o_totalprice"), "part")
    return a.groupBy("l_suppkey").agg(F.round(F.sum(F.col("part").cast("decimal(18,2)")).cast("double"), 2).alias("allocated"))


@query("SELECT c_nationkey, count(*)::BIGINT AS n, min(c_mktsegment) AS low, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS total, count(DISTINCT c_mktsegment)::BIGINT AS kinds FROM customer GROUP BY 1")
def group_sum_count(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_mktsegment").alias("low"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.count_distinct("c_mktsegment").alias("kinds"))


@query("SELECT l_orderkey, l_partkey, count(*)::BIGINT AS \"rows\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return C.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""SELECT count(*) FILTER (WHERE o_custkey IS NULL)::BIGINT AS left_only, count(*) FILTER (WHERE c_custkey IS NULL)::BIGINT AS right_only, count(*) FILTER (WHERE c_custkey = o_custkey)::BIGINT AS "both" FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey""")
def key_set_relations(spark, d):
    c, o = t(spark, d, "customer").where("c_acctbal > 0"), t(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return C.key_sets(c, o, ["c_custkey"])


# enrichment joins


@query("""SELECT c_custkey, coalesce(n_name, '??') AS nation, coalesce(r_name, 'Unknown') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def inherit_parent_values(spark, d):
    n = t(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    out = E.inherit(E.inherit(t(spark, d, "customer"), n, ["c_nationkey"], {"n_name": "??"}), r, ["n_regionkey"], {"r_name": "Unknown"})
    return out.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'outside_scope' WHEN k IS NOT NULL THEN 'complete' ELSE 'unmatched' END AS status
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) ON k = c_custkey""")
def attach_with_status(spark, d):
    r = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return E.attach_with_status(t(spark, d, "customer"), r, ["c_custkey"], F.col("c_mktsegment") != "MACHINERY", "status").select("c_custkey", "status")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def missing_keys(spark, d):
    big = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return E.missing_keys(t(spark, d, "part").select("p_partkey"), big, ["p_partkey"])


@query("""SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON right(s_name, 6) = right(c_name, 6)""")
def code_reconciliation(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name")
    return E.reconcile_codes(s, t(spark, d, "customer").select("c_custkey", "c_name"), F.right("s_name", F.lit(6)), F.right("c_name", F.lit(6)))[0].select("s_suppkey", "c_custkey")


@query("""SELECT s_suppkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'unmatched' ELSE 'matched' END AS status
FROM supplier LEFT JOIN customer ON right(s_name, 6) = right(c_name, 6)""")
def code_reconciliation_status(spark, d):
    s, c = t(spark, d, "supplier").select("s_suppkey", "s_name"), t(spark, d, "customer").select("c_custkey", "c_name")
    matched, gone = E.reconcile_codes(s, c, F.right("s_name", F.lit(6)), F.right("c_name", F.lit(6)))
    gone = gone.select("s_suppkey", F.lit(None).cast("bigint").alias("c_custkey"), F.lit("unmatched").alias("status"))
    return matched.select("s_suppkey", "c_custkey", F.lit("matched").alias("status")).unionByName(gone)


@query("""WITH local AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1),
wide AS (SELECT n_regionkey AS k, round(avg(c_acctbal), 6) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT s_suppkey, round(coalesce(local.v, wide.v), 4) AS value, CASE WHEN local.v IS NOT NULL THEN 'local' WHEN wide.v IS NOT NULL THEN 'wider' END AS source
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN local ON local.k = s_nationkey LEFT JOIN wide ON wide.k = n_regionkey""")
def msa_or_fallback(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    local = c.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.avg("c_acctbal"), 6).alias("local_v"))
    wide = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.round(F.avg("c_acctbal"), 6).alias("wide_v"))
    j = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(local, "s_nationkey", "left").join(wide, "n_regionkey", "left")
    return E.first_known(j, "value", "source", [("local", F.col("local_v")), ("wider", F.col("wide_v"))]).select("s_suppkey", F.round("value", 4).alias("value"), "source")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def first_by_key(spark, d):
    return E.first_by(t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_id")


# sets, contracts, pages, scalars


@query("""(SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity < 10 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 42)
UNION ALL (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 42 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity < 10)""")
def multiset_diff(spark, d):
    li = t(spark, d, "lineitem")
    return C.multiset_difference(*[li.where(c).select("l_returnflag", "l_linestatus") for c in ("l_quantity < 10", "l_quantity > 42")])


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice <= 300000 AND o_orderpriority ILIKE '%ur%'
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20""")
def list_places_page(spark, d):
    s = Store(t(spark, d, "orders"), "o_orderkey", "o_orderpriority", {"price": "o_totalprice"})
    return s.list(Page("price", equal={"o_orderstatus": "F"}, bounds={"o_totalprice": (1000, 300000)}, query="ur", limit=50, offset=20)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-31' AND (l_returnflag = 'N' OR l_shipdate + INTERVAL 30 DAY >= TIMESTAMP '1998-01-01')")
def violation_overlap(spark, d):
    end = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("interval 30 days"))
    inside = S.overlaps(F.col("l_shipdate"), end, F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))
    return t(spark, d, "lineitem").where(inside).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, round(CASE WHEN v <= 950 THEN 0 WHEN v >= 1800 THEN 1 WHEN v <= 1100 THEN (v - 950) * 0.4 / 150 WHEN v <= 1500 THEN 0.4 + (v - 1100) * 0.5 / 400 ELSE 0.9 + (v - 1500) * 0.1 / 300 END, 6) AS u FROM (SELECT p_partkey, p_retailprice AS v FROM part)""")
def knot_utility(spark, d):
    return t(spark, d, "part").select("p_partkey", r6(S.knot_utility(F.col("p_retailprice"), [(950, 0), (1100, 0.4), (1500, 0.9), (1800, 1)]), "u"))


@query("SELECT c_custkey, least(4, greatest(0, floor((round(c_acctbal, 1) - 0) / 2000)))::INT AS class FROM customer")
def layer_class_bins(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.class_bin(F.round("c_acctbal", 1), 2000, 0, 5).alias("class"))


@query("SELECT n_nationkey, sha256(to_json([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR])) AS digest FROM nation")
def row_digest(spark, d):
    return t(spark, d, "nation").select("n_nationkey", C.row_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("digest"))


@query("SELECT * EXCLUDE (c_name), upper(trim(c_name)) AS label FROM customer")
def export_projection(spark, d):
    return t(spark, d, "customer").withColumn("label", F.upper(F.trim("c_name"))).drop("c_name")


@query("""SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) >= 5 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS code, regexp_matches(code, '^\\d{5}$') AS ok FROM customer""")
def padded_codes(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.zfill(F.col("c_custkey").cast("string"), 5).alias("code")).withColumn("ok", F.regexp_like("code", F.lit(r"^\d{5}$")))


@query("""SELECT o_orderkey, last_day(o_orderdate::DATE) + 62 < DATE '1998-06-30' AS stale, (coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0) + 1) AS padded FROM orders""")
def staleness_and_null_sums(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", S.stale(S.month_text(F.col("o_orderdate")), F.lit("1998-06-30").cast("date")).alias("stale"), S.sum_ignoring_nulls([F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.lit(1.0)]).alias("padded"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, d):
    return windowed_counts(t(spark, d, "events"), "ts", "event_type", "value")


# preference evaluation

_FIT_CANDIDATES = """WITH spend AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend, count(*) AS months FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_nationkey, c_mktsegment, months, round(c_acctbal / 10000, 6) AS a, round(least(1.0, spend / 5000000), 6) AS b, round(CASE WHEN c_nationkey <> 3 THEN c_nationkey / 25.0 END, 6) AS g FROM customer LEFT JOIN spend ON o_custkey = c_custkey),
a AS (SELECT *, round(a * 0.5 + b * 0.3 + g * 0.2, 9) AS score, CASE WHEN a IS NULL OR b IS NULL OR g IS NULL THEN 'missing_core' WHEN a < 0 THEN 'population' END AS stage_a FROM c),
r AS (SELECT *, coalesce(stage_a, CASE WHEN months < 5 THEN 'valid_months' WHEN c_nationkey NOT IN (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12) THEN 'state_filter' WHEN c_mktsegment = 'MACHINERY' THEN 'state_exclusion' WHEN b < 0.3 THEN 'min_b' END) AS reason FROM a)"""
_FIT = _FIT_CANDIDATES + """ SELECT c_custkey, score, reason, CASE WHEN stage_a IS NULL THEN rank() OVER (PARTITION BY stage_a IS NULL ORDER BY score DESC NULLS LAST) END::BIGINT AS national_rank,
  CASE WHEN reason IS NULL THEN rank() OVER (PARTITION BY reason IS NULL ORDER BY score DESC NULLS LAST) END::BIGINT AS filtered_rank FROM r"""


def _fit(spark: SparkSession, d: str) -> DataFrame:
    spend = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"), F.count("*").alias("months"))
    c = t(spark, d, "customer").join(spend, "c_custkey", "left")
    # ranks follow from these, so they are rounded as in SQL, to the last bit
    u = {"a": F.col("c_acctbal") / 10000, "b": F.least(F.lit(1.0), F.col("spend") / 5000000), "g": F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") / 25.0)}
    c = c.select("c_custkey", "c_nationkey", "c_mktsegment", "months", *[S.half_away(v, 6).alias(n) for n, v in u.items()])
    return P.evaluate(
        c, "c_custkey", {"a": 0.5, "b": 0.3, "g": 0.2}, [("population", F.col("a") < 0)], [("valid_months", F.col("months") < 5)],
        [("state_filter", ~F.col("c_nationkey").isin(1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12)), ("state_exclusion", F.col("c_mktsegment") == "MACHINERY"), ("min_b", F.col("b") < 0.3)],
    )


@query(_FIT)
def preference_fit(spark, d):
    return _fit(spark, d).select("c_custkey", "score", "reason", "national_rank", "filtered_rank")


@query(_FIT_CANDIDATES + " SELECT coalesce(reason, 'eligible') AS reason, count(*)::BIGINT AS n FROM r GROUP BY 1")
def exclusion_counts(spark, d):
    return _fit(spark, d).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


# rasters


#: Grids of 24 x 24 cells of 1 km from the line items: a tile for each supplier number mod 4.
_CELLS = """WITH c AS (SELECT (l_suppkey % 4)::BIGINT AS tile, (l_partkey % 24)::INT AS r, (l_orderkey % 24)::INT AS c, min(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT t.i AS tile, a.i AS r, b.i AS c, coalesce(v, 0) % 900 AS e, coalesce(q, 0) % 5 AS land, coalesce(q, 0) % 3 / 10 AS trail FROM range(4) t(i), range(24) a(i), range(24) b(i) LEFT JOIN c ON c.tile = t.i AND c.r = a.i AND c.c = b.i)"""


def _tiles(spark, d):
    n = 24
    li = t(spark, d, "lineitem")
    cells = li.groupBy((F.col("l_suppkey") % 4).alias("tile"), (F.col("l_partkey") % n).alias("r"), (F.col("l_orderkey") % n).alias("c")).agg(F.min("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    grid = spark.range(4 * n * n).select(F.expr(f"id div {n * n}").alias("tile"), F.expr(f"(id div {n}) % {n}").alias("r"), F.expr(f"id % {n}").alias("c"))
    g = grid.join(cells, ["tile", "r", "c"], "left").withColumns({"v": F.coalesce("v", F.lit(0.0)), "q": F.coalesce("q", F.lit(0.0))})
    rows = F.sort_array(F.collect_list(F.struct("r", "c", (F.col("v") % 900).alias("e"), (F.col("q") % 5).alias("land"), (F.col("q") % 3 / 10).alias("trail"))))
    return g.groupBy("tile").agg(rows.alias("x")).select("tile", F.lit(n).alias("rows"), F.lit(n).alias("cols"), F.col("x.e").alias("elevation"), F.col("x.land").alias("access"), F.col("x.trail").alias("trails"))


@query(_CELLS + """, near AS (SELECT a.tile, a.r, a.c, max(b.e) FILTER (WHERE abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4) - min(b.e) FILTER (WHERE abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4) AS relief5, max(b.e) FILTER (WHERE abs(a.r - b.r) <= 8 AND abs(a.c - b.c) <= 8) - min(b.e) FILTER (WHERE abs(a.r - b.r) <= 8 AND abs(a.c - b.c) <= 8) AS relief10
  FROM g a JOIN g b ON a.tile = b.tile GROUP BY 1, 2, 3),
slope AS (SELECT a.tile, a.r, a.c, degrees(atan(sqrt(pow((d.e - u.e) / (1000 * (d.r - u.r)), 2) + pow((k.e - l.e) / (1000 * (k.c - l.c)), 2)))) AS slope FROM g a
  JOIN g u ON u.tile = a.tile AND u.c = a.c AND u.r = greatest(a.r - 1, 0) JOIN g d ON d.tile = a.tile AND d.c = a.c AND d.r = least(a.r + 1, 23)
  JOIN g l ON l.tile = a.tile AND l.r = a.r AND l.c = greatest(a.c - 1, 0) JOIN g k ON k.tile = a.tile AND k.r = a.r AND k.c = least(a.c + 1, 23)),
m AS (SELECT g.*, relief5, relief10, slope, slope >= 15 OR relief5 >= 300 AS mountain FROM g JOIN near USING (tile, r, c) JOIN slope USING (tile, r, c)),
w AS (SELECT a.tile, a.r, a.c, avg(b.mountain::INT) FILTER (WHERE far <= 17) AS rugged, count(*) FILTER (WHERE far <= 4 AND b.mountain AND b.land = 1) AS o5, count(*) FILTER (WHERE far <= 13 AND b.mountain AND b.land = 1) AS o15, count(*) FILTER (WHERE far <= 26 AND b.mountain AND b.land = 1) AS o30,
    count(*) FILTER (WHERE far <= 26 AND b.mountain AND b.land = 2) AS restricted, coalesce(sum(b.trail) FILTER (WHERE far <= 8 AND b.mountain), 0) AS t10, coalesce(sum(b.trail) FILTER (WHERE far <= 22 AND b.mountain), 0) AS t25, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) FILTER (WHERE b.mountain AND b.trail > 0) AS nearest
  FROM m a JOIN (SELECT * FROM m) b ON a.tile = b.tile, LATERAL (SELECT greatest(abs(a.r - b.r), abs(a.c - b.c)) AS far) GROUP BY 1, 2, 3)
SELECT s_suppkey AS block, round(relief5, 6) AS relief_5km, round(relief10, 6) AS relief_10km, round(slope, 6) AS slope, mountain::INT::DOUBLE AS mountain, round(rugged, 6) AS rugged, o5::DOUBLE AS open_5, (o15 - o5)::DOUBLE AS open_15, (o30 - o15)::DOUBLE AS open_30, restricted::DOUBLE AS restricted_30,
  round(o5 + 0.75 * (o15 - o5) + 0.4 * (o30 - o15), 6)::DOUBLE AS access_raw, round(nearest, 6) AS nearest_trail_km, round(t10, 6) AS trail_10, round(t25, 6) AS trail_25, round(t10 + 0.4 * (t25 - t10), 6) AS trail_raw
FROM supplier JOIN m ON tile = s_suppkey % 4 AND r = s_suppkey * 7 % 24 AND c = s_suppkey * 13 % 24 JOIN w USING (tile, r, c)""")
def terrain_windows(spark, d):
    """Terrain, access and trail rings of tiles made of line items, sampled at one block for each supplier."""
    k = F.col("s_suppkey")
    blocks = t(spark, d, "supplier").select((k % 4).alias("tile"), k.alias("block"), (k * 7 % 24).cast("int").alias("row"), (k * 13 % 24).cast("int").alias("col"), F.lit(1).alias("people"))
    shown = ("relief_5km", "relief_10km", "slope", "mountain", "rugged", "open_5", "open_15", "open_30", "restricted_30", "access_raw", "nearest_trail_km", "trail_10", "trail_25", "trail_raw")
    return G.sample_tiles(_tiles(spark, d), blocks, 1000.0).select("block", *[r6(o, o) for o in shown])


@query("""SELECT c_nationkey, count(*)::BIGINT AS n, sha256(count(*) || ',' || sum(('0x' || i[1:16])::UBIGINT)::VARCHAR || ',' || sum(('0x' || i[17:32])::UBIGINT)::VARCHAR || ',' || sum(('0x' || i[33:48])::UBIGINT)::VARCHAR || ',' || sum(('0x' || i[49:64])::UBIGINT)::VARCHAR) AS ids_sha256, sha256(count(*) || ',' || sum(('0x' || s[1:16])::UBIGINT)::VARCHAR || ',' || sum(('0x' || s[17:32])::UBIGINT)::VARCHAR || ',' || sum(('0x' || s[33:48])::UBIGINT)::VARCHAR || ',' || sum(('0x' || s[49:64])::UBIGINT)::VARCHAR) AS samples_sha256
FROM (SELECT c_nationkey, sha256(c_custkey::VARCHAR) AS i, sha256(c_custkey::VARCHAR || '|' || c_mktsegment) AS s FROM customer) GROUP BY 1""")
def tile_digests(spark, d):
    return G.tile_digests(t(spark, d, "customer"), ["c_nationkey"], "c_custkey", ["c_mktsegment"])


@query("SELECT floor(c_acctbal / 1000)::INT AS tile_col, floor(c_nationkey / 5)::INT AS tile_row, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2")
def tile_inventory(spark, d):
    x, y = G.tile_of(F.col("c_acctbal"), F.col("c_nationkey") * 200.0, 1000.0)
    return t(spark, d, "customer").groupBy(x.alias("tile_col"), y.alias("tile_row")).agg(F.count("*").alias("n"))

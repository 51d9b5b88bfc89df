"""Domain rules on small literal frames: hazards, blocks, preference, counties, rasters, names, addresses."""

import functools
import itertools
import math
import operator

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import addresses as X
from quernstone.operators import contracts as K
from quernstone.operators import county as C
from quernstone.operators import domain as D
from quernstone.operators import places as Z
from quernstone.operators import preference as P
from quernstone.operators import ranks as R
from quernstone.operators import raster as G
from quernstone.operators import scores as H
from quernstone.operators import spatial as L
from quernstone.operators import rasterise as RZ
from quernstone.plans import domain_catalog  # noqa: F401
from quernstone.plans.catalog import QUERIES, SQL

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("raw", "rating", "state", "kept"),
    [
        (2.5, "Relatively High", "valid", 2.5), (0.0, "Very Low", "valid", 0.0), (-1.0, "Very High", "invalid", None), (None, "Very Low", "invalid", None), (NAN, None, "invalid", None), (NAN, "Very High", "invalid", None),
        (INF, "Very High", "invalid", None), (0.0, H.NO_LOSS, "valid", 0.0), (3.0, H.NO_LOSS, "invalid", None), (None, H.NO_LOSS, "invalid", None), (None, H.NOT_APPLICABLE, "not_applicable", None), (7.0, H.NOT_APPLICABLE, "invalid", 7.0),
        (NAN, H.NOT_APPLICABLE, "invalid", None), (None, H.NO_DATA, "missing", None), (0.0, H.NO_DATA, "invalid", 0.0), (None, None, "missing", None), (4.0, None, "valid", 4.0), (-4.0, None, "invalid", -4.0), (1.0, "odd", "invalid", None), (None, "odd", "invalid", None),
    ],
)
def test_availability(spark, raw, rating, state, kept):
    r = spark.createDataFrame([(raw, rating)], "raw double, rating string").select(H.availability(F.col("raw"), F.col("rating")), H.normalised_raw(F.col("raw"), F.col("rating"))).first()
    assert tuple(r) == (state, kept)


def brute_ensemble(table):
    """Mid-ranks and aggregates in plain Python; ``table``: key to {hazard: (raw, state)}."""

    def percentiles(values, zero=False):
        n = len(values)
        return {k: 0.0 if n == 1 or (zero and v == 0) else 100 * (sum(x < v for x in values.values()) + (sum(x == v for x in values.values()) - 1) / 2) / (n - 1) for k, v in values.items()}

    hazards = sorted({h for row in table.values() for h in row})
    lists = {k: [] for k in table}
    for h in hazards:
        got = percentiles({k: row[h][0] for k, row in table.items() if row[h][1] == "valid"}, True)
        for k, row in table.items():
            if row[h][1] == "not_applicable":
                lists[k].append(0.0)
            elif k in got:
                lists[k].append(got[k])
    three = []
    for f in (lambda v: sum(x * math.exp(-0.45 * i) for i, x in enumerate(v)) / sum(math.exp(-0.45 * i) for i in range(len(v))), lambda v: sum(v[: max(1, math.ceil(len(v) / 4))]) / max(1, math.ceil(len(v) / 4)), lambda v: 100 * (sum((x / 100) ** 4 for x in v) / len(v)) ** 0.25):
        three.append(percentiles({k: round(f(sorted(v, reverse=True)), 9) for k, v in lists.items() if v}))
    middle = {k: round(sorted(t[k] for t in three)[1], 9) for k in three[0]}
    final = percentiles(middle)
    return {k: (final.get(k), max(t[k] for t in three) - min(t[k] for t in three) if k in final else None, len(v)) for k, v in lists.items()}


def test_ensemble_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    table = {k: {h: ((float(rng.integers(0, 6)), "valid") if (s := rng.integers(0, 5)) > 1 else (None, "not_applicable" if s else "missing")) for h in "abcde"} for k in range(40)}
    table[40] = {h: (None, "missing") for h in "abcde"}
    rows = [(k, h, *v) for k, row in table.items() for h, v in row.items()]
    got = {r.k: r for r in H.ensemble(spark.createDataFrame(rows, "k long, hazard string, raw double, state string"), "k", 5).collect()}
    for k, (score, spread, n) in brute_ensemble(table).items():
        assert got[k].available == n and got[k].coverage == n / 5 and got[k].quality == ("complete" if n == 5 else "partial" if n else "unavailable")
        assert got[k].score is None if score is None else got[k].score == pytest.approx(score)
        assert got[k].spread is None if spread is None else got[k].spread == pytest.approx(spread)


def test_ranks_within_hot_groups(spark):
    """A third of the rows in one group, nulls in the group column, values in few buckets."""
    rng = np.random.default_rng(2)
    rows = [(["hot", "a", None][int(g)], float(v)) for g, v in zip(rng.choice(3, 900, p=[0.6, 0.3, 0.1]), rng.integers(0, 50, 900) ** 3, strict=True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, g string, v double")
    for buckets in (64, 3):
        d = df.groupBy("g", "v").agg(F.count("*").alias("n"))
        got = {(r.g, r.v): (r.le, r.le_all) for r in R.running_sums(d, "v", {"le": "n"}, ["g"], buckets).collect()}
        assert got == {(g, v): (sum(y <= v for x, y in rows if x == g), sum(x == g for x, _ in rows)) for g, v in set(rows)}
    rank = {r.k: r.p for r in R.competition_rank(df, "v", "p", ["g"]).collect()}
    assert all(rank[k] == 1 + sum(x == g and y > v for x, y in rows) for k, (g, v) in enumerate(rows))


def test_ecdf_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame(list(enumerate([1.0, NAN, 3.0, INF, None, 2.0])), "k int, v double")
    assert [r.u for r in R.ecdf(df, "v", "u").orderBy("k").collect()] == [0.0, None, 1.0, None, None, 0.5]


def test_pareto_where_all_are_in_front(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rows = [(k, float(k), float(-k), float(k % 2)) for k in range(300)] + [(1000 + k, float(k) - 0.5, float(-k) - 0.5, 0.0) for k in range(60)]
    got = {r.k: r.pareto for r in R.pareto_flags(spark.createDataFrame(rows, "k int, a double, b double, c double"), "k", ["a", "b", "c"]).collect()}
    assert got == {k: k < 1000 for k, *_ in rows}
    same = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0), (3, 2.0, 1.0), (4, None, 9.0)], "k int, a double, b double")
    assert {r.k: r.pareto for r in R.pareto_flags(same, "k", ["a", "b"]).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_block_areas(spark):
    """Areas below the floor, without people or out of scope have no base and are no peers."""
    rows = [("a", 1, 100, 1000, "x"), ("b", 2, 95, 2000, "x"), ("b", 3, 5, None, "x"), ("c", 4, 89, 3000, "x"), ("c", 5, 11, None, "x"), ("d", 6, 0, 4000, "x"), ("p", 7, 100, 5000, "PR")]
    df = spark.createDataFrame([(a, k, w, None if u is None else u * 100, u / 100 if u else None, s) for a, k, w, u, s in rows], "area string, block int, pop long, units long, m double, state string")
    got = {r.area: (r.status, r.base_micros, r.magnitude, r.m) for r in D.aggregate_blocks(df, ["area"], "pop", F.col("state") != "PR", {"m": 2}).collect()}
    # of two peers the larger base is alone at the top
    assert got == {"a": ("complete", 10_000_000, 0.0, 10.0), "b": ("partial", 20_000_000, 0.301, 20.0), "c": ("insufficient_coverage", None, None, None), "d": ("zero_population", None, None, None), "p": ("outside_scope", None, None, None)}


def test_block_scores_and_gate(spark):
    df = spark.createDataFrame([(1, "s", 10, -1e-10, 3.0), (2, "s", 30, 5.0, 1.0), (3, "t", 60, 7.0, None), (4, "t", 0, 9.0, 9.0)], "k int, state string, pop long, a double, b double")
    got = D.block_scores(df, "k", "pop", {"a": 0.5, "b": 0.5}, F.lit(True)).orderBy("k").collect()
    assert [(r.a_pct, r.b_pct, r.composite) for r in got] == [(0.0, 75.0, 37.5), (10.0, 0.0, 5.0), (40.0, None, None), (100.0, 100.0, 100.0)]
    scored = df.join(D.block_scores(df, "k", "pop", {"a": 0.5, "b": 0.5}, F.lit(True)).select("k", "composite"), "k")
    with pytest.raises(K.ContractError, match="below"):
        D.gate_coverage(scored, "state", "pop", "composite", F.lit(True))
    assert D.gate_coverage(scored.where("state = 's'"), "state", "pop", "composite", F.lit(True)).count() == 2
    with pytest.raises(K.ContractError, match="invalid a"):
        K.assert_none(df.withColumn("a", F.lit(NAN)), D.block_problems(["a", "b"]))


# preference


def place(key, **over):
    row = {"place_id": key, "name": key, "state": "CO", "population": 60_000, "housing_valid_months": 12, "median_active_listings": 200.0, "crime_coverage": 0.95, **{f"u_{p}": 0.5 for p in P.PILLARS}, "jan_avg_temp_f": 30.0, "jul_avg_temp_f": 70.0, "extreme_heat_days": 4.0, "extreme_cold_days": 6.0}
    return row | over


SCHEMA = "place_id string, name string, state string, population long, housing_valid_months int, median_active_listings double, crime_coverage double, " + ", ".join(f"u_{p} double" for p in P.PILLARS) + ", jan_avg_temp_f double, jul_avg_temp_f double, extreme_heat_days double, extreme_cold_days double"


def places(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def brute_preference(rows, o):
    """The rules row by row."""
    view, weights = P.view_weights(o)
    listings, months = (100 if o.min_active_listings is None else o.min_active_listings, 9 if o.min_valid_months is None else o.min_valid_months) if view == "custom" else (o.min_active_listings, o.min_valid_months)
    reason, active = {}, {}
    for r in rows:
        k, u = r["place_id"], {p: r[f"u_{p}"] for p in P.PILLARS}
        if view == "custom":
            why = "missing_core" if None in u.values() else "crime_coverage" if r["crime_coverage"] is None or r["crime_coverage"] < 0.9 else None
            value = None if why else functools.reduce(operator.add, [u[p] * weights[p] for p in P.PILLARS])  # in order: sum() compensates
        else:
            why, value = (None, u[view]) if u[view] is not None else ("missing_active", None)
        if why is None and (r["population"] is None or r["population"] < 25_000):
            why, value = "population", None
        reason[k], active[k] = why, value
    national = {k: 1 + sum(w is not None and w > v for w in active.values()) for k, v in active.items() if v is not None}
    for r in rows:
        k = r["place_id"]
        if reason[k]:
            continue
        short = lambda v, least: least is not None and (v is None or v < least)
        bounds = [(n, m, low, o.climate[n]) for n, (m, low) in P.CLIMATE.items() if o.climate.get(n) is not None]
        tests = [("valid_months", short(r["housing_valid_months"], months)), ("active_listings", short(r["median_active_listings"], listings)), ("population", short(r["population"], o.min_population)), ("state_filter", bool(o.include_states) and r["state"] not in o.include_states), ("state_exclusion", r["state"] in o.exclude_states),
                 ("region_exclusion", o.exclude_region is not None and k in o.regions[o.exclude_region]), ("climate", any(r[m] is None or (r[m] < b if low else r[m] > b) for _, m, low, b in bounds))]
        tests += [(f"min_{p}", r[f"u_{p}"] is None or r[f"u_{p}"] < o.min_pillars[p]) for p in P.PILLARS if p in o.min_pillars]
        reason[k] = next((n for n, bad in tests if bad), None)
    left = {k: active[k] for k in reason if reason[k] is None}
    filtered = {k: 1 + sum(w > v for w in left.values()) for k, v in left.items()}
    vectors = {r["place_id"]: [r[f"u_{p}"] for p in P.PILLARS] for r in rows}
    best = {k: not any(all(a >= b for a, b in zip(vectors[q], vectors[k], strict=True)) and vectors[q] != vectors[k] for q in left) for k in left} if view == "custom" else {}
    return {k: (reason[k], national.get(k), filtered.get(k), best.get(k)) for k in reason}


@pytest.mark.parametrize("view", ["custom", "Custom-Fit", "safety", "family-autonomy"])
def test_preference_equals_brute_force(spark, view):
    rng = np.random.default_rng(7)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [place(f"{k:05d}", state=pick("CO", "UT", "AL"), population=pick(None, 24_999, 25_000, 60_000, 90_000), housing_valid_months=pick(None, 8, 9, 12), median_active_listings=pick(None, 99.0, 100.0, 300.0), crime_coverage=pick(None, 0.899, 0.9, 1.0, 1.0), jan_avg_temp_f=pick(None, 10.0, 20.0, 30.0), extreme_heat_days=pick(3.0, 9.0),
                  **{f"u_{p}": pick(None, *([0.1, 0.5, 0.5, 0.9] * 4)) for p in P.PILLARS}) for k in range(160)]
    for o in (P.Options(view), P.Options(view, min_population=60_000, min_valid_months=9, min_active_listings=100, exclude_states=("AL",), exclude_region="x", climate={"min_jan_temp_f": 20.0, "max_extreme_heat_days": 8.0}, min_pillars={"family": 0.5, "health": 0.5}, regions={"x": ["00003", "00010"]}), P.Options(view, include_states=("UT",))):
        got = {r.place_id: (r.reason, r.national_rank, r.filtered_rank, r.pareto_optimal) for r in P.evaluate_places(places(spark, *rows), o).collect()}
        assert got == brute_preference(rows, o)


def test_preference_options(spark):
    full = dict.fromkeys(P.PILLARS, 0.0)
    P.view_weights(P.Options(weights=full | {"safety": 1.000000000001}))
    bad = [
        P.Options(weights=full | {"safety": 1.0000000000011}), P.Options(weights={"safety": 1.0}), P.Options(weights=full | {"safety": None}), P.Options(weights=full | {"safety": 2.0, "health": -1.0}), P.Options(preset="none"), P.Options("none"), P.Options("safety", weights=full | {"safety": 1.0}),
        P.Options(min_population=24_999), P.Options(min_valid_months=0), P.Options(min_valid_months=13), P.Options(min_active_listings=-1), P.Options(exclude_region="none"), P.Options(include_states=("CO",), exclude_states=("co ",)), P.Options(include_states=("XX",), states=("CO",)),
        P.Options(climate={"min_jan_temp_f": 50, "max_jan_temp_f": 40}), P.Options(climate={"max_extreme_heat_days": -1}), P.Options(climate={"max_jul_temp_f": INF}), P.Options(min_pillars={"safety": 1.1}), P.Options(min_pillars={"other": 0.1}), P.Options(limit=0), P.Options(limit=501),
    ]
    for o in bad:
        with pytest.raises(P.OptionError):
            P.evaluate_places(places(spark, place("1")), o)
    with pytest.raises(P.OptionError):
        P.ranked_places(places(spark, place("1")), limit=0)
    rows = [place(f"{k}") for k in range(6)] + [place("9", population=1)]
    got = P.evaluate_places(places(spark, *rows), P.Options(limit=2)).collect()
    assert sorted((r.place_id, r.filtered_rank) for r in got) == [("0", 1), ("1", 1), ("9", None)]
    counts = P.evaluation_counts(P.evaluate_places(places(spark, *rows, place("7", state="UT")), P.Options(exclude_states=("UT",)))).first()
    assert tuple(counts)[:4] == (8, 7, 7, 6) and counts.exclusions == {"population": 1, "state_exclusion": 1}


# counties


def test_crime(spark):
    months = lambda ori, county, family, year, off, pop, part, skip=(): [(ori, county, family, year, m, float(off), float(pop), float(part)) for m in range(1, 13) if m not in skip]
    rows = [*itertools.chain.from_iterable(months("A", "01001", f, y, 5, 1200, 1200) for f in C.FAMILIES for y in (2023, 2024))]
    rows += [*itertools.chain.from_iterable(months("B", "01003", f, y, 10, 1200, 1200, (3,) if f == "violent-crime" and y == 2024 else ()) for f in C.FAMILIES for y in (2023, 2024))]
    rows += [*itertools.chain.from_iterable(months("C", "01005", f, y, 1, 1000, 890) for f in C.FAMILIES for y in (2023, 2024))]
    rows += [*itertools.chain.from_iterable(months("D", "01007", f, y, 2, 1000, 1000) for f in C.FAMILIES for y in (2023, 2024))]
    rows = [(*r[:7], 0.0) if r[0] == "D" and r[4] == 6 else r for r in rows]  # a month with offences and nobody participating
    df = spark.createDataFrame(rows, "ori string, county_fips string, family string, year int, month int, offenses double, population double, participated double")
    got = {r.county_fips: r for r in C.crime(df, (2023, 2024)).collect()}
    assert got["01001"].crime_violent_rate == pytest.approx(5 * 24 / (1200 * 24 / 12) * 1e5) and got["01001"].crime_coverage == 1.0 and got["01001"].crime_status == "complete"
    assert got["01003"].crime_violent_coverage_2024 is None and got["01003"].crime_property_rate is None and got["01003"].u_crime is None
    assert got["01005"].crime_violent_coverage_2023 == pytest.approx(0.89) and got["01005"].crime_coverage is None
    assert got["01007"].crime_violent_coverage_2023 == pytest.approx(11 / 12) and got["01007"].crime_violent_rate == pytest.approx(2 / 1000 * 12e5) and (got["01001"].u_crime, got["01007"].u_crime) == (0.0, 1.0)
    for bad in ({"participated": 2000.0}, {"offenses": -1.0}):
        with pytest.raises(K.ContractError):
            C.crime(df.withColumns({k: F.lit(v) for k, v in bad.items()}), (2023, 2024))


def test_water_classes_and_dates(spark):
    fields = "PWSID string, PRIMACY_AGENCY_CODE string, PWS_ACTIVITY_CODE string, PWS_TYPE_CODE string, POPULATION_SERVED_COUNT string, IS_WHOLESALER_IND string, SUBMISSION_STATUS_CODE string"
    rows = [("N1", "AL", "A", "CWS", "10", "N", "Y"), ("Y1", "AL", "A", "CWS", "10", "Y", "Y"), ("Y2", "AL", "A", "CWS", "10", "Y", "Y"), ("Y3", "AL", "A", "CWS", "10", "Y", "Y"), ("Q1", "AL", "A", "CWS", "10", None, "Y"), ("I1", "AL", "I", "CWS", "10", "N", "Y"), ("T1", "AL", "A", "TNC", "10", "N", "Y"), ("Z1", "AL", "A", "CWS", "0", "N", "Y"), ("N1", "AL", "A", "CWS", "10", "N", "Y")]
    service = spark.createDataFrame([("Y1", "WH"), ("Y2", "WH"), ("Y2", "RA"), ("N1", "WH")], "PWSID string, SERVICE_AREA_TYPE_CODE string")
    got = {r.PWSID: r["class"] for r in C.water_systems(spark.createDataFrame(rows, fields), service).collect()}
    assert got == {"N1": "retail", "Y2": "retail", "Y3": "unknown", "Q1": "unknown"}
    v = [("in", "1", "06/01/2025", "07/01/2025", "Y"), ("open", "1", "06/01/2020", None, "Y"), ("blank", "1", "06/01/2020", "", "Y"), ("before", "1", "06/01/2020", "12/31/2024", "Y"), ("edge", "1", "06/01/2020", "01/01/2025", "Y"), ("after", "1", "01/01/2026", None, "Y"), ("other", "1", "06/01/2025", None, "N"), ("odd", "1", "06/01/2025", "soon", "Y")]
    df = spark.createDataFrame(v, "PWSID string, VIOLATION_ID string, NON_COMPL_PER_BEGIN_DATE string, NON_COMPL_PER_END_DATE string, IS_HEALTH_BASED_IND string")
    assert {r.PWSID for r in C.violating_systems(df, "2025-01-01", "2025-12-31").collect()} == {"in", "open", "blank", "edge"}
    with pytest.raises(K.ContractError):
        C.violating_systems(df.unionByName(df.limit(1).withColumn("NON_COMPL_PER_END_DATE", F.lit("08/01/2025"))), "2025-01-01", "2025-12-31")
    kinds = spark.createDataFrame([("a; b ;", "Modeled"), ("b", "System Sourced")], "PWSID string, Symbology_Field string")
    assert {r.PWSID: r.provenance for r in C.boundary_provenance(kinds).collect()} == {"a": "modeled", "b": "mixed"}
    with pytest.raises(K.ContractError):
        C.boundary_provenance(kinds.withColumn("Symbology_Field", F.lit("else")))


def test_small_stages(spark):
    jobs = spark.createDataFrame([("County", "0", "10", "A", "1", "3", "100", "900"), ("County", "5", "10", "A", "1", "3", "7", "7"), ("MSA", "0", "10", "A", "1", "9", "1", "1"), ("County", "0", "10", "A", "2", "13", "x", "1")], "`Area Type` string, Own string, NAICS string, Qtr string, St string, Cnty string, `Annual Average Employment` string, `Annual Average Weekly Wage` string")
    assert sorted(map(tuple, C.annual_jobs(jobs).collect())) == [("01003", 100.0, 900.0), ("02013", None, 1.0)]
    p = C.providers(spark.createDataFrame([("1003", "20", "10")], "fips string, primary_care string, dental string"), spark.createDataFrame([("01003", "NA")], "fips string, mental_health string"))
    r = C.provider_rates(p.withColumn("population", F.lit(50_000))).first()
    assert (r.provider_primary_care, r.provider_mental_health, r.provider_dental) == (40.0, None, 20.0)
    normals = spark.createDataFrame([("s", 1.0, 2.0, 3.0, 4.0), ("s", 1.0, 2.0, 3.0, 4.0), ("t", 1.0, 2.0, None, 4.0)], "station string, latitude double, longitude double, heat double, cold double")
    monthly = spark.createDataFrame([("s", "01", 10.0), ("s", "07", 70.0), ("s", "02", 1.0), ("t", "01", 1.0)], "station string, month string, normal double")
    assert [(r.station, r.jan_avg_temp_f, r.jul_avg_temp_f) for r in C.stations(normals, monthly).collect()] == [("s", 10.0, 70.0)]
    with pytest.raises(K.ContractError):
        C.stations(normals, monthly.unionByName(spark.createDataFrame([("s", "01", 11.0)], monthly.schema)))


def test_price_levels_are_checked(spark):
    rows = [(g, n, "MARPP", "Index", k, 100.0 + k) for g, n in (('"10180"', "Abilene, TX (MSA) *"), (" 00999", "Nonmetro"), ("00000", "US")) for k in (1, 2)] + [("x", "other", "else", "?", 9, None)]
    table = spark.createDataFrame(rows, "GeoFIPS string, GeoName string, TableName string, Unit string, LineCode int, `2024` double")
    lines = {1: "a", 2: "b"}
    assert sorted(map(tuple, Z.price_levels(table, "2024", lines, "00999").collect())) == [("00999", "Nonmetro", 101.0, 102.0), ("10180", "Abilene, TX (MSA)", 101.0, 102.0)]
    bad = {"LineCode": F.lit(1), "2024": F.lit(-1.0), "Unit": F.lit("$"), "GeoName": F.lit(" "), "GeoFIPS": F.lit("1018")}
    for c, v in bad.items():
        with pytest.raises(K.ContractError):
            Z.price_levels(table.withColumn(c, F.when(F.col("GeoFIPS").contains("10180"), v).otherwise(F.col(f"`{c}`"))), "2024", lines, "00999")
    with pytest.raises(K.ContractError):
        Z.price_levels(table, "2024", lines, "99999")


def finished(spark):
    rows = [(f"0100{k}", 1000 * k, float(k), *[0.95] * 7, float(k), float(k), 10.0 * k, k / 10, k, 0.9, 0.1 * k, k / 5, (k % 5) / 4, 3, 1.0) for k in range(1, 6)]
    names = "county_fips string, population long, mountain_magnitude double, crime_coverage double, " + ", ".join(f"crime_{f}_coverage_{y} double" for f in ("violent", "property") for y in (2023, 2024, 2025))
    names += ", crime_violent_rate double, crime_property_rate double, res_hazard_npctl double, water_violation_share double, community_context long, water_allocation_coverage double, broadband_100_20 double, homeschool_utility double, spare double, climate_station_count int, jan_avg_temp_f double"
    df = spark.createDataFrame(rows, names).withColumn("homeschool_utility", F.col("spare")).withColumns({c: F.lit(1.0) for c in C.CLIMATE_MEASURES[1:]})
    df = df.withColumns({m: F.col("mountain_magnitude") * 3 for m, _, _ in C.CALIBRATED if m != "mountain_magnitude"})
    df = R.ecdf(R.ecdf(df, "crime_violent_rate", "u_crime_violent", invert=True), "crime_property_rate", "u_crime_property", invert=True)
    df = df.withColumns({"u_crime": 0.6 * F.col("u_crime_violent") + 0.4 * F.col("u_crime_property"), "u_hazard": 1.0 - F.col("res_hazard_npctl") / 100.0, "u_water": 1.0 - F.col("water_violation_share"), "u_community_context": (10.0 - F.col("community_context")) / 9.0})
    return C.finish_counties(C.calibrate_counties(df))


def test_drift_is_found(spark):
    good = finished(spark)
    years = (2023, 2024, 2025)
    assert C.validate_counties(good, years).count() == 5
    first = F.col("county_fips") == "01001"
    cases = {
        "u_rpp calibration": ("u_rpp", F.col("u_rpp") - 1e-9), "u_safety drifted": ("u_safety", F.col("u_safety") + 1e-6), "u_crime drifted": ("u_crime", F.col("u_crime") - 1e-9), "u_health drifted": ("u_health", F.lit(None)), "outside": ("u_hazard", F.lit(1.5)),
        "coverage floor": ("crime_violent_coverage_2024", F.lit(0.89)), "without rates": ("crime_property_rate", F.lit(None)), "allocation floor": ("water_allocation_coverage", F.lit(None)), "coverage status": ("coverage_status", F.lit("partial_public_core")), "station": ("climate_station_count", F.lit(0)), "population": ("population", F.lit(0)),
        "county code": ("county_fips", F.lit("1001")), "unique": ("county_fips", F.lit("01002")),
    }
    for said, (column, value) in cases.items():
        with pytest.raises(K.ContractError, match=said):
            C.validate_counties(good.withColumn(column, F.when(first, value).otherwise(F.col(column))), years)
    with pytest.raises(K.ContractError, match="columns"):
        C.validate_counties(good, years, ["county_fips"])


# rasters


def brute_window(a, size, f):
    r = size // 2
    return np.array([[f(a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]) for j in range(a.shape[1])] for i in range(a.shape[0])])


def test_nearest_is_euclidean():
    rng = np.random.default_rng(4)
    for p in (0.02, 0.2, 0.7):
        valid = rng.random((23, 31)) < p
        valid[5, 6] = True
        d, r, c = G.nearest_valid(valid)
        at = np.argwhere(valid)
        for i in range(23):
            for j in range(31):
                assert d[i, j] == ((at - (i, j)) ** 2).sum(1).min() == (r[i, j] - i) ** 2 + (c[i, j] - j) ** 2 and valid[r[i, j], c[i, j]]
    assert np.isinf(G.nearest_valid(np.zeros((3, 4), bool))[0]).all()


def test_terrain_and_access_against_brute_force():
    rng = np.random.default_rng(9)
    e = rng.normal(0, 120, (21, 17)).cumsum(1)
    e[3:9, 2:7] = np.nan
    t = G.terrain(e, 1000.0)
    for r in G.RADII:
        want = brute_window(e, G.window_cells(1000 * r, 1000.0), lambda w: np.nanmax(w) - np.nanmin(w) if np.isfinite(w).any() else np.nan)
        assert np.allclose(t[f"relief_{r}km"], want, equal_nan=True)
    mountain = np.isfinite(e) & ((np.nan_to_num(t["slope"]) >= 15) | (t["relief_5km"] >= 300))
    assert (t["mountain"] == mountain).all() and np.isnan(t["slope"][5, 4]) and 0 < mountain.mean() < 1
    size = G.window_cells(20000, 1000.0)
    assert np.allclose(t["rugged"], brute_window(mountain.astype(float), size, np.sum) / brute_window(np.isfinite(e).astype(float), size, np.sum))
    land, trails = rng.integers(0, 5, e.shape), np.where(rng.random(e.shape) < 0.1, rng.random(e.shape), 0.0)
    got = G.access(mountain, land, trails, 1000.0)
    window = lambda a, km: brute_window(a.astype(float), G.window_cells(1000 * km, 1000.0), np.sum)
    o5, o15, o30 = (window(mountain & (land == 1), km) for km in (5, 15, 30))
    assert np.allclose(got["open_5"], o5) and np.allclose(got["open_15"], o15 - o5) and np.allclose(got["open_30"], o30 - o15) and np.allclose(got["access_raw"], o5 + 0.75 * (o15 - o5) + 0.4 * (o30 - o15))
    for code, name in ((2, "restricted_30"), (3, "closed_30"), (4, "unknown_30")):
        assert np.allclose(got[name], window(mountain & (land == code), 30))
    own = np.where(mountain, trails, 0)
    t10, t25 = window(own, 10), window(own, 25)
    assert np.allclose(got["trail_10"], t10) and np.allclose(got["trail_25"], t25) and np.allclose(got["trail_raw"], t10 + 0.4 * (t25 - t10))
    at = np.argwhere(own > 0)
    assert all(got["nearest_trail_km"][i, j] == pytest.approx(np.sqrt(((at - (i, j)) ** 2).sum(1).min())) for i in range(21) for j in range(17))


def test_terrain_cases():
    assert [G.window_cells(1000 * r, 250) for r in (5, 10, 20, 40)] == [35, 71, 141, 283]
    hole = np.full((5, 5), np.nan)
    hole[0, 0] = 1.0
    far = G.terrain(hole, 10_000.0, (5,))
    assert np.isnan(far["rugged"][4, 4]) and np.isnan(far["relief_5km"][4, 4]) and far["rugged"][0, 0] == 0
    none = G.access(np.ones((5, 5)), np.ones((5, 5)), np.zeros((5, 5)), 10_000.0)
    assert np.isnan(none["nearest_trail_km"]).all() and none["trail_raw"].max() == 0 and none["access_raw"][2, 2] > 0
    line = np.zeros((1, 30))
    line[0, 0] = 1.0
    far = G.access(np.ones((1, 30)), np.ones((1, 30)), line, 5_000.0)["nearest_trail_km"][0]
    assert far[20] == 100.0 and np.isnan(far[21])
    with pytest.raises(ValueError):
        G.terrain(np.full((2, 2), np.nan), 250.0)
    with pytest.raises(ValueError):
        G.access(np.ones((2, 2)), np.ones((2, 3)), np.ones((2, 2)), 250.0)


def test_rasterise(spark):
    at = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    df = spark.createDataFrame([(0, 1.0, [at((0, 0), (6, 0), (0, 6))]), (1, 2.0, [at((1, 1), (4, 1), (4, 3), (1, 3))])], "k long, v double, rings array<array<struct<x double, y double>>>")
    got = {(r.row, r.col): r.value for r in RZ.rasterise_polygons(df, "k", "rings", "k", "v", 1.0).collect()}
    for r in range(6):
        for c in range(6):
            x, y = c + 0.5, r + 0.5
            assert got.get((r, c), 0) == (2 if 1 < x < 4 and 1 < y < 3 else 1 if x + y < 6 else 0), (r, c)
    rows = RZ.rasterise_lines(spark.createDataFrame([(at((0.5, 0.5), (3.5, 0.5)),), (at((0, 0), (2, 2)),)], "p array<struct<x double, y double>>"), "p", 1.0).collect()
    lines = {(r.row, r.col): r.length for r in rows}
    assert sum(lines.values()) == pytest.approx(3 + 2 * math.sqrt(2)) and lines[0, 0] == pytest.approx(0.5 + math.sqrt(2)) and [lines[0, c] for c in (1, 2, 3)] == pytest.approx([1.0, 1.0, 0.5])


def test_mosaic_and_halos(spark):
    df = spark.createDataFrame([([1.0, NAN, NAN], [5.0, 6.0, NAN], [7.0, 8.0, 9.0])], "a array<double>, b array<double>, c array<double>")
    assert df.select(G.mosaic([F.col("a"), F.col("b"), F.col("c")])).first()[0] == [1.0, 6.0, 9.0]
    got = spark.createDataFrame([(0.5, 9.5), (5.0, 5.0)], "x double, y double").select(G.halo_tiles(F.col("x"), F.col("y"), 10.0, 1.0).alias("t")).collect()
    assert sorted((t.tx, t.ty) for t in got[0].t) == [(-1, 0), (-1, 1), (0, 0), (0, 1)] and [(t.tx, t.ty) for t in got[1].t] == [(0, 0)]


# names, months, addresses, features


def test_names(spark):
    cases = {"Doña Ana County": "DONAANA", "St. Mary's Parish": "STMARYS", "Juneau City and Borough": "JUNEAU", "Anchorage Municipality": "ANCHORAGE", "Lake & Peninsula  Borough": "LAKEANDPENINSULA", "Hoonah-Angoon Census Area": "HOONAHANGOON", "County": "COUNTY", "Borough County": "BOROUGH", "ǅ½ Élan": "DZELAN"}
    got = [r[0] for r in spark.createDataFrame([(k,) for k in cases], "n string").select(D.normalised_name(F.col("n"))).collect()]
    assert got[:-1] == list(cases.values())[:-1] and got[-1].endswith("ELAN")
    areas = spark.createDataFrame([("NM", "Doña Ana County", "35013"), ("NM", "Dona Ana", "35014")], "state string, name string, code string")
    with pytest.raises(K.ContractError):
        D.name_crosswalk(areas, "state", "name", "code")
    assert D.name_crosswalk(areas.limit(1), "state", "name", "code").first().name_key == "DONAANA"


def test_months_and_attributions(spark):
    r = spark.createDataFrame([("2025-01", "a"), ("2025-01", "a"), ("2025-02", "b")], "month string, digest string")
    assert D.distinct_months(r, "month", "digest").count() == 2
    with pytest.raises(K.ContractError):
        D.distinct_months(r.withColumn("digest", F.monotonically_increasing_id().cast("string")), "month", "digest")
    s = spark.createDataFrame([("x", "2025-01"), ("x", "2025-02"), ("y", "2025-01"), ("y", "2025-09")], "k string, m string")
    keys = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    assert {tuple(r) for r in D.month_sets(s, "k", "m", ["2025-01", "2025-02"], keys).collect()} == {("y", 1, 1), ("z", 2, 0)}
    a = spark.createDataFrame([("o", "01001", None), ("o", "01001", None), ("p", None, "missing")], "ori string, county string, reason string")
    assert D.assert_one_area(a, "ori", "county", "reason").count() == 3
    for extra in (("o", "01003", None), ("o", None, "multiple")):
        with pytest.raises(K.ContractError):
            D.assert_one_area(a.unionByName(spark.createDataFrame([extra], a.schema)), "ori", "county", "reason")
    m = spark.createDataFrame([("k", "2025-01", 100.0, 5.0, 0), ("k", "2025-02", 200.0, 7.0, 0), ("k", "2025-03", 300.0, 9.0, 1), ("k", "2025-04", NAN, 9.0, 0), ("k", "2025-05", 400.0, None, 0), ("k", "2024-05", 900.0, 1.0, 0), ("j", "2024-01", 1.0, 1.0, 0)], "k string, m string, p double, n double, f int")
    assert [tuple(r) for r in D.market_year(m, "k", "m", "p", "n", "f").collect()] == [("k", 2, 6.0, 150.0, 1e6 / 150)]
    with pytest.raises(K.ContractError, match="parts_beyond_total"):
        K.assert_none(spark.createDataFrame([(5, 3, 3, 1990)], "t int, a int, b int, y int"), D.stock_problems(F.col("t"), [F.col("a"), F.col("b")], F.col("y"), 2024))


def test_addresses(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.without_unit(F.lit("12b Main St, Apt. 4C, Denver, CO"))) == "12b Main St, Denver, CO" and one(X.without_unit(F.lit("1 Unit Rd #7"))) == "1 Unit Rd" and one(X.house_number(F.lit(" 12b Main"))) == "12B"
    hit = lambda **k: one(X.hit_precision(*[F.lit(v) for v in ({"wanted": "12b Main St", "lat": 40.0, "lon": -105.0, "country": "US", "kind": "house", "group": "", "house": "12B", "shown": "x"} | k).values()]))
    assert hit() == "house" and hit(house="13") is None and hit(kind="Road") == "street" and hit(kind="city") is None and hit(country="ca") is None and hit(lat=91.0) is None and hit(shown=" ") is None and hit(kind="odd", group="highway", house="") == "street" and hit(kind="odd", group="building") == "house"
    hits = spark.createDataFrame([("q", "house", 1.000001, 2.0, 2), ("q", "house", 1.000002, 2.0, 1), ("q", "street", 1.0, 2.0, 3)], "q string, p string, lat double, lon double, seq int")
    assert sorted(r.seq for r in X.unique_hits(hits, "q", "p", "lat", "lon", "seq").collect()) == [1, 3]


def test_features(spark):
    f = spark.createDataFrame([("t", 2, "e", [3.0, 4.0], [0.0, 1.0]), ("t", 1, "e", [0.0, 3.0], [0.0, 0.0]), ("u", 1, None, [170.0, 179.0], [5.0, 6.0])], "id string, n int, kind string, x array<double>, y array<double>")
    got = L.logical_features(f, "id", ["n"], ["kind"], "x", "y")
    r = {v.id: v for v in got.collect()}
    assert (r["t"].fragments, r["t"].r_x0, r["t"].r_x1, r["t"].r_y1, [p.n for p in r["t"].parts]) == (2, 0.0, 4.0, 1.0, [1, 2])
    assert [v.id for v in L.features_in(got, 175.0, 0.0, -175.0, 9.0).collect()] == ["u"] and [v.id for v in L.features_in(got, 4.0, 1.0, 5.0, 2.0).collect()] == ["t"]
    with pytest.raises(K.ContractError):
        L.logical_features(f.withColumn("kind", F.col("n").cast("string")), "id", ["n"], ["kind"], "x", "y")
    ring = ([0.0, 4.0, 4.0, 0.0, NAN, 1.0, 2.0, 2.0, 1.0], [0.0, 0.0, 4.0, 4.0, NAN, 1.0, 1.0, 2.0, 2.0])
    polygons = spark.createDataFrame([(1, *ring)], "polygon int, px array<double>, py array<double>")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 9.0, 9.0)], "point int, x double, y double")
    assert [tuple(r) for r in L.points_in_polygons(points, polygons, 2.0).collect()] == [(1, 1)]


def test_fit_rounds_as_sql(spark, tmp_path):
    """Spends whose share has a 5 in the seventh place: text and scaled numbers round some of them apart, and ranks follow."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer AS SELECT i AS c_custkey, (i % 13)::INTEGER AS c_nationkey, (i % 700)::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(4000) r(i)")
    duck.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i % 4000 AS o_custkey, (i % 4000 * 105 + 2.5)::DOUBLE AS o_totalprice FROM range(28000) r(i)")
    for name in ("customer", "orders"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = QUERIES["preference_fit"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == duck.execute(f"SELECT * FROM ({SQL['preference_fit']}) ORDER BY c_custkey").fetchall()


@pytest.fixture
def no_broadcast(spark):
    """Whatever Spark gathers on the driver to broadcast it fails."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield spark
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_stages_are_not_broadcast(no_broadcast):
    """Stages compress to little, but are as long as the counties."""
    stages = [no_broadcast.range(0, 90, k).select(F.col("id").alias("county_fips"), (F.col("id") * k).alias(f"m{k}")) for k in (1, 2, 3)]
    got = C.assemble(no_broadcast.range(100).select(F.col("id").alias("county_fips")), stages)
    assert sorted(map(tuple, got.collect())) == [(i, *[i * k if i < 90 and i % k == 0 else None for k in (1, 2, 3)]) for i in range(100)]


def test_many_ranked_values_are_not_broadcast(no_broadcast, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_VALUES", 10, raising=False)
    df = no_broadcast.range(101).select(F.col("id").alias("county_fips"), F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    got = R.ecdfs(df, "county_fips", {"u": ("a", False), "v": ("b", True)})
    assert {r.county_fips: (r.u, r.v) for r in got.collect()} == {i: (i / 100, (24.5 if i % 2 else 75.0) / 100) for i in range(101)}


def test_drift_is_found_without_a_broadcast(no_broadcast, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_VALUES", 10, raising=False)
    names = [("crime_violent_rate", "u_crime_violent"), ("crime_property_rate", "u_crime_property"), *[(m, u) for m, u, _ in C.CALIBRATED]]
    frame = no_broadcast.range(101).select(F.col("id").alias("county_fips"), *[F.lit(None).cast("double").alias(c) for pair in names if "rpp_index" not in pair for c in pair], F.col("id").cast("double").alias("rpp_index"), F.when(F.col("id") == 7, 0.5).otherwise(1 - F.col("id") / 100).alias("u_rpp"))
    assert [tuple(r) for r in C.calibration_drift(frame).collect()] == [(7, "u_rpp")]


@pytest.mark.parametrize(("few", "cell"), [(True, 64.0), (True, 1.0), (False, 10.0)])
def test_a_cell_of_points_and_polygons_is_dealt_out(spark, monkeypatch, few, cell):
    """Polygons of any size and with holes, points and polygons in blocks; one cell's pairs are not one task's."""
    if few:
        for name, n in (("BLOCK_POINTS", 60), ("BLOCK_POLYGONS", 5), ("BLOCK_CORNERS", 40), ("BATCH_PAIRS", 7), ("BROADCAST_CELLS", 0)):
            monkeypatch.setattr(L, name, n, raising=False)
    rng = np.random.default_rng(11)
    ring = lambda x, y, w: ([x, x + w, x + w / 2], [y, y, y + w])
    rows = []
    for k in range(60):
        (x, y), w = rng.uniform(0, 9, 2), [0.5, 2.0, 30.0][k % 3] * rng.random() + 0.01
        (ax, ay), (bx, by) = ring(x, y, w), ring(x + w / 4, y + w / 8, w / 3)
        rows.append((k, list(map(float, ax + ([NAN, *bx] if k % 2 else []))), list(map(float, ay + ([NAN, *by] if k % 2 else [])))))
    spots = [(f"p{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 10, (900, 2)))]
    odd = [("none", None, 1.0), ("nan", NAN, 1.0)]
    polygons = spark.createDataFrame([*rows, (60, [], []), (61, None, None)], "polygon int, px array<double>, py array<double>").coalesce(1)
    points = spark.createDataFrame([*spots, *odd], "point string, x double, y double").coalesce(1)
    x, y = np.array([s[1] for s in spots]), np.array([s[2] for s in spots])
    want = sorted((spots[i][0], k) for k, px, py in rows for i in np.flatnonzero(L.inside(x, y, np.array(px), np.array(py))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.points_in_polygons(points, polygons, cell).select("point", "polygon", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.point, r.polygon) for r in got) == want
    assert len({r.task for r in got}) > 1 or cell < 64  # at 64 everything lies in one cell
    assert L.points_in_polygons(points, polygons.limit(0), cell).count() == 0 and L.points_in_polygons(points.limit(0), polygons, cell).count() == 0


def test_points_on_a_slanted_edge_fall_as_in_sql(spark, tmp_path):
    """Balances that lie on the edge but for the last bit of a sum."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, (i % 25)::INTEGER AS s_nationkey, round(i * 7.31 - 900, 2)::DOUBLE AS s_acctbal FROM range(1000) r(i)")
    duck.execute("CREATE TABLE customer AS SELECT i AS c_custkey, (i % 1000 % 25 + i // 1000)::INTEGER AS c_nationkey, round(i % 1000 * 7.31 - 900 + 250 + i // 1000 * 100, 2)::DOUBLE AS c_acctbal FROM range(2000) r(i)")
    for name in ("customer", "supplier"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = QUERIES["points_in_polygons"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got)) == duck.execute(f"SELECT * FROM ({SQL['points_in_polygons']}) ORDER BY ALL").fetchall()

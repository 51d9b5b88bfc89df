"""County measures from published tables, one function a stage, and their calibration into pillars.

Stages take frames as ``sources.readers`` give them (or any frame with these columns) and return one row a county with its
measures and a status that says why one is missing. ``assemble`` joins them; ``calibrate_counties`` and ``finish_counties`` rank and weigh.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import all_of, finite, overlaps, weighted_utility, zfill
from quernstone.operators.contracts import ContractError, assert_none, assert_unique, join_preserving
from quernstone.operators.ranks import ecdfs
from quernstone.sources.shared import written

CRIME_FLOOR = WATER_FLOOR = 0.90
#: Families of offences to (short name, share of the crime utility).
FAMILIES = {"violent-crime": ("violent", 0.60), "property-crime": ("property", 0.40)}
#: (measure, utility, lower is better), ranked over all counties.
CALIBRATED = (
    ("provider_primary_care", "u_primary_care", False),
    ("provider_mental_health", "u_mental_health", False),
    ("provider_dental", "u_dental", False),
    ("rpp_index", "u_rpp", True),
    ("property_tax_rate", "u_property_tax", True),
    ("employment_growth", "u_employment_growth", False),
    ("average_weekly_wage", "u_average_weekly_wage", False),
    ("commute_under_30_share", "u_commute_under_30", False),
    ("mountain_magnitude", "u_mountain", False),
)
#: Pillars to (utility, weight) of their parts.
MIXES = {
    "u_safety": (("u_hazard", 0.50), ("u_crime", 0.35), ("u_water", 0.15)),
    "u_health": (("u_healthcare", 0.60), ("u_community_context", 0.40)),
    "u_opportunity": (("u_employment", 0.60), ("u_broadband", 0.40)),
}
CORE = ("u_safety", "u_health", "u_opportunity", "u_lifestyle", "u_family")
CLIMATE_MEASURES = ("jan_avg_temp_f", "jul_avg_temp_f", "extreme_heat_days", "extreme_cold_days")


def number(c: str | Column) -> Column:
    """Text as a finite number, else null."""
    return finite((F.col(c) if isinstance(c, str) else c).try_cast("double"))


def population(pep: DataFrame, states: Sequence[str], vintage: str, measure: str) -> DataFrame:
    """Counties (summary level 050) of ``states`` with their estimate ``measure``."""
    code = F.concat(zfill(F.col("STATE"), 2), zfill(F.col("COUNTY"), 3))
    rows = pep.where((F.col("SUMLEV") == "050") & F.col("STATE").isin(list(states)))
    return assert_unique(rows.select(code.alias("county_fips"), F.col(measure).cast("long").alias("population"), F.lit(vintage).alias("population_vintage"), F.lit("complete").alias("population_status")), ["county_fips"])


def runtime_context(counties: DataFrame) -> DataFrame:
    """Utilities of the scored hazard percentile and of the published community group (1 best to 10)."""
    group, hazard = F.col("community_conditions_group").cast("double"), F.col("res_hazard_npctl").cast("double")
    known = group.between(1, 10)
    return assert_unique(counties.select(
        F.col("place_id").alias("county_fips"), "state", hazard.alias("res_hazard_npctl"), (1.0 - hazard / 100.0).alias("u_hazard"),
        F.when(hazard.isNotNull(), "complete").otherwise("missing").alias("hazard_status"), group.alias("community_context"), F.when(known, (10.0 - group) / 9.0).alias("u_community_context"),
        F.when(known, "published_group_reconstructed").otherwise("missing").alias("community_context_kind"), F.when(known, "complete").otherwise("missing").alias("community_context_status"),
    ), ["county_fips"])


def crime(series: DataFrame, years: Sequence[int], floor: float = CRIME_FLOOR) -> DataFrame:
    """Pooled rates per 100,000 person-years. ``series``: ``ori, county_fips, family, year, month, offenses, population, participated``.

    A year counts for a county if all its agencies report exactly the twelve months, each with a population, and people of
    participating agencies are at least ``floor`` of all. Months with offences but nobody participating are left out of the
    sums. Rates need every year of both families. ``u_crime`` mixes the two utilities.
    """
    series = assert_none(series, {
        "a negative measure": F.coalesce((F.col("population") < 0) | (F.col("participated") < 0) | (F.col("offenses") < 0), F.lit(False)),
        "more people participate than there are": F.coalesce(F.col("participated") > F.col("population"), F.lit(False)),
    })
    counted = F.col("population").isNotNull() & F.col("offenses").isNotNull() & F.col("participated").isNotNull() & ~((F.col("participated") == 0) & (F.col("offenses") > 0))
    some = lambda c: F.sum(F.when(counted, F.col(c).cast("decimal(20,4)")))
    full = (F.count("month") == 12) & (F.count_distinct("month") == 12) & (F.min("month") == 1) & (F.max("month") == 12) & (F.count("population") == 12)
    agency = series.where(F.col("year").isin(list(years))).groupBy("county_fips", "ori", "family", "year")
    agency = agency.agg(full.alias("full"), F.sum(F.col("population").cast("decimal(20,4)")).alias("population"), some("offenses").alias("offenses"), some("participated").alias("participated"))
    # an agency without any row of a year makes the year unknown, too
    agencies = series.select("county_fips", "ori").distinct()
    cells = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(y).alias("year")) for f in FAMILIES for y in years])
    agency = agencies.select("county_fips", "ori", F.explode(cells).alias("c")).select("county_fips", "ori", "c.*").join(agency, ["county_fips", "ori", "family", "year"], "left")
    year = agency.groupBy("county_fips", "family", "year").agg(F.bool_and(F.coalesce("full", F.lit(False))).alias("full"), *[F.sum(c).alias(c) for c in ("population", "offenses", "participated")])
    share = F.col("participated").cast("double") / F.nullif(F.col("population"), F.lit(0)).cast("double")
    year = year.withColumn("coverage", F.when(F.col("full") & (F.col("population") > 0), F.coalesce(share, F.lit(0.0))))
    cell = lambda f, y, c: F.max(F.when((F.col("family") == f) & (F.col("year") == y), F.col(c)))
    aggs = [cell(f, y, "coverage").alias(f"crime_{short}_coverage_{y}") for f, (short, _) in FAMILIES.items() for y in years]
    for f, (short, _) in FAMILIES.items():
        aggs += [F.sum(F.when((F.col("family") == f) & F.col("coverage").isNotNull(), F.col(c))).cast("double").alias(f"_{short}_{c}") for c in ("offenses", "participated")]
    out = year.groupBy("county_fips").agg(*aggs)
    covers = [F.col(f"crime_{short}_coverage_{y}") for short, _ in FAMILIES.values() for y in years]
    out = out.withColumn("_ok", all_of([F.coalesce(c >= floor, F.lit(False)) for c in covers]))
    for short, _ in FAMILIES.values():
        out = out.withColumn(f"crime_{short}_rate", F.when(F.col("_ok") & (F.col(f"_{short}_participated") > 0), F.col(f"_{short}_offenses") / (F.col(f"_{short}_participated") / 12.0) * 100_000.0))
    out = ecdfs(out, "county_fips", {f"u_crime_{short}": (f"crime_{short}_rate", True) for short, _ in FAMILIES.values()})
    names = [c for c in out.columns if not c.startswith("_")]
    return out.select(*names, F.when(F.col("_ok"), F.least(*covers)).alias("crime_coverage"), F.when(F.col("_ok"), "complete").otherwise("below_coverage_or_missing").alias("crime_status"),
        weighted_utility([(F.col(f"u_crime_{short}"), w) for short, w in FAMILIES.values()]).alias("u_crime"))


def providers(resources: DataFrame, mental: DataFrame) -> DataFrame:
    """Counts of providers. ``resources``: ``fips, primary_care, dental``; ``mental``: ``fips, mental_health`` (texts)."""
    code = zfill(F.col("fips"), 5).alias("county_fips")
    a = assert_unique(resources.select(code, number("primary_care").alias("provider_primary_care_count"), number("dental").alias("provider_dental_count")), ["county_fips"])
    return join_preserving(a, mental.select(code, number("mental_health").alias("provider_mental_health_count")), ["county_fips"])


def provider_rates(frame: DataFrame) -> DataFrame:
    """Counts as rates per 100,000 people."""
    kinds = ("primary_care", "mental_health", "dental")
    return frame.withColumns({f"provider_{k}": F.col(f"provider_{k}_count") / F.nullif(F.col("population"), F.lit(0)) * 100_000 for k in kinds}).drop(*[f"provider_{k}_count" for k in kinds])


def property_tax(tax: DataFrame, value: DataFrame) -> DataFrame:
    """Median tax over median value where both are above 0. Both: ``county_fips, estimate``."""
    both = join_preserving(assert_unique(tax.withColumnRenamed("estimate", "_tax"), ["county_fips"]), value.withColumnRenamed("estimate", "_value"), ["county_fips"])
    ok = F.coalesce((F.col("_tax") > 0) & (F.col("_value") > 0), F.lit(False))
    return both.select("county_fips", F.when(ok, F.col("_tax") / F.col("_value")).alias("property_tax_rate"), F.when(ok, "complete").otherwise("missing_or_invalid_denominator").alias("property_tax_status"))


def price_parities(counties: DataFrame, metro_of: DataFrame, metro: DataFrame, state: DataFrame) -> DataFrame:
    """The metropolitan area's price level, else the state's. ``metro_of``: ``county_fips, cbsa_id``; levels: key and ``index``."""
    rows = join_preserving(counties.select("county_fips"), metro_of.select("county_fips", "cbsa_id"), ["county_fips"], "1:1")
    rows = join_preserving(rows, metro.withColumnRenamed("index", "_metro"), ["cbsa_id"]).withColumn("state_fips", F.left("county_fips", F.lit(2)))
    rows = join_preserving(rows, state.withColumnRenamed("index", "_state"), ["state_fips"])
    level = F.coalesce("_metro", "_state")
    return rows.select("county_fips", level.alias("rpp_index"), F.when(F.col("_metro").isNotNull(), "metropolitan").otherwise("state").alias("rpp_geography_type"), F.when(level.isNotNull(), "complete").otherwise("missing").alias("rpp_status"))


def annual_jobs(workbook: DataFrame) -> DataFrame:
    """County totals of all industries and owners. Columns as in the workbook."""
    rows = workbook.where((F.col("Area Type") == "County") & (F.col("Own") == "0") & (F.col("NAICS") == "10") & (F.col("Qtr") == "A"))
    out = rows.select(F.concat(zfill(F.col("St"), 2), zfill(F.col("Cnty"), 3)).alias("county_fips"), number("Annual Average Employment").alias("employment"), number("Annual Average Weekly Wage").alias("average_weekly_wage"))
    return assert_unique(out, ["county_fips"])


def commute(table: DataFrame) -> DataFrame:
    """Share of commutes under 30 minutes. ``table``: ``county_fips, e001`` (all) and ``e002`` to ``e007`` (null makes the share null)."""
    under = functools.reduce(lambda a, b: a + b, [F.col(f"e00{k}") for k in range(2, 8)])
    return assert_unique(table.select("county_fips", F.when(F.col("e001") > 0, under / F.col("e001")).alias("commute_under_30_share")), ["county_fips"])


def employment(prior: DataFrame, current: DataFrame, commutes: DataFrame) -> DataFrame:
    """Growth of jobs, wages and short commutes, for the counties of the prior year."""
    rows = join_preserving(prior.select("county_fips", F.col("employment").alias("_prior")), current.withColumnRenamed("employment", "_now"), ["county_fips"])
    rows = join_preserving(rows, commutes, ["county_fips"])
    grown = F.when(F.col("_prior") > 0, (F.col("_now") - F.col("_prior")) / F.col("_prior"))
    full = F.coalesce((F.col("_prior") > 0) & F.col("_now").isNotNull() & F.col("average_weekly_wage").isNotNull() & F.col("commute_under_30_share").isNotNull(), F.lit(False))
    return rows.select("county_fips", grown.alias("employment_growth"), "average_weekly_wage", "commute_under_30_share", F.when(full, "complete").otherwise("missing_component").alias("employment_status"))


def broadband(summary: DataFrame) -> DataFrame:
    """Share of locations served at 100/20, from the summary's total of counties, terrestrial, residential."""
    rows = summary.where("area_data_type = 'Total' and geography_type = 'County' and technology = 'Any Terrestrial' and biz_res = 'R'")
    share = number("speed_100_20")
    return assert_unique(rows.select(zfill(F.col("geography_id"), 5).alias("county_fips"), share.alias("broadband_100_20"), F.lit("broadband-serviceable locations").alias("broadband_denominator_label"),
        F.when(share.between(0, 1), "complete").otherwise("missing_or_invalid").alias("broadband_status")), ["county_fips"])


def water_systems(systems: DataFrame, service: DataFrame) -> DataFrame:
    """Active community systems with people: ``PWSID, people, class`` (``retail``, ``unknown``; pure wholesalers are left out).

    A system that isn't a wholesaler sells retail, and so does one with a service area of another kind than wholesale.
    """
    codes = service.where("SERVICE_AREA_TYPE_CODE <> ''").groupBy("PWSID").agg(F.collect_set("SERVICE_AREA_TYPE_CODE").alias("codes"))
    people = number("POPULATION_SERVED_COUNT")
    own = assert_unique(systems.distinct(), ["PWSID"]).where((F.col("PWS_TYPE_CODE") == "CWS") & (F.col("PWS_ACTIVITY_CODE") == "A") & (F.col("SUBMISSION_STATUS_CODE") == "Y") & (people > 0))
    whole, listed = F.col("IS_WHOLESALER_IND"), F.col("codes").isNotNull()
    kind = F.when(whole == "N", "retail").when((whole == "Y") & listed, F.when(F.size(F.array_except("codes", F.array(F.lit("WH")))) > 0, "retail")).otherwise("unknown")
    return own.join(codes, "PWSID", "left").select("PWSID", "PRIMACY_AGENCY_CODE", people.alias("people"), kind.alias("class")).where("class is not null")


def violating_systems(violations: DataFrame, first: str, last: str) -> DataFrame:
    """Systems with a health-based violation that overlaps the period (dates yyyy-MM-dd; source dates MM/dd/yyyy)."""
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("MM/dd/yyyy")).cast("date")
    kept = ["PWSID", "VIOLATION_ID", "NON_COMPL_PER_BEGIN_DATE", "NON_COMPL_PER_END_DATE", "IS_HEALTH_BASED_IND"]
    ended, end = F.nullif(F.col("NON_COMPL_PER_END_DATE"), F.lit("")), day("NON_COMPL_PER_END_DATE")
    within = overlaps(day("NON_COMPL_PER_BEGIN_DATE"), end, F.lit(first).cast("date"), F.lit(last).cast("date")) & (ended.isNull() | end.isNotNull())
    rows = violations.where((F.col("IS_HEALTH_BASED_IND") == "Y") & within).select(*kept).distinct()
    return assert_unique(rows, ["PWSID", "VIOLATION_ID"]).select("PWSID").distinct()


def boundary_provenance(boundaries: DataFrame) -> DataFrame:
    """``PWSID, provenance``: supplied, modeled, or mixed. ``boundaries``: ``PWSID`` (a list with ``;``), ``Symbology_Field``."""
    kind = F.when(F.col("Symbology_Field") == "System Sourced", "supplied").when(F.col("Symbology_Field") == "Modeled", "modeled")
    rows = assert_none(boundaries.withColumn("_kind", kind), {"unknown provenance": F.col("_kind").isNull()})
    rows = rows.select(F.explode(F.filter(F.transform(F.split("PWSID", ";"), lambda p: F.trim(p)), lambda p: p != "")).alias("PWSID"), "_kind")
    return rows.groupBy("PWSID").agg(F.when(F.min("_kind") == F.max("_kind"), F.min("_kind")).otherwise("mixed").alias("provenance"))


def served_blocks(blocks: DataFrame, active: DataFrame) -> DataFrame:
    """``PWSID, GEOID20, people``: the largest intersection of each active system and block. ``blocks``: ``GEOID20, PWSID`` (``;`` list), ``Pop20_AW``."""
    rows = blocks.select("GEOID20", F.explode(F.split(F.regexp_replace("PWSID", r"\s+", ""), ";")).alias("PWSID"), F.col("Pop20_AW").try_cast("double").alias("_p")).join(active.select("PWSID").distinct(), "PWSID", "left_semi")
    rows = assert_none(rows, {"invalid block population": F.col("_p").isNull() | (F.col("_p") < 0)})
    return rows.groupBy("PWSID", "GEOID20").agg(F.max("_p").alias("people"))


def water(counties: DataFrame, systems: DataFrame, violating: DataFrame, provenance: DataFrame, blocks: DataFrame, areas: DataFrame, state_codes: dict[str, str], legacy: Sequence[str] = ("09",)) -> DataFrame:
    """Share of allocated people whose system violated, per county. ``counties``: ``county_fips, base_2020``; ``blocks`` as from ``served_blocks``.

    A retail system's people are split over counties in proportion to its blocks. People of systems that can't be split
    (or of unknown class) count as uncovered in the one county they are said to serve; several make those counties ambiguous.
    """
    county, alive = F.left("GEOID20", F.lit(5)), ~F.left("county_fips", F.lit(2)).isin(list(legacy))
    exact = lambda c: F.sum(F.col(c).cast("decimal(24,8)"))
    retail = systems.where("class = 'retail'")
    parts = blocks.groupBy("PWSID", county.alias("county_fips")).agg(exact("people").cast("double").alias("part")).join(counties.where(alive).select("county_fips"), "county_fips", "left_semi")
    whole = Window.partitionBy("PWSID")  # a system lies in few counties
    parts = parts.withColumn("_whole", F.sum("part").over(whole)).where("_whole > 0")
    split = parts.join(retail.select("PWSID", "people"), "PWSID").join(provenance, "PWSID").join(violating.withColumn("_bad", F.lit(True)), "PWSID", "left")
    split = split.withColumn("allocated", F.col("people") * F.col("part") / F.col("_whole"))
    got = split.groupBy("county_fips").agg(exact("allocated").cast("double").alias("_allocated"), F.sum(F.when(F.col("_bad"), F.col("allocated")).cast("decimal(24,8)")).cast("double").alias("_violating"), F.collect_set("provenance").alias("_kinds"))
    # what can't be split
    left = systems.where("class = 'unknown'").unionByName(retail.join(split.select("PWSID").distinct(), "PWSID", "left_anti"))
    codes = F.create_map(*[F.lit(x) for kv in state_codes.items() for x in kv])
    named = areas.distinct().join(systems.select("PWSID", "PRIMACY_AGENCY_CODE"), "PWSID")
    prefix = F.left("PWSID", F.lit(2))
    named = assert_none(named, {"primacy and system prefix differ": prefix.rlike("^[A-Za-z]{2}$") & (prefix != F.col("PRIMACY_AGENCY_CODE"))})
    named = named.where(prefix.rlike("^[A-Za-z]{2}$") & F.col("ANSI_ENTITY_CODE").rlike("^[0-9]{3}$"))
    served = named.select("PWSID", F.concat(codes[F.col("PRIMACY_AGENCY_CODE")], "ANSI_ENTITY_CODE").alias("county_fips")).join(counties.select("county_fips"), "county_fips", "left_semi").groupBy("PWSID").agg(F.collect_set("county_fips").alias("served"))
    open_ = left.join(served, "PWSID").select("people", "served", (F.size("served") > 1).alias("_several"))
    uncovered = open_.select("people", "_several", F.explode("served").alias("county_fips")).groupBy("county_fips").agg(F.sum(F.when(~F.col("_several"), F.col("people")).cast("decimal(24,8)")).cast("double").alias("_uncovered"), F.bool_or("_several").alias("_ambiguous"))
    # a block that several systems serve counts once, with its largest part; the rest measures the overlap
    block = blocks.groupBy("GEOID20").agg(F.max("people").alias("_most"), exact("people").cast("double").alias("_sum"))
    proxy = block.groupBy(county.alias("county_fips")).agg(exact("_most").cast("double").alias("_proxy"), exact("_sum").cast("double").alias("_every"))
    rows = counties.join(got, "county_fips", "left").join(uncovered, "county_fips", "left").join(proxy, "county_fips", "left")
    reach = F.when(F.col("base_2020") > 0, F.col("_proxy") / F.col("base_2020"))
    rows = assert_none(rows.withColumn("_reach", reach), {"public-water coverage is beyond its tolerance": F.coalesce(F.col("_reach") > 1.005, F.lit(False))})
    allocated = F.coalesce("_allocated", F.lit(0.0))
    below = allocated + F.coalesce("_uncovered", F.lit(0.0))
    coverage = F.when(below > 0, allocated / below)
    share = F.when(allocated > 0, F.coalesce("_violating", F.lit(0.0)) / allocated)
    status = (
        F.when(~alive, "missing_legacy_geography").when(F.coalesce("_ambiguous", F.lit(False)), "ambiguous_served_counties").when(coverage.isNull(), "missing_no_allocatable_systems")
        .when(coverage < WATER_FLOOR, "below_allocation_coverage").otherwise("complete")
    )
    known = F.col("_reach").isNotNull()
    return rows.select(
        "county_fips", share.alias("water_violation_share"), F.when(known, F.least(F.lit(1.0), "_reach")).alias("public_water_coverage"), F.lit("max_intersection_proxy").alias("public_water_coverage_kind"), coverage.alias("water_allocation_coverage"),
        F.when(F.size("_kinds") == 1, F.get("_kinds", F.lit(0))).when(F.size("_kinds") > 1, "mixed").alias("water_boundary_provenance"), F.when(known, (F.col("_every") - F.col("_proxy")) / F.nullif("_every", F.lit(0.0))).alias("water_overlap_duplicate_share_proxy"),
        F.when(known, "max_intersection_proxy").otherwise("missing_proxy").alias("water_overlap_quality_status"), F.when(status == "complete", 1.0 - share).alias("u_water"), status.alias("water_status"),
    )


def stations(annual: DataFrame, monthly: DataFrame) -> DataFrame:
    """Stations with all four measures. ``annual``: ``station, latitude, longitude, heat, cold``; ``monthly``: ``station, month, normal``."""
    full = annual.where(all_of([F.col(c).isNotNull() for c in ("station", "latitude", "longitude", "heat", "cold")])).distinct()
    full = assert_unique(full, ["station"])
    kept = monthly.where("normal is not null and month in ('01', '07')").select("station", "month", "normal").distinct()
    kept = assert_unique(kept, ["station", "month"])
    wide = kept.groupBy("station").agg(*[F.max(F.when(F.col("month") == m, F.col("normal"))).alias(c) for m, c in (("01", "jan_avg_temp_f"), ("07", "jul_avg_temp_f"))])
    out = full.join(wide, "station").where("jan_avg_temp_f is not null and jul_avg_temp_f is not null")
    return out.withColumnsRenamed({"heat": "extreme_heat_days", "cold": "extreme_cold_days"})


def climate(counties: DataFrame, found: DataFrame, within: DataFrame) -> DataFrame:
    """Means over the stations inside a county. ``within``: ``station, county_fips`` (as from ``points_in_polygons``; a station in two counties fails)."""
    placed = found.join(assert_unique(within, ["station"]), "station")
    mean = lambda c: (F.sum(F.col(c).cast("decimal(24,10)")).cast("double") / F.count("*")).alias(c)
    g = placed.groupBy("county_fips").agg(*[mean(c) for c in CLIMATE_MEASURES], F.count("*").alias("climate_station_count"))
    n = F.coalesce("climate_station_count", F.lit(0))
    status = F.when(n > 0, "complete_in_county_station_mean").otherwise("missing_no_qualifying_in_county_station")
    return counties.select("county_fips").join(g, "county_fips", "left").select("county_fips", *CLIMATE_MEASURES, n.alias("climate_station_count"), status.alias("climate_coverage_status"))


def assemble(base: DataFrame, stages: Sequence[DataFrame]) -> DataFrame:
    """All stages joined on the county, one to one, nobody added or lost.

    Base and stages are written once each and checked as written, so a stage's work is done once, however many stages there are.
    They are as long as the base, but their files compress to so little that Spark would gather them all on the driver to
    broadcast them; so they are joined by a shuffle, and what is joined is written, as ranks read it several times.
    """
    base = assert_unique(written(base, "counties"), ["county_fips"])
    for stage in stages:
        # the left keys are unique already, and a left join with unique keys keeps them so
        base = join_preserving(base, written(stage, "stage"), ["county_fips"], hint="merge")
    return written(base, "assembled")


def calibrate_counties(frame: DataFrame) -> DataFrame:
    """Utilities of the ranked measures, and what mixes them: healthcare (all three known), employment, broadband, family, lifestyle."""
    frame = ecdfs(frame, "county_fips", {u: (m, invert) for m, u, invert in CALIBRATED})
    three = [F.col(c) for c in ("u_primary_care", "u_mental_health", "u_dental")]
    full = all_of([c.isNotNull() for c in three])
    jobs = weighted_utility([(F.col("u_employment_growth"), 0.50), (F.col("u_average_weekly_wage"), 0.25), (F.col("u_commute_under_30"), 0.25)])
    return frame.withColumns({
        "u_healthcare": F.when(full, (three[0] + three[1] + three[2]) / 3.0), "u_employment": jobs, "u_broadband": F.col("broadband_100_20"), "u_family": F.col("homeschool_utility"),
        "u_lifestyle": F.col("u_mountain"), "healthcare_status": F.when(full, "complete").otherwise("missing_component"),
    })


def finish_counties(frame: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """Pillars, explicit statuses, and whether the public core is complete."""
    frame = frame.withColumns({p: weighted_utility([(F.col(c), w) for c, w in parts]) for p, parts in MIXES.items()})
    frame = frame.withColumns({c: F.coalesce(F.col(c), F.lit("missing")) for c in statuses})
    core = all_of([F.col(c).isNotNull() for c in CORE])
    return frame.withColumn("coverage_status", F.when(core, "complete_public_core").otherwise("partial_public_core"))


def _drift(actual: Column, wanted: Column, tolerance: float) -> Column:
    """One is known and the other isn't, or they differ by more than ``tolerance``."""
    return F.when(actual.isNull() | wanted.isNull(), actual.isNull() != wanted.isNull()).otherwise(F.abs(actual - wanted) > tolerance)


def drift_problems(years: Sequence[int]) -> dict[str, Column]:
    """What a finished table may not show, row by row (for ``contracts.assert_none``)."""
    col, known = F.col, lambda c: F.col(c).isNotNull()
    used = sorted({c for parts in MIXES.values() for c, _ in parts} | {u for _, u, _ in CALIBRATED} | set(MIXES) | {"u_lifestyle", "u_family", "u_crime_violent", "u_crime_property"})
    bad = {f"{c} is outside [0, 1]": known(c) & (finite(col(c)).isNull() | (col(c) < 0) | (col(c) > 1)) for c in used}
    third = weighted_utility([(col(c), 1 / 3) for c in ("u_primary_care", "u_mental_health", "u_dental")])
    jobs = weighted_utility([(col("u_employment_growth"), 0.50), (col("u_average_weekly_wage"), 0.25), (col("u_commute_under_30"), 0.25)])
    mixes = {"u_healthcare": third, "u_employment": jobs, "u_lifestyle": col("u_mountain"), "u_family": col("homeschool_utility")} | {p: weighted_utility([(col(c), w) for c, w in parts]) for p, parts in MIXES.items()}
    bad |= {f"{c} drifted from its parts": _drift(col(c), v, 1e-9) for c, v in mixes.items()}
    direct = {
        "u_crime": 0.60 * col("u_crime_violent") + 0.40 * col("u_crime_property"), "u_hazard": 1.0 - col("res_hazard_npctl") / 100.0, "u_water": F.when(known("u_water"), 1.0 - col("water_violation_share")),
        "u_community_context": (10.0 - col("community_context")) / 9.0, "u_broadband": col("broadband_100_20"),
    }
    bad |= {f"{c} drifted from its measure": _drift(col(c), v, 1e-12) for c, v in direct.items()}
    short = lambda c, least: F.coalesce(col(c) < least, F.lit(True))
    covers = ["crime_coverage", *[f"crime_{f}_coverage_{y}" for f, _ in FAMILIES.values() for y in years]]
    bad["crime is scored below its coverage floor"] = known("u_crime") & functools.reduce(lambda a, b: a | b, [short(c, CRIME_FLOOR) for c in covers])
    bad["crime is scored without rates"] = known("u_crime") & (col("crime_violent_rate").isNull() | col("crime_property_rate").isNull())
    bad["water is scored below its allocation floor"] = known("u_water") & short("water_allocation_coverage", WATER_FLOOR)
    core = all_of([known(c) for c in CORE])
    bad["coverage status differs"] = col("coverage_status") != F.when(core, "complete_public_core").otherwise("partial_public_core")
    bad["climate without a station"] = (col("climate_station_count") <= 0) & functools.reduce(lambda a, b: a | b, [known(c) for c in CLIMATE_MEASURES])
    bad["population is not positive"] = short("population", 1)
    bad["county code"] = ~col("county_fips").rlike("^[0-9]{5}$")
    return {k: F.coalesce(v, F.lit(False)) for k, v in bad.items()}


def calibration_drift(frame: DataFrame, key: str = "county_fips") -> DataFrame:
    """``key, utility`` of every ranked utility that isn't what ranking its measure again gives (beyond 1e-12)."""
    pairs = (("crime_violent_rate", "u_crime_violent", True), ("crime_property_rate", "u_crime_property", True), *CALIBRATED)
    calibrated = written(frame.select(key, *[c for m, u, _ in pairs for c in (m, u)]), "calibrated")  # ranking reads it three times
    again = ecdfs(calibrated, key, {f"_{u}": (m, invert) for m, u, invert in pairs})
    moved = F.array_compact(F.array(*[F.when(_drift(finite(F.col(u)), F.col(f"_{u}"), 1e-12), F.lit(u)) for _, u, _ in pairs]))
    return again.select(key, F.explode(moved).alias("utility"))


def validate_counties(frame: DataFrame, years: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Fail on any drift: schema, keys, domains, floors, pillars (1e-9), measures and ranks (1e-12)."""
    if columns is not None and frame.columns != list(columns):
        raise ContractError(f"columns {frame.columns}, expected {list(columns)}")
    assert_none(assert_unique(frame, ["county_fips"]), drift_problems(years))
    bad = calibration_drift(frame).first()
    if bad is not None:
        raise ContractError(f"{bad.utility} calibration drifted for {bad.county_fips}")
    return frame

"""Two grains of places: both scored on their own, parents inherited, price levels assigned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import all_of, finite
from quernstone.operators.aggregates import pivot_codes
from quernstone.operators.contracts import ContractError, assert_none, assert_unique, join_preserving
from quernstone.operators.scores import availability, ensemble, normalised_raw, property_loss_percentile

UNKNOWN_STATE, UNKNOWN_COUNTY, UNKNOWN_NAME = "??", "00000", "Unknown County"


def state_of(code: Column, states: Mapping[str, str]) -> Column:
    """The state of a code by its first two digits."""
    table = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return F.coalesce(table[F.left(code, F.lit(2))], F.lit(UNKNOWN_STATE))


def with_columns_of(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` with these columns: missing ones null, all cast."""
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in columns.items()})


def score_hazards(places: DataFrame, key: str, hazards: Sequence[str], loss: str = "alr_valb") -> DataFrame:
    """``places`` with the ensemble of ``hazards``: a hazard h has its value in ``alrb_h`` and its rating in ``ealr_h``.

    Values that contradict their rating stay visible (see ``normalised_raw``).
    """
    names = {f"alrb_{h}": "double" for h in hazards} | {f"ealr_{h}": "string" for h in hazards}
    rows = with_columns_of(assert_unique(places, [key]), names | {loss: "double"})
    cells = F.array(*[F.struct(F.lit(h).alias("hazard"), F.col(f"alrb_{h}").alias("raw"), availability(F.col(f"alrb_{h}"), F.col(f"ealr_{h}")).alias("state")) for h in hazards])
    long = rows.select(key, F.explode(cells).alias("x")).select(key, "x.*")
    scored = ensemble(long, key, len(hazards)).select(
        key, F.col("score").alias("res_hazard_npctl"), F.col("spread").alias("res_hazard_spread"), F.col("available").alias("res_hazard_available_count"), F.col("quality").alias("res_hazard_data_quality"), F.col("coverage").alias("res_hazard_coverage_ratio"),
    )
    rows = rows.withColumns({f"alrb_{h}": normalised_raw(F.col(f"alrb_{h}"), F.col(f"ealr_{h}")) for h in hazards})
    return property_loss_percentile(rows.join(scored, key), loss, "property_loss_npctl")


def score_grains(tracts: DataFrame, counties: DataFrame, community: DataFrame, hazards: Sequence[str], states: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both grains scored among themselves; tracts take name and community group of the county that their code begins with.

    ``counties``: ``county_fips, county, county_type, state`` and measures; ``community``: ``county_fips, community_conditions_group``.
    A county's own state wins over the one of its code; tracts without a county get the unknown one.
    """
    kind, own = F.trim(F.coalesce("county_type", F.lit(""))), F.upper(F.trim(F.coalesce("state", F.lit(""))))
    name = F.when(kind != "", F.concat_ws(" ", F.trim("county"), kind)).otherwise(F.trim("county"))
    c = score_hazards(counties, "county_fips", hazards).withColumn("state", F.when(own != "", own).otherwise(state_of(F.col("county_fips"), states))).withColumn("name", name)
    c = join_preserving(c, community.select("county_fips", "community_conditions_group"), ["county_fips"]).withColumn("place_id", F.col("county_fips"))
    t = score_hazards(tracts, "tract_id", hazards).withColumn("_prefix", F.left("tract_id", F.lit(5))).withColumn("state", state_of(F.col("tract_id"), states))
    lookup = c.select(F.col("county_fips").alias("_prefix"), F.col("name").alias("_name"), "community_conditions_group")
    t = join_preserving(t, lookup, ["_prefix"])
    found = F.col("_name").isNotNull()
    t = t.withColumns({"county_fips": F.when(found, F.col("_prefix")).otherwise(UNKNOWN_COUNTY), "county_name": F.coalesce("_name", F.lit(UNKNOWN_NAME)), "place_id": F.col("tract_id"), "name": F.col("tract_id")})
    return t.drop("_prefix", "_name"), c


def price_levels(table: DataFrame, year: str, lines: Mapping[int, str], nonmetro: str, total: str = "00000") -> DataFrame:
    """``geography_id, geography_name`` and a column for each line code, one row a geography that has them all; the national total goes.

    ``table``: ``GeoFIPS, GeoName, TableName, Unit, LineCode`` and the year's values.
    """
    rows = table.where(F.col("LineCode").isin(list(lines))).select(
        F.regexp_replace("GeoFIPS", r'^[ "]+|[ "]+$', "").alias("geography_id"), F.regexp_replace(F.trim("GeoName"), r" \*$", "").alias("geography_name"), "TableName", "Unit", "LineCode", finite(F.col(f"`{year}`").cast("double")).alias("value"),
    )
    rows = assert_none(rows, {
        "another table or unit": (F.col("TableName") != "MARPP") | (F.col("Unit") != "Index"), "geography code": F.coalesce(~F.col("geography_id").rlike("^[0-9]{5}$"), F.lit(True)),
        "blank name": F.coalesce(F.col("geography_name") == "", F.lit(True)), "invalid value": F.coalesce(F.col("value") <= 0, F.lit(True)),
    })
    rows = assert_unique(rows, ["geography_id", "LineCode"]).where(F.col("geography_id") != total)
    assert_unique(rows.select("geography_id", "geography_name").distinct(), ["geography_id"])
    wide = pivot_codes(rows, ["geography_id", "geography_name"], "LineCode", list(lines), F.col("value"), "_").withColumnsRenamed({f"_{k}": v for k, v in lines.items()})
    wide = assert_none(wide, {"a line is missing": ~all_of([F.col(c).isNotNull() for c in lines.values()])})
    if wide.where(F.col("geography_id") == nonmetro).isEmpty():
        raise ContractError("no level for what lies outside metropolitan areas")
    return wide


def assign_price_levels(counties: DataFrame, metro_of: DataFrame, levels: DataFrame, nonmetro: str, in_scope: Sequence[str], outside: Sequence[str], state_levels: DataFrame | None = None) -> DataFrame:
    """Each county's level: of its metropolitan area, else the national one for the rest, or with ``state_levels`` its state's.

    ``metro_of``: ``county_fips, cbsa_id``; ``levels`` as from ``price_levels``; ``state_levels``: ``state_fips`` and the same columns.
    """
    values = [c for c in levels.columns if c != "geography_id"]
    rows = join_preserving(assert_unique(counties.select("county_fips"), ["county_fips"]), metro_of.select("county_fips", "cbsa_id"), ["county_fips"], "1:1")
    known = levels.where(F.col("geography_id") != nonmetro).select(F.col("geography_id").alias("cbsa_id"), F.lit(True).alias("_metro"))
    rows = join_preserving(rows, known, ["cbsa_id"]).withColumn("state_fips", F.left("county_fips", F.lit(2)))
    scope, metro = F.col("state_fips").isin(list(in_scope)), F.coalesce("_metro", F.lit(False))
    rows = rows.withColumns({
        "geography_id": F.when(scope, F.when(metro, F.col("cbsa_id")).otherwise(nonmetro)), "geography_type": F.when(scope, F.when(metro, "metropolitan").otherwise("nonmetropolitan")),
        "coverage_status": F.when(scope, "complete").when(F.col("state_fips").isin(list(outside)), "outside_scope").otherwise("unmatched_geography"),
    })
    rows = join_preserving(rows.drop("cbsa_id", "_metro"), levels, ["geography_id"])
    if state_levels is not None:
        own = state_levels.withColumnsRenamed({c: f"_{c}" for c in state_levels.columns if c != "state_fips"})
        rows = join_preserving(rows, own, ["state_fips"])
        rest = F.col("geography_type") == "nonmetropolitan"
        rows = rows.withColumns({c: F.when(rest, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("geography_id", *values)}).withColumn("geography_type", F.when(rest, "state").otherwise(F.col("geography_type")))
    rows = assert_none(rows, {"a county in scope has no level": (F.col("coverage_status") == "complete") & F.col(values[-1]).isNull()})
    return rows.select("county_fips", "geography_id", "geography_type", "coverage_status", *values)


def inherit_price_levels(tracts: DataFrame, assigned: DataFrame) -> DataFrame:
    """The county's level for each tract, whose code is the county's and six digits; without a county it is unmatched."""
    rows = assert_unique(tracts.select("tract_id"), ["tract_id"]).withColumn("county_fips", F.left("tract_id", F.length("tract_id") - 6))
    return join_preserving(rows, assigned, ["county_fips"]).withColumn("coverage_status", F.coalesce("coverage_status", F.lit("unmatched_geography")))

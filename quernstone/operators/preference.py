"""Preference evaluation of candidates by six pillars: views and presets, gates in order, two rankings, Pareto flags.

The score of a row depends on the view's weights alone. Reasons are decided in three stages, the first that holds wins:

A. ``missing_core`` (custom view: a pillar is unknown), ``crime_coverage`` (under ``CRIME_FLOOR`` or unknown), or
   ``missing_active`` (pillar view); then ``population`` (under ``POPULATION_FLOOR`` or unknown). Rows without a reason are the
   national candidates, ranked among themselves;
B. ``valid_months``, ``active_listings``, ``population`` (the user's floor);
C. ``state_filter``, ``state_exclusion``, ``region_exclusion``, ``climate``, then ``min_<pillar>`` in the pillars' order.

Who is left is ranked again and, in the custom view, flagged if no other one left dominates it.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import any_of, finite, weighted_utility
from quernstone.operators.ranks import competition_rank, pareto_flags
from quernstone.operators.scores import first_failing
from quernstone.sources.shared import written

#: Pillars in their order, presets in the same order, floors (fixed values).
PILLARS = ("safety", "health", "affordability", "opportunity", "lifestyle", "family")
PRESETS = {
    "balanced": (0.20, 0.15, 0.25, 0.15, 0.15, 0.10),
    "safety-health": (0.35, 0.25, 0.15, 0.10, 0.05, 0.10),
    "affordability": (0.15, 0.10, 0.45, 0.15, 0.05, 0.10),
    "mountain-lifestyle": (0.10, 0.10, 0.15, 0.10, 0.45, 0.10),
}
ALIASES = {"family-autonomy": "family", "custom-fit": "custom"}
POPULATION_FLOOR, CRIME_FLOOR, LEAST_LISTINGS, LEAST_MONTHS = 25_000, 0.90, 100, 9
#: Climate bounds: option to (measure, lower bound).
CLIMATE = {
    "min_jan_temp_f": ("jan_avg_temp_f", True),
    "max_jan_temp_f": ("jan_avg_temp_f", False),
    "min_jul_temp_f": ("jul_avg_temp_f", True),
    "max_jul_temp_f": ("jul_avg_temp_f", False),
    "max_extreme_heat_days": ("extreme_heat_days", False),
    "max_extreme_cold_days": ("extreme_cold_days", False),
}


class OptionError(ValueError):
    """An option is out of its domain."""


@dataclass
class Options:
    """What to evaluate. ``states`` and ``regions`` name the known states and the members of each region."""

    view: str = "custom"
    preset: str = "balanced"
    weights: Mapping[str, float | None] | None = None
    min_population: int | None = None
    min_active_listings: int | None = None
    min_valid_months: int | None = None
    include_states: Collection[str] = ()
    exclude_states: Collection[str] = ()
    exclude_region: str | None = None
    climate: Mapping[str, float | None] = field(default_factory=dict)
    min_pillars: Mapping[str, float] = field(default_factory=dict)
    limit: int | None = None
    states: Collection[str] = ()
    regions: Mapping[str, Collection[str]] = field(default_factory=dict)


def _add_up(weights: Mapping[str, float]) -> bool:
    return abs(sum((Decimal(str(v)) for v in weights.values()), Decimal(0)) - 1) <= Decimal("1e-12")


def view_weights(o: Options) -> tuple[str, dict[str, float]]:
    """The view's name and the weight of each pillar."""
    view = ALIASES.get(o.view.lower(), o.view.lower())
    if view not in (*PILLARS, "custom"):
        raise OptionError(f"unknown view {o.view}")
    if view != "custom":
        if o.weights is not None:
            raise OptionError("weights go with the custom view only")
        return view, {p: float(p == view) for p in PILLARS}
    if o.weights is None:
        if o.preset.lower() not in PRESETS:
            raise OptionError(f"preset must be one of {', '.join(PRESETS)}")
        return view, dict(zip(PILLARS, PRESETS[o.preset.lower()], strict=True))
    if set(o.weights) != set(PILLARS) or any(v is None for v in o.weights.values()):
        raise OptionError("weights must name all six pillars")
    weights = {p: float(o.weights[p]) for p in PILLARS}
    if not all(math.isfinite(v) and v >= 0 for v in weights.values()) or not _add_up(weights):
        raise OptionError("weights must be finite, not negative, and add up to 1")
    return view, weights


def check_options(o: Options) -> None:
    """Raise where an option is out of its domain."""
    if o.limit is not None and not 1 <= o.limit <= 500:
        raise OptionError("limit must be between 1 and 500")
    if o.min_population is not None and o.min_population < POPULATION_FLOOR:
        raise OptionError(f"min_population must be at least {POPULATION_FLOOR}")
    if o.min_active_listings is not None and o.min_active_listings < 0:
        raise OptionError("min_active_listings must not be negative")
    if o.min_valid_months is not None and not 1 <= o.min_valid_months <= 12:
        raise OptionError("min_valid_months must be between 1 and 12")
    if o.exclude_region is not None and o.exclude_region not in o.regions:
        raise OptionError(f"unknown region {o.exclude_region}")
    named = [str(s).strip().upper() for s in (*o.include_states, *o.exclude_states)]
    if o.states and (unknown := sorted(set(named) - set(o.states))):
        raise OptionError(f"unknown states {unknown}")
    if both := {s.strip().upper() for s in o.include_states} & {s.strip().upper() for s in o.exclude_states}:
        raise OptionError(f"states both included and excluded: {sorted(both)}")
    for name, bound in o.climate.items():
        if name not in CLIMATE:
            raise OptionError(f"unknown climate bound {name}")
        if bound is not None and (not math.isfinite(bound) or (name.endswith("_days") and bound < 0)):
            raise OptionError(f"{name} is out of its domain")
    for month in ("jan", "jul"):
        low, high = (o.climate.get(f"{side}_{month}_temp_f") for side in ("min", "max"))
        if low is not None and high is not None and low > high:
            raise OptionError("a climate minimum exceeds its maximum")
    for p, v in o.min_pillars.items():
        if p not in PILLARS or not 0 <= v <= 1:
            raise OptionError(f"bad minimum for {p}")


def _outside(climate: Mapping[str, float | None]) -> Column:
    """A bound that is set isn't met, or its measure is unknown; bounds are inclusive."""
    failed = [F.lit(False)]
    for name, (measure, lower) in CLIMATE.items():
        if (bound := climate.get(name)) is not None:
            value = finite(F.col(measure).cast("double"))
            failed.append(F.coalesce(value < bound if lower else value > bound, F.lit(True)))
    return any_of(failed)


def evaluate_places(candidates: DataFrame, o: Options | None = None, key: str = "place_id") -> DataFrame:
    """``key, active_value, eligible, reason, national_rank, filtered_rank, pareto_optimal``, a row for each candidate.

    Candidates have ``key, state, population, housing_valid_months, median_active_listings, crime_coverage``, a ``u_<pillar>`` for each
    pillar, and the climate measures. With ``limit`` only the best rows (ties by key) and the excluded ones are returned.
    """
    o = o or Options()
    view, weights = view_weights(o)
    check_options(o)
    custom = view == "custom"
    listings = LEAST_LISTINGS if custom and o.min_active_listings is None else o.min_active_listings
    months = LEAST_MONTHS if custom and o.min_valid_months is None else o.min_valid_months
    u = {p: finite(F.col(f"u_{p}").cast("double")) for p in PILLARS}
    short = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))  # noqa: E731  unknown is short
    if custom:
        core = [("missing_core", any_of([c.isNull() for c in u.values()])), ("crime_coverage", F.coalesce(finite(F.col("crime_coverage").cast("double")) < CRIME_FLOOR, F.lit(True)))]
        score = weighted_utility([(u[p], w) for p, w in weights.items()])
    else:
        core, score = [("missing_active", u[view].isNull())], u[view]
    stage_a = first_failing([*core, ("population", short("population", POPULATION_FLOOR))])
    later = []
    if months is not None:
        later.append(("valid_months", short("housing_valid_months", months)))
    if listings is not None:
        later.append(("active_listings", short("median_active_listings", listings)))
    if o.min_population is not None:
        later.append(("population", F.col("population") < o.min_population))
    include, exclude = ([s.strip().upper() for s in x] for x in (o.include_states, o.exclude_states))
    if include:
        later.append(("state_filter", F.coalesce(~F.col("state").isin(include), F.lit(True))))
    if exclude:
        later.append(("state_exclusion", F.col("state").isin(exclude)))
    if o.exclude_region is not None:
        later.append(("region_exclusion", F.col(key).isin(sorted(o.regions[o.exclude_region]))))
    later.append(("climate", _outside(o.climate)))
    later += [(f"min_{p}", F.coalesce(u[p] < o.min_pillars[p], F.lit(True))) for p in PILLARS if p in o.min_pillars]
    rows = candidates.withColumn("_a", stage_a).withColumn("_active", F.when(F.col("_a").isNull(), score))
    rows = rows.withColumn("reason", F.coalesce("_a", F.when(F.col("_a").isNull(), first_failing(later))))
    rows = rows.withColumn("_left", F.when(F.col("reason").isNull(), F.col("_active"))).withColumns({f"_u_{p}": F.when(F.col("reason").isNull(), c) for p, c in u.items()})
    rows = rows.select(key, F.col("_active").alias("active_value"), F.col("reason").isNull().alias("eligible"), "reason", "_left", *[f"_u_{p}" for p in PILLARS])
    # written once: two ranks and the front read it, and none of them evaluates reasons and scores again
    rows = written(rows, "evaluated")
    rows = competition_rank(competition_rank(rows, "active_value", "national_rank"), "_left", "filtered_rank")
    if custom:
        rows = pareto_flags(rows, key, [f"_u_{p}" for p in PILLARS], "_best").withColumn("pareto_optimal", F.when(F.col("eligible"), F.col("_best")))
    else:
        rows = rows.withColumn("pareto_optimal", F.lit(None).cast("boolean"))
    rows = rows.select(key, "active_value", "eligible", "reason", "national_rank", "filtered_rank", "pareto_optimal")
    if o.limit is not None:
        # at most `limit` rows; a competition rank within it doesn't bound them where rows tie
        best = rows.where("eligible").orderBy("filtered_rank", key).limit(o.limit)
        rows = best.unionByName(rows.where("not eligible"))
    return rows


def ranked_places(candidates: DataFrame, o: Options | None = None, key: str = "place_id", limit: int = 10) -> DataFrame:
    """The best ``limit`` (1 to 500) places of the custom view, by rank and key."""
    if not 1 <= limit <= 500:
        raise OptionError("limit must be between 1 and 500")
    rows = evaluate_places(candidates, o, key).where("eligible")
    return rows.orderBy("filtered_rank", key).limit(limit)


def evaluation_counts(evaluated: DataFrame) -> DataFrame:
    """One row: candidates, national candidates, those past stage B, those left; ``exclusions`` maps reasons to counts."""
    late = ["state_filter", "state_exclusion", "region_exclusion", "climate", *[f"min_{p}" for p in PILLARS]]
    by = evaluated.groupBy("reason").agg(F.count("*").alias("n"), F.count("national_rank").alias("national"))
    past = F.when(F.col("reason").isNull() | F.col("reason").isin(late), F.col("n")).otherwise(0)
    return by.agg(
        F.sum("n").alias("reference_count"), F.sum("national").alias("national_count"), F.sum(past).alias("eligible_count"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("filtered_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("exclusions"),
    )

"""Multi-hazard ensemble scores and the ordered preference evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import median_of_three, power_mean, spectral, weighted_utility, worst_mean
from quernstone.operators.ranks import average_tie_percentile, competition_rank
from quernstone.sources.shared import written

#: Ratings whose raw value counts (fixed values).
VALID_RATINGS = ("Very Low", "Relatively Low", "Relatively Moderate", "Relatively High", "Very High")
NO_LOSS, NOT_APPLICABLE, NO_DATA = "No Expected Annual Losses", "Not Applicable", "Insufficient Data"


def known_number(raw: Column) -> Column:
    """The value as a finite double; null for NaN and infinities."""
    d = raw.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def availability(raw: Column, rating: Column) -> Column:
    """valid, not_applicable, missing or invalid from a raw value and its rating.

    A rating that says there is a value needs a finite one of at least 0 ("no loss": exactly 0); "not applicable" and "no
    data" need none at all. Whatever contradicts its rating is invalid, NaN included.
    """
    number = known_number(raw)
    counts = F.when(number >= 0, "valid").otherwise("invalid")
    return (
        F.when(rating.isNull(), F.when(raw.isNull(), "missing").otherwise(counts))
        .when(rating == NOT_APPLICABLE, F.when(raw.isNull(), "not_applicable").otherwise("invalid"))
        .when(rating == NO_DATA, F.when(raw.isNull(), "missing").otherwise("invalid"))
        .when(rating == NO_LOSS, F.when(number == 0, "valid").otherwise("invalid"))
        .when(rating.isin(*VALID_RATINGS), counts)
        .otherwise("invalid")
    )


def normalised_raw(raw: Column, rating: Column) -> Column:
    """The number behind a valid state, and the number that contradicts a rating without one, so that it stays visible."""
    state, without = availability(raw, rating), availability(F.lit(None).cast("double"), rating)
    return F.when((state == "valid") | ((state == "invalid") & (without != "invalid")), known_number(raw))


def ensemble(long: DataFrame, key: str, hazards: int, digits: int | None = 9) -> DataFrame:
    """Ensemble score of ``long``: ``key, hazard, raw, state`` (state as from ``availability``).

    Per hazard average-tie percentiles (a raw 0 scores 0); hazards that don't apply score 0, missing ones are left out.
    Each key's list gives three aggregates, which are ranked again, all three in one pass; their median is ranked once
    more. Keys without any usable hazard have null scores and spread, and a ratio of 0.

    Values are rounded to ``digits`` before a rank, so that ties don't hang on the order in which floating sums are taken
    (with ``digits`` None they are ranked as they come).
    """
    cut = lambda c: c if digits is None else F.round(c, digits)
    # each step is read by a rank twice, so it is written: chained ranks would evaluate what is below them again and again
    long = written(long.select(key, "hazard", "raw", "state"), "hazards")
    valid = long.where(F.col("state") == "valid")
    scored = average_tie_percentile(valid, "raw", "p", by=["hazard"], force_zero=True).select(key, "p")
    none = long.where(F.col("state") == "not_applicable").select(key, F.lit(0.0).alias("p"))
    lists = scored.unionByName(none).groupBy(key).agg(F.sort_array(F.collect_list("p"), asc=False).alias("v"), F.count("*").alias("available"))
    three = F.array(*[F.struct(F.lit(n).alias("kind"), cut(f(F.col("v"))).alias("value")) for n, f in (("s", spectral), ("w", worst_mean), ("m", power_mean))])
    tall = lists.select(key, "available", F.explode(three).alias("x")).select(key, "available", "x.kind", "x.value")
    tall = written(tall, "aggregates")
    ranked = average_tie_percentile(tall, "value", "p", by=["kind"])
    own = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("p")))
    row = ranked.groupBy(key).agg(F.first("available").alias("available"), *[own(k).alias(f"{k}_p") for k in ("s", "w", "m")])
    parts = [F.col(f"{c}_p") for c in ("s", "w", "m")]
    row = row.withColumn("middle", cut(median_of_three(*parts))).withColumn("spread", F.greatest(*parts) - F.least(*parts))
    row = average_tie_percentile(written(row, "middles"), "middle", "score")
    out = long.select(key).distinct().join(row, key, "left")
    n = F.coalesce("available", F.lit(0))
    quality = F.when(n == hazards, "complete").when(n > 0, "partial").otherwise("unavailable")
    return out.select(key, F.col("s_p").alias("spectral_p"), F.col("w_p").alias("worst_p"), F.col("m_p").alias("power_p"), "spread", "score", n.cast("int").alias("available"), quality.alias("quality"), (n / F.lit(hazards)).alias("coverage"))


def property_loss_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-tie percentile of finite values of at least 0; a loss of 0 scores 0."""
    number = known_number(F.col(value))
    return average_tie_percentile(df.withColumn("_loss", F.when(number >= 0, number)), "_loss", out, force_zero=True).drop("_loss")


def first_failing(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null if none does (unknown conditions don't hold)."""
    return F.coalesce(*[F.when(c, F.lit(r)) for r, c in reasons])


def evaluate(candidates: DataFrame, key: str, weights: dict[str, float], base: Sequence[tuple[str, Column]], gates: Sequence[tuple[str, Column]], filters: Sequence[tuple[str, Column]]) -> DataFrame:
    """Weighted preference with ordered gates: ``key, score, reason, national_rank, filtered_rank``.

    ``base`` reasons decide who is a national candidate (ranked among themselves), ``gates`` then ``filters`` who is
    left (ranked again). Scores don't depend on gates.
    """
    if abs(sum(weights.values()) - 1) > 1e-12 or min(weights.values()) < 0:
        raise ValueError("weights must be non-negative and add up to 1")
    score = weighted_utility([(F.col(c), w) for c, w in weights.items()])
    missing = ("missing_core", F.expr(" or ".join(f"{c} is null" for c in weights)))
    rows = candidates.withColumn("_stage_a", first_failing([missing, *base])).withColumn("score", F.round(score, 9))
    later = first_failing([*gates, *filters])
    rows = rows.withColumn("reason", F.coalesce("_stage_a", F.when(F.col("_stage_a").isNull(), later)))
    rows = rows.withColumn("_national", F.when(F.col("_stage_a").isNull(), F.col("score"))).withColumn("_left", F.when(F.col("reason").isNull(), F.col("score")))
    rows = rows.select(key, "score", "reason", "_national", "_left")
    rows = competition_rank(rows, "_national", "national_rank")
    rows = competition_rank(rows, "_left", "filtered_rank")
    return rows.select(key, "score", "reason", "national_rank", "filtered_rank")

"""Exact quantiles of groups of any size, by distributed order statistics: no task holds a group's values."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.sources.shared import Scratch, written

#: Cuts of a bracket in each round; a bracket's rows fall to about 1 / CUTS of them.
CUTS = 64
#: Brackets (about 1 kB each) that are broadcast.
BROADCAST_BRACKETS = 20_000


def _same(names: Sequence[str]):
    out = F.lit(True)
    for c in names:
        out &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return out


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_BRACKETS else df


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """For each group (nulls are one) the columns of ``quantiles`` (name to share in [0, 1]): linear between neighbouring ranks.

    Null values don't count (NaN is above all numbers); a group without values gets nulls. Groups of at most ``most`` values are
    sorted whole. Of larger ones every round cuts the brackets that hold the wanted ranks at a sketch's quantiles, counts exactly
    how many values lie in each piece (values equal to a cut are a piece of their own, so a value that is a third of all rows ends at once)
    and keeps the piece that holds the rank. When a piece holds at most ``most`` values, those are sorted. So no task holds more
    than ``most`` values of a group, each round is one scan with map-side combining, and the sketch affects the number of rounds only.
    """
    with Scratch() as s:
        return s.keep(written(_exact(df, value, quantiles, list(by), most), "quantiles"))


def _exact(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str], most: int) -> DataFrame:
    v = F.col(value).cast("double")
    rows = written(df.select(*by, v.alias("_v")), "values")
    sizes = written(rows.groupBy(*by).agg(F.count("_v").alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > most)
    renamed = lambda d: d.withColumnsRenamed({c: f"_g_{c}" for c in by})
    n_large = large.count()
    if n_large:
        keys = _sized(renamed(large.select(*by)))
        small_rows = rows.join(keys, _same(by), "left_anti")
        rows = rows.where("_v is not null")
        if n_large < sizes.count():
            rows = written(rows.join(keys, _same(by), "left_semi"), "large")
    else:
        small_rows = rows
    # bounded by `most` values a group
    small = small_rows.groupBy(*by).agg(*[F.percentile("_v", F.lit(q)).alias(n) for n, q in quantiles.items()])
    if not n_large:
        return small
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    wanted = F.array_distinct(F.array(*[f(at(q)).cast("long") for q in quantiles.values() for f in (F.floor, F.ceil)]))
    # brackets: ranks wanted, counted within the bracket, whose values lie between low and high (both outside; null: no bound)
    live = large.select(*by, F.explode(wanted).alias("_rank")).select(*by, "_rank", F.col("_rank").alias("_local"), F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), F.lit(None).cast("array<double>").alias("_cuts"))
    first = rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)]), F.lit(CUTS * 20)).alias("_c"))
    live = live.alias("l").join(renamed(first).alias("f"), _same(by)).select(*by, "_rank", "_local", "_low", "_high", F.array_distinct("_c").alias("_cuts"))
    found: list[DataFrame] = []
    while True:
        live = written(live, "brackets")
        brackets = renamed(live.select(*by, "_low", "_high", "_cuts").dropDuplicates([*by, "_low", "_high"]))
        inside = _same(by) & (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high")))
        cut = rows.join(_sized(brackets), inside).select(*by, "_low", "_high", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_below"), F.array_contains("_cuts", F.col("_v")).alias("_is"), "_cuts")
        piece = [*by, "_low", "_high", "_below", "_is"]
        counts = cut.groupBy(*piece).agg(
            F.count("*").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_cuts").alias("_was"),
            F.percentile_approx("_v", F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)]), F.lit(CUTS * 20)).alias("_next"),
        )
        # at most 2 * CUTS + 3 pieces of a bracket
        order = Window.partitionBy(*by, "_low", "_high").orderBy("_below", "_is").rowsBetween(Window.unboundedPreceding, -1)
        counts = written(counts.withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0))), "pieces")
        right = counts.withColumnsRenamed({c: f"_g_{c}" for c in by}).withColumnsRenamed({"_low": "_plow", "_high": "_phigh"})
        held = _same(by) & F.col("_low").eqNullSafe(F.col("_plow")) & F.col("_high").eqNullSafe(F.col("_phigh")) & (F.col("_local") >= F.col("_before")) & (F.col("_local") < F.col("_before") + F.col("_m"))
        chosen = live.drop("_cuts").join(right, held)
        edge = lambda i: F.when((i >= 1) & (i <= F.size("_was")), F.element_at("_was", F.greatest(F.least(i, F.size("_was")), F.lit(1))))
        chosen = chosen.select(*by, "_rank", (F.col("_local") - F.col("_before")).alias("_local"), "_m", "_min", "_max", "_is",
                               F.coalesce(edge(F.col("_below")), F.col("_low")).alias("_low"), F.coalesce(edge(F.col("_below") + 1), F.col("_high")).alias("_high"), F.array_distinct("_next").alias("_cuts"))
        chosen = written(chosen, "chosen")
        found.append(chosen.where("_min = _max").select(*by, "_rank", F.col("_min").alias("_value")))
        rest = chosen.where("_min <> _max")
        few = rest.where(F.col("_m") <= most)
        if not few.isEmpty():
            ends = renamed(few.select(*by, "_low", "_high").distinct())
            values = rows.join(_sized(ends), inside).groupBy(*by, "_low", "_high").agg(F.sort_array(F.collect_list("_v")).alias("_s"))  # at most `most` values
            got = renamed(values).withColumnsRenamed({"_low": "_plow", "_high": "_phigh"})
            picked = few.join(got, _same(by) & F.col("_low").eqNullSafe(F.col("_plow")) & F.col("_high").eqNullSafe(F.col("_phigh")))
            found.append(written(picked.select(*by, "_rank", F.element_at("_s", (F.col("_local") + 1).cast("int")).alias("_value")), "picked"))
        live = rest.where(F.col("_m") > most).select(*by, "_rank", "_local", "_low", "_high", "_cuts")
        if live.isEmpty():
            break
    ranked = functools.reduce(DataFrame.unionByName, found).withColumnsRenamed({c: f"_g_{c}" for c in by})
    picked = large.join(ranked, _same(by))
    shown = []
    for n, q in quantiles.items():
        low, high = (F.max(F.when(F.col("_rank") == f(at(q)).cast("long"), F.col("_value"))) for f in (F.floor, F.ceil))
        share = F.max(at(q) - F.floor(at(q)))
        shown.append(F.when(share == 0, low).otherwise(low + share * (high - low)).alias(n))
    return small.unionByName(picked.groupBy(*by).agg(*shown)) if by else picked.agg(*shown)

"""Scores made a second time by another algorithm, and compared with those at hand: an oracle that runs with the build.

``domain.block_scores`` reduces rows to distinct values in buckets and sums integers. Here values and calibrating weights are merged
into one sorted run, a score is the weight before its insertion point, and rounding goes through decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.contracts import ContractError
from quernstone.operators.numbering import accumulated, numbered
from quernstone.sources.shared import written


def reconstructed_scores(blocks: DataFrame, key: str, weight: str, parts: dict[str, float], scope: Column) -> DataFrame:
    """``key``, ``<part>_pct`` and ``composite`` as ``domain.block_scores`` defines them, out of one sorted merge of all parts.

    Each value comes twice: to be placed, and, where it calibrates, with its weight behind all equal values; so the running
    weight at a placed value is that of the smaller ones.
    """
    noise = lambda c: F.when(F.col(c).between(-1e-9, 0), F.lit(0.0)).otherwise(F.col(c).cast("double"))
    zero = F.lit(0).cast("decimal(28,6)")
    w = F.when(scope & (F.col(weight) > 0), F.col(weight).cast("decimal(28,6)")).otherwise(zero)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), noise(c).alias("v")) for c in parts]))
    long = blocks.where(scope).select(F.col(key).alias("key"), w.alias("w"), cells.alias("x")).select("key", "w", "x.*").where("v is not null")
    asked = long.select("name", "v", F.lit(0).alias("last"), "key", zero.alias("w"))
    weights = long.where("w > 0").groupBy("name", "v").agg(F.sum("w").cast("decimal(28,6)").alias("w")).select("name", "v", F.lit(1).alias("last"), F.lit(None).cast(dict(long.dtypes)["key"]).alias("key"), "w")
    run = accumulated(written(asked.unionByName(weights), "merge"), ["v", "last", "key"], {"below": "w"}, by=["name"])
    share = F.bround(100.0 * F.col("below").cast("double") / F.col("below_all").cast("double"), 2)
    placed = run.where("last = 0").select("key", "name", F.when(F.col("below_all") > 0, share).alias("p"))
    wide = placed.groupBy("key").agg(*[F.max(F.when(F.col("name") == c, F.col("p"))).alias(f"{c}_pct") for c in parts])
    mixed = sum((F.col(f"{c}_pct").cast("decimal(9,2)") * F.lit(p).cast("decimal(4,2)") for c, p in parts.items()), F.lit(0).cast("decimal(9,4)"))
    out = blocks.select(F.col(key).alias("_k")).join(wide, F.col("_k") == F.col("key"), "left")
    return out.select(F.col("_k").alias(key), *[f"{c}_pct" for c in parts], F.bround(mixed, 2).cast("double").alias("composite"))


def reconstructed_areas(scored: DataFrame, by: str, weight: str, scope: Column) -> DataFrame:
    """``by, covered, base_micros, magnitude`` as ``domain.aggregate_blocks`` defines them; ``scored`` has ``composite``'s ``units``.

    Bases are decimal quotients; the tail of the magnitude is counted by row numbers in order of the base.
    """
    known = F.col("units").isNotNull()
    g = scored.groupBy(by).agg(F.bool_and(scope).alias("inside"), F.sum(F.when(known, F.col("units") * F.col(weight))).cast("decimal(30,0)").alias("top"), F.sum(F.when(known, F.col(weight)).otherwise(0)).cast("decimal(20,0)").alias("cov"), F.sum(weight).cast("decimal(20,0)").alias("total"))
    covered = F.round(F.when(F.col("total") > 0, F.col("cov").cast("double") / F.col("total").cast("double")).otherwise(0.0), 6)
    ok = F.col("inside") & (covered >= 0.9) & (F.col("cov") > 0)
    # twice the quotient, whole, and what is left: half to even without doubles
    whole, rest = F.floor(F.col("top") * 100 / F.col("cov")), (F.col("top") * 100) % F.col("cov")
    base = whole + F.when(rest * 2 > F.col("cov"), 1).when((rest * 2 == F.col("cov")) & (whole % 2 != 0), 1).otherwise(0)
    b = written(g.select(by, F.col("cov").cast("long").alias("covered"), F.when(ok, base).cast("long").alias("base_micros")), "areas")
    ranked = numbered(b.where("base_micros is not null"), ["base_micros", by], "_n", total="_all")
    first = ranked.groupBy("base_micros").agg(F.min("_n").alias("_first"), F.max("_all").alias("_all"))
    size = F.bround(F.log10(F.col("_all") / (F.col("_all") - F.col("_first") + 1)), 4)
    ends = first.select(F.col("base_micros").alias("_b"), size.alias("magnitude"))
    return b.join(ends, F.col("base_micros") == F.col("_b"), "left").select(by, "covered", "base_micros", "magnitude")


def differences(built: DataFrame, again: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """``key, column, built, again`` where two tables differ: by more than the tolerance, in what is known, or in whether there is a row.

    One row for each differing value; equal tables give none. Keys must be unique; null keys meet each other.
    """
    a = built.select(F.col(key).alias("_a"), F.lit(True).alias("_ina"), *[F.col(c).cast("double").alias(f"_a_{c}") for c in tolerances])
    b = again.select(F.col(key).alias("_b"), F.lit(True).alias("_inb"), *[F.col(c).cast("double").alias(f"_b_{c}") for c in tolerances])
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full")
    lone = F.col("_ina").isNull() | F.col("_inb").isNull()

    def cell(c: str, tolerance: float) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        apart = F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) | (x.isNull() != y.isNull())
        return F.when(lone | apart, F.struct(F.lit(c).alias("column"), x.alias("built"), y.alias("again")))

    cells = F.explode(F.array_compact(F.array(*[cell(c, v) for c, v in tolerances.items()])))
    return both.select(F.coalesce("_a", "_b").alias(key), cells.alias("x")).select(key, "x.*")


def assert_reconstructed(built: DataFrame, again: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """``built``, if the second algorithm agrees; else an error with the first difference."""
    if (bad := differences(built, again, key, tolerances).first()) is not None:
        raise ContractError(f"{bad[key]}: {bad['column']} is {bad['built']}, made again {bad['again']}")
    return built


def permuted(df: DataFrame, seed: int, partitions: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The same rows in an order that only ``seed`` decides, dealt to ``partitions`` otherwise than they were."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns or df.columns])
    return df.repartition(partitions, order).sortWithinPartitions(order)

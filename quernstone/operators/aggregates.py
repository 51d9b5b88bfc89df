"""Population-weighted and contract-style aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import half_even
from quernstone.operators.quantiles import exact_quantiles


def weighted_means(df: DataFrame, by: Sequence[str], weight: str, columns: dict[str, int]) -> DataFrame:
    """Means of ``columns`` (name to digits) weighted by ``weight`` over the rows where each is known.

    Null if no weight is left. Sums are decimals, so results don't hang on the order of rows.
    """
    aggs: list[Column] = [F.sum(F.col(weight).cast("decimal(20,4)")).alias("_w")]
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col(weight)).cast("decimal(20,4)")
        aggs += [F.sum(F.col(c).cast("decimal(16,4)") * F.col(weight).cast("decimal(14,4)")).alias(f"_{c}_s"), F.sum(known).alias(f"_{c}_w")]
    out = df.groupBy(*by).agg(*aggs)
    mean = {c: half_even(F.col(f"_{c}_s").cast("double") / F.nullif(F.col(f"_{c}_w"), F.lit(0)).cast("double"), d) for c, d in columns.items()}
    cover = {f"{c}_coverage": F.coalesce(F.col(f"_{c}_w"), F.lit(0)).cast("double") / F.nullif(F.col("_w"), F.lit(0)).cast("double") for c in columns}
    return out.select(*by, *[v.alias(k) for k, v in {**mean, **cover}.items()])


def coverage_status(in_scope: Column, total: Column, ratio: Column) -> Column:
    """outside_scope, zero_population, complete (from 1 - 1e-9), partial (from 0.9) or insufficient_coverage, in this order.

    ``total`` is the weight of all rows, ``ratio`` the share of it that is covered (0 without any).
    """
    return (
        F.when(~in_scope, "outside_scope")
        .when(total == 0, "zero_population")
        .when(ratio >= 1 - 1e-9, "complete")
        .when(ratio >= 0.9, "partial")
        .otherwise("insufficient_coverage")
    )


def half_even_quotient(top: Column, below: Column) -> Column:
    """Integer quotient rounded half to even, for non-negative longs: never through doubles."""
    q, r = F.call_function("div", top, below), top % below
    up = (2 * r > below) | ((2 * r == below) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def conditional_counts(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).cast("long").alias(n) for n, c in conditions.items()])


def pivot_codes(df: DataFrame, by: Sequence[str], code: str, codes: Sequence, value: Column, prefix: str) -> DataFrame:
    """Long to wide on known codes; at most one value for each cell is expected, the smallest is taken."""
    return df.groupBy(*by).agg(*[F.min(F.when(F.col(code) == k, value)).alias(f"{prefix}{k}") for k in codes])


def max_then_sum(df: DataFrame, unit: Sequence[str], by: Sequence[str], value: Column, out: str) -> DataFrame:
    """Overlapping records of a unit count once, with their largest value; units add up within ``by``."""
    return df.groupBy(*dict.fromkeys((*unit, *by))).agg(F.max(value).alias("_m")).groupBy(*by).agg(F.sum("_m").alias(out))


def status_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` of several columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def calendar_window(df: DataFrame, month: str, months: int = 12) -> DataFrame:
    """Rows of the ``months`` calendar months (text yyyy-MM) that end with the latest month of the table."""
    last = df.agg(F.max(month).alias("last")).select(F.col("last"), F.date_format(F.add_months(F.to_date(F.concat("last", F.lit("-01"))), 1 - months), "yyyy-MM").alias("first"))
    return df.join(F.broadcast(last), F.col(month).between(F.col("first"), F.col("last"))).select(*df.columns)  # one row


def trailing_medians(df: DataFrame, key: str, month: str, value: str, months: int = 12) -> DataFrame:
    """Per key over the ``months`` calendar months that end with the latest month of the table: median and months seen."""
    rows = calendar_window(df, month, months)
    seen = rows.groupBy(F.col(key).alias("_key")).agg(F.count_distinct(month).alias("months"))
    return exact_quantiles(rows, value, {"median": 0.5}, by=[key]).join(seen, F.col(key).eqNullSafe(F.col("_key"))).select(key, "median", "months")

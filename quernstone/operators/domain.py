"""Compound operators: markets, stocks, block scores, pillars, coverage validators."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import any_of, finite, half_even, knot_utility, linear_clamp, sum_ignoring_nulls, weighted_utility
from quernstone.operators.aggregates import calendar_window, coverage_status, half_even_quotient
from quernstone.operators.contracts import ContractError, assert_unique
from quernstone.operators.ranks import ecdfs, inclusive_tail_magnitude, max_rank_percentile, weighted_lower_percentiles


def sentinels_to_null(c: Column, sentinels: Sequence[float]) -> Column:
    """Published stand-ins for missing values become null."""
    return F.when(c.isin(*sentinels), None).otherwise(c)


def shares(parts: dict[str, Column], total: Column, digits: int) -> dict[str, Column]:
    """Percentages of a total; null where it is null or zero."""
    return {k: half_even(100.0 * c / F.nullif(total, F.lit(0)), digits) for k, c in parts.items()}


def stock_status(total: Column, known: Column) -> Column:
    return F.when(total.isNull(), "missing").when(total == 0, "zero_total").when(~known, "missing").otherwise("complete")


def stock_problems(total: Column, parts: Sequence[Column], median_year: Column, release: int) -> dict[str, Column]:
    """What no published stock may show (for ``contracts.assert_none``): negatives, parts beyond their total, years out of range."""
    rest = any_of([c < 0 for c in (total, *parts)])
    return {
        "negative": F.coalesce(rest, F.lit(False)),
        "parts_beyond_total": F.coalesce(sum_ignoring_nulls(parts) > total, F.lit(False)),
        "median_year": F.coalesce((median_year < 1800) | (median_year > release), F.lit(False)),
    }


def market_normalise(df: DataFrame, key: str, price: str, quality: Column, budget: float = 1e6) -> DataFrame:
    """``key, area, percentile, status``: how much a budget buys, its max-rank percentile among eligible rows, and why not."""
    status = F.when(~quality, "quality").when(F.col(price).isNull() | (F.col(price) <= 0), "invalid_price").otherwise("complete")
    rows = df.select(key, status.alias("status"), F.col(price).alias("_p")).withColumn("area", F.when(F.col("status") == "complete", budget / F.col("_p")))
    return max_rank_percentile(rows, "area", "percentile").select(key, half_even(F.col("area"), 0).alias("area"), "percentile", "status")


def market_year(history: DataFrame, key: str, month: str, price: str, listings: str, quality_flag: str, months: int = 12, budget: float = 1e6) -> DataFrame:
    """``key, valid_months, median_listings, median_price, area`` over the months that end with the latest one of the table.

    A month of a key counts if its quality flag is 0, its price is finite and above 0 and its listings are finite and
    not negative; ``area`` is what the budget buys at the median price.
    """
    p, n = finite(F.col(price).cast("double")), finite(F.col(listings).cast("double"))
    rows = calendar_window(history, month, months).where((F.col(quality_flag) == 0) & (p > 0) & (n >= 0))
    out = rows.groupBy(key).agg(F.count_distinct(month).alias("valid_months"), F.median(n).alias("median_listings"), F.median(p).alias("median_price"))
    return out.withColumn("area", budget / F.col("median_price"))


def distinct_months(releases: DataFrame, month: str, digest: str) -> DataFrame:
    """One release for each month; a month that comes with different digests fails."""
    bad = releases.groupBy(month).agg(F.count_distinct(digest).alias("kinds")).where("kinds > 1").first()
    if bad is not None:
        raise ContractError(f"month {bad[0]} has conflicting contents")
    return releases.dropDuplicates([month])


def block_scores(blocks: DataFrame, key: str, weight: str, parts: dict[str, float], scope: Column) -> DataFrame:
    """Weighted lower-rank percentile of each part over calibrating rows and their composite, half-even to 2 digits.

    Parts just under 0 (to -1e-9) are noise and count as 0. ``units``: the composite in ten-thousandths, exact.
    """
    rows = blocks.withColumn("_in", scope).withColumns({c: F.when(F.col("_in"), F.when(F.col(c).between(-1e-9, 0), 0).otherwise(F.col(c))) for c in parts})
    rows = weighted_lower_percentiles(rows, key, weight, {f"{c}_pct": c for c in parts})
    # percentiles are whole hundredths: the composite is summed in integers
    units = sum((F.rint(F.col(f"{c}_pct") * 100).cast("long") * round(w * 100) for c, w in parts.items()), F.lit(0))
    return rows.select(key, *[f"{c}_pct" for c in parts], (half_even_quotient(units, F.lit(100)) / 100.0).alias("composite"), units.alias("units"))


def block_problems(parts: Sequence[str], shares: Sequence[str] = ()) -> dict[str, Column]:
    """Raw parts that aren't finite or are negative, and shares above 1 (for ``contracts.assert_none``); noise of 1e-9 passes."""
    bad = {c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | (F.col(c) < -1e-9) for c in parts}
    bad |= {c: bad[c] | (F.col(c) > 1 + 1e-9) for c in shares}
    return {f"invalid {c}": F.coalesce(v, F.lit(False)) for c, v in bad.items()}


def scored_coverage(scored: DataFrame, by: str, weight: str, score: str, scope: Column) -> DataFrame:
    """``area, coverage``: share of the weight in scope that is scored, in each group and in all (``area`` null)."""
    rows = scored.where(scope & (F.col(weight) > 0)).groupBy(by).agg(F.sum(weight).alias("_all"), F.sum(F.when(F.col(score).isNotNull(), F.col(weight)).otherwise(0)).alias("_known"))
    every = rows.agg(F.lit(None).cast(dict(scored.dtypes)[by]).alias(by), F.sum("_all").alias("_all"), F.sum("_known").alias("_known"))
    return rows.unionByName(every).select(F.col(by).alias("area"), F.coalesce(F.try_divide(F.col("_known"), F.col("_all")), F.lit(0.0)).alias("coverage"))


def gate_coverage(scored: DataFrame, by: str, weight: str, score: str, scope: Column, least: float = 0.995) -> DataFrame:
    """Fail unless the scored share reaches ``least`` in all and in every group."""
    bad = scored_coverage(scored, by, weight, score, scope).where(F.col("coverage") + 1e-12 < least).first()
    if bad is not None:
        raise ContractError(f"{bad['area'] if bad['area'] is not None else 'all'}: scored share {bad['coverage']:.3%} is below {least:.3%}")
    return scored


def aggregate_blocks(scored: DataFrame, by: Sequence[str], weight: str, scope: Column, means: dict[str, int] | None = None) -> DataFrame:
    """Per area: base in micros (exact integers), coverage, status, weighted means, and the inclusive-tail magnitude of the bases.

    ``scored`` has ``units`` (see ``block_scores``). Areas out of scope or with less than 0.9 of their weight scored have
    neither base nor means, and are no peers of the magnitude. ``means``: columns to digits, over rows where they are known.
    """
    w, known = F.col(weight), F.col("units").isNotNull()
    exact = lambda c, p, s: F.col(c).cast(f"decimal({p},{s})")
    sums = [F.bool_and(scope).alias("_in"), F.sum(F.when(known, F.col("units") * w)).alias("_top"), F.sum(F.when(known, w).otherwise(0)).alias("covered"), F.sum(w).alias("total")]
    for c in means or {}:
        sums += [F.sum(exact(c, 16, 4) * exact(weight, 14, 4)).alias(f"_{c}_s"), F.sum(F.when(F.col(c).isNotNull(), w).otherwise(0)).alias(f"_{c}_w")]
    g = scored.groupBy(*by).agg(*sums)
    ratio = F.round(F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0), 6)
    g = g.withColumn("coverage", ratio).withColumn("_ok", F.col("_in") & (F.col("coverage") >= 0.9) & (F.col("covered") > 0))
    base = F.when(F.col("_ok"), half_even_quotient(F.col("_top") * 100, F.greatest(F.col("covered"), F.lit(1))))
    mean = [F.when(F.col("_ok"), half_even(F.col(f"_{c}_s").cast("double") / F.nullif(F.col(f"_{c}_w"), F.lit(0)).cast("double"), d)).alias(c) for c, d in (means or {}).items()]
    out = g.select(*by, "total", "covered", "coverage", coverage_status(F.col("_in"), F.col("total"), F.col("coverage")).alias("status"), base.alias("base_micros"), *mean)
    return inclusive_tail_magnitude(out, "base_micros", "magnitude")


def calibrate(df: DataFrame, key: str, utilities: dict[str, tuple[str, bool]]) -> DataFrame:
    """Utility columns: name to (measure, lower is better), average-tie ECDF over known values, all in one pass."""
    return ecdfs(df, key, utilities)


def pillars(df: DataFrame, mixes: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted mixes; one unknown part makes a pillar unknown. With the number of known pillars."""
    made = {p: weighted_utility([(F.col(c), w) for c, w in mix.items()]) for p, mix in mixes.items()}
    return df.withColumns(made).withColumn("known_pillars", sum((F.col(p).isNotNull().cast("int") for p in mixes), F.lit(0)))


def housing_utility(value: Column, months: Column, knots: Sequence[tuple[float, float]], least_months: int = 9) -> Column:
    return F.when(months >= least_months, knot_utility(value, knots))


def climate_utility(value: Column, low: float, high: float) -> Column:
    return linear_clamp(value, low, high)


def month_sets(series: DataFrame, key: str, month: str, expected: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Keys whose months aren't exactly the expected ones: ``key, missing, surplus``. ``keys`` lists keys that must have a series."""
    want = F.array(*map(F.lit, sorted(expected)))
    have = series.groupBy(key).agg(F.array_sort(F.collect_set(month)).alias("have"))
    if keys is not None:
        have = keys.select(key).distinct().join(have, key, "full").select(key, F.coalesce("have", F.array().cast("array<string>")).alias("have"))
    out = have.select(key, F.size(F.array_except(want, F.col("have"))).alias("missing"), F.size(F.array_except(F.col("have"), want)).alias("surplus"))
    return out.where("missing > 0 or surplus > 0")


def attribution(county: Column, known: Column) -> Column:
    """Why a record can't be attributed to one area; null if it can."""
    return F.when(county.contains(","), "multiple").when(county.isNull() | (F.trim(county) == ""), "missing").when(~known, "unassignable")


def assert_one_area(records: DataFrame, key: str, area: str, reason: str) -> DataFrame:
    """Fail if a key is attributed to several areas, or both attributed and excluded."""
    g = records.groupBy(key).agg(F.count_distinct(area).alias("areas"), F.max(F.col(reason).isNull()).alias("kept"), F.max(F.col(reason).isNotNull()).alias("out"))
    bad = g.where("areas > 1 or (kept and out)").first()
    if bad is not None:
        raise ContractError(f"{bad[key]} has conflicting attributions")
    return records


def fold_to_ascii(c: Column) -> Column:
    """Letters without their marks, as compatibility decomposition leaves them; the table comes from the character database."""
    plain = {}
    for code in range(0x80, 0x2500):
        ch = chr(code)
        got = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if got:
            plain[ch] = got
    one = {k: v for k, v in plain.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in plain.items():
        if len(v) > 1 and k.isalpha() and k == k.upper():
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def normalised_name(c: Column) -> Column:
    """Upper case in ASCII, ampersands as AND, no punctuation, area suffix or space."""
    t = F.regexp_replace(fold_to_ascii(F.upper(c)), "&", " AND ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9 \t\n\r]", ""), r"\s+", " "))
    t = F.regexp_replace(t, r" (CITY AND BOROUGH|CENSUS AREA|MUNICIPALITY|BOROUGH|PARISH|COUNTY)$", "")
    return F.replace(t, F.lit(" "), F.lit(""))


def name_crosswalk(areas: DataFrame, state: str, name: str, code: str) -> DataFrame:
    """``state, name_key, code``, which must be one to one."""
    out = areas.select(state, normalised_name(F.col(name)).alias("name_key"), code)
    if not out.where("name_key = '' or name_key is null").isEmpty():
        raise ContractError("a name is empty")
    return assert_unique(assert_unique(out, [state, "name_key"]), [code])


def place_weights(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Each row's share of its group; shares of a group add up to 1."""
    total = F.sum(F.col(value).cast("decimal(20,4)")).over(Window.partitionBy(*by))
    return df.withColumn("weight", F.col(value).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))


def gate_expectations(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Fail unless rows and sums of every group equal ``expected`` (``by, rows, total``)."""
    have = df.groupBy(by).agg(F.count("*").alias("rows"), F.sum("total").alias("total"))
    if not have.exceptAll(expected).unionAll(expected.exceptAll(have)).isEmpty():
        raise ContractError(f"{by}: counts or totals differ from the expected ones")
    return df


def top_and_ineligible(evaluated: DataFrame, rank: str, reason: str, limit: int) -> DataFrame:
    """The best ``limit`` ranks, and every row that was excluded."""
    return evaluated.where((F.col(rank) <= limit) | F.col(reason).isNotNull())


def split_codes(df: DataFrame, codes: str, out: str, sep: str = ",") -> DataFrame:
    """One row for each code of a list in text, white space aside; empty codes are left out."""
    return df.withColumn(out, F.explode(F.split(F.regexp_replace(codes, r"\s+", ""), sep))).where(F.col(out) != "")

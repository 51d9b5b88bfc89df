"""Key-based enrichment: inheritance with fallbacks, reconciliation of changed codes, allocation of totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.contracts import ContractError, assert_unique


def inherit(child: DataFrame, parent: DataFrame, on: Sequence[str], fallbacks: dict[str, str]) -> DataFrame:
    """Many-to-one inheritance: parent columns, with fallbacks where no parent matches or its value is null."""
    assert_unique(parent, on)
    return child.join(parent, list(on), "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fallbacks.items()})


def attach_with_status(base: DataFrame, release: DataFrame, on: Sequence[str], in_scope: Column, status: str) -> DataFrame:
    """Left join and why a row has no values: complete, outside_scope or unmatched."""
    assert_unique(release, on)
    out = base.join(release.withColumn("_present", F.lit(True)), list(on), "left")
    return out.withColumn(status, F.when(~in_scope, "outside_scope").when(F.col("_present"), "complete").otherwise("unmatched")).drop("_present")


def missing_keys(keys: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(table, list(on), "left_anti")


def reconcile_codes(old: DataFrame, new: DataFrame, old_key: Column, new_key: Column, allowed_missing: Sequence = ()) -> tuple[DataFrame, DataFrame]:
    """Match on derived keys: (matched pairs, old rows without a match). Ambiguous keys and unexpected gaps fail."""
    a, b = old.withColumn("_k", old_key), new.withColumn("_k", new_key)
    assert_unique(a, ["_k"])
    assert_unique(b, ["_k"])
    gone = a.join(b, "_k", "left_anti")
    if allowed_missing:
        # the gaps must be exactly the allowed ones (a fixed list)
        found = {r["_k"] for r in gone.select("_k").limit(len(set(allowed_missing)) + 1).collect()}
        if found != set(allowed_missing):
            raise ContractError(f"keys without a match: {sorted(map(str, found))}, expected {sorted(map(str, set(allowed_missing)))}")
    return a.join(b, "_k").drop("_k"), gone.drop("_k")


def first_known(df: DataFrame, out: str, source: str, choices: Sequence[tuple[str, Column]]) -> DataFrame:
    """The first non-null choice, and its name."""
    return df.withColumns({out: F.coalesce(*[c for _, c in choices]), source: F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choices])})


def allocate(parts: DataFrame, unit: Sequence[str], share_of: Column, total: Column, out: str, digits: int = 2) -> DataFrame:
    """Split a unit's total over its rows in proportion to exact decimal shares."""
    w = Window.partitionBy(*unit)
    d = share_of.cast("decimal(18,2)")
    ratio = d.cast("double") / F.nullif(F.sum(d).over(w), F.lit(0)).cast("double")
    return parts.withColumn(out, F.round(total * ratio, digits))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fallback_value(own: Column, in_scope: Column, wide: Column) -> tuple[Column, Column]:
    """A local value where there is one, else a wider area's; and the status for each."""
    value = F.when(in_scope, F.coalesce(own, wide))
    status = F.when(~in_scope, "outside_scope").when(own.isNotNull(), "local").when(wide.isNotNull(), "wider").otherwise("unmatched")
    return value, status

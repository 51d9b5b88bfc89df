"""Contracts that fail closed: unique keys, row-preserving joins, schemas, forbidden rows, multiset equality, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks a contract."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on several rows; nulls count as values."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if (bad := duplicate_keys(df, keys).first()) is not None:
        raise ContractError(f"{keys} is not unique: {bad.asDict()}")
    return df


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Names, order and types exactly; nullability is not compared."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        raise ContractError(f"schema {have}, expected {want}")
    return df


def assert_none(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """All conditions in one pass; raises with the first that any row meets."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in bad.items()]).first().asDict()
    for name in bad:
        if counts[name]:
            raise ContractError(f"{name}: {counts[name]} rows")
    return df


def join_preserving(left: DataFrame, right: DataFrame, on: Sequence[str], cardinality: str = "m:1", hint: str | None = None) -> DataFrame:
    """Left join that keeps the left rows: no shared other columns, the right keys unique, for 1:1 the left ones too.

    ``hint``: how to join (``merge``: by a shuffle, however small the right side's files are).
    """
    if cardinality not in ("m:1", "1:1"):
        raise ValueError(cardinality)
    if shared := (set(left.columns) & set(right.columns)) - set(on):
        raise ContractError(f"columns on both sides: {sorted(shared)}")
    assert_unique(right, on)
    if cardinality == "1:1":
        assert_unique(left, on)
    return left.join(right.hint(hint) if hint else right, list(on), "left")


def key_sets(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: distinct keys of ``a`` only, of ``b`` only, and of both (nulls are keys)."""
    side = lambda df, n: df.select(*on).distinct().withColumn("_s", F.lit(n))
    g = side(a, 1).unionAll(side(b, 2)).groupBy(*on).agg(F.sum("_s").alias("_s"))
    return g.agg(*[F.count_if(F.col("_s") == k).alias(n) for k, n in ((1, "left_only"), (2, "right_only"), (3, "both"))])


def assert_keys(a: DataFrame, b: DataFrame, on: Sequence[str], relation: str) -> None:
    """``equal``, ``subset`` (all of ``a`` in ``b``) or ``disjoint``, else fail."""
    r = key_sets(a, b, on).first()
    holds = {"equal": not r.left_only and not r.right_only, "subset": not r.left_only, "disjoint": not r.both}
    if not holds[relation]:
        raise ContractError(f"{list(on)} not {relation}: {r.left_only} left only, {r.right_only} right only, {r.both} in both")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with surplus copies on either side, one for each surplus copy."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def assert_same_multiset(a: DataFrame, b: DataFrame) -> None:
    if not multiset_difference(a, b).isEmpty():
        raise ContractError("tables differ")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as a JSON array of strings (null stays null)."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def logical_digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of the rows in any order, repeats counted: SHA-256 over their number and the sums of their digests' parts.

    Sums combine map-side, so no task and no driver holds more than a row of them.
    """
    columns = list(columns or df.columns)
    rows = df.select(row_digest(columns).alias("d"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("d", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")), F.lit(0))
    got = rows.agg(F.count("*").alias("n"), *[part(k).cast("string").alias(f"p{k}") for k in range(4)]).first()
    return hashlib.sha256(",".join(str(v) for v in got).encode()).hexdigest()


def fail_open(base: DataFrame, steps: dict[str, tuple[Callable[[DataFrame], DataFrame], dict[str, str]]]) -> tuple[DataFrame, dict[str, str]]:
    """Attach enrichments one by one. A step that breaks a contract, or that Spark can't run, leaves its columns null and a warning.

    ``steps``: name to (function, columns with types). A step's checks must run inside its function: frames are lazy, and
    what fails after it has returned isn't caught.
    """
    warnings: dict[str, str] = {}
    for name, (step, columns) in steps.items():
        try:
            base = step(base)
        except (PySparkException, ContractError, OSError, ValueError) as e:
            warnings[name] = str(e)
            base = base.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    return base, warnings

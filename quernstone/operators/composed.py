"""Whole steps of a build, composed of smaller operators: the national gate, the attached release, the ranking sidecar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import finite, weighted_utility
from quernstone.operators.contracts import ContractError, assert_none, assert_unique, join_preserving
from quernstone.operators.domain import housing_utility

#: Weights of the affordability pillar (fixed values).
AFFORDABILITY = (("u_housing", 0.45), ("u_rpp", 0.35), ("u_property_tax", 0.20))
#: Housing counts from this many months on.
LEAST_MONTHS = 9


def keys_digest(keys: Column) -> list[Column]:
    """Aggregates whose ``concat_ws`` of the parts digests keys in any order: their number and the sums of four parts of their digests."""
    h = F.sha2(keys.cast("string"), 256)
    return [F.count("*").alias("_n"), *[F.sum(F.conv(F.substring(h, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).alias(f"_p{k}") for k in range(4)]]


def national_gate(blocks: DataFrame, expected: DataFrame, key: str, state: str, weight: str, state_of_key: Column) -> DataFrame:
    """Every state's blocks, people and keys against what is expected: one pass over the blocks, a row for each state of either side.

    ``expected``: ``state, blocks, population, keys_sha256`` (null: not locked). Returns these as ``state, blocks, population,
    keys_sha256`` found, and ``status``: ``unexpected`` (a state that isn't awaited), ``missing``, ``null_weight``, ``wrong_state`` (a
    key belongs to another state), ``blocks``, ``population``, ``keys`` (as many, but others), or ``complete``.
    """
    off = F.count_if(~F.coalesce(state_of_key == F.col(state), F.lit(False))).alias("_off")
    g = blocks.groupBy(F.col(state).alias("state")).agg(F.sum(weight).cast("long").alias("population"), F.count_if(F.col(weight).isNull()).alias("_null"), off, *keys_digest(F.col(key)))
    sha = F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("_n", "_p0", "_p1", "_p2", "_p3")]), 256)
    have = g.select(F.col("state").alias("_s"), F.col("_n").alias("blocks"), F.coalesce("population", F.lit(0)).alias("population"), sha.alias("keys_sha256"), "_null", "_off")
    want = expected.select(F.col("state").alias("_e"), F.col("blocks").alias("_blocks"), F.col("population").alias("_people"), F.col("keys_sha256").alias("_sha"))
    both = have.join(want, F.col("_s").eqNullSafe(F.col("_e")), "full")
    status = (
        F.when(F.col("_blocks").isNull(), "unexpected").when(F.col("blocks").isNull(), "missing").when(F.col("_null") > 0, "null_weight").when(F.col("_off") > 0, "wrong_state")
        .when(F.col("blocks") != F.col("_blocks"), "blocks").when(F.col("population") != F.col("_people"), "population").when(F.col("_sha") != F.col("keys_sha256"), "keys").otherwise("complete")
    )
    return both.select(F.coalesce("_s", "_e").alias("state"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("population", F.lit(0)).alias("population"), "keys_sha256", status.alias("status"))


def assert_national(gate: DataFrame) -> None:
    if (bad := gate.where("status <> 'complete'").first()) is not None:
        raise ContractError(f"{bad.state}: {bad.status} ({bad.blocks} blocks, {bad.population} people)")


def reconciled_release(frame: DataFrame, release: DataFrame, key: str, state: str, legacy_state: str, legacy_prefix: str, suffix: int, allowed: DataFrame | None, empty: Column) -> DataFrame:
    """``release`` with the keys of one state, whose codes changed, replaced by the frame's: both end in the same ``suffix`` characters.

    Every row of the frame in ``legacy_state`` must have exactly one release row, and the release rows left over must be ``allowed``
    (a frame of keys; none by default) and ``empty`` (a condition that holds for rows without people). A frame without such rows
    leaves the release as it is.
    """
    tail = lambda c: F.right(F.col(c), F.lit(suffix))
    targets = frame.where(F.col(state) == legacy_state).select(F.col(key).alias("_target"), tail(key).alias("_code"))
    if targets.isEmpty():
        return release
    old = F.col(key).startswith(legacy_prefix)
    sources = release.where(old).withColumn("_code", tail(key))
    sides = [("frame", assert_unique(targets, ["_code"])), ("release", assert_unique(sources.join(targets, "_code", "left_semi"), ["_code"]))]
    if not sides[0][1].join(sides[1][1], "_code", "left_anti").isEmpty():
        raise ContractError(f"{legacy_state}: a row has no counterpart among the changed codes")
    left = sources.join(targets, "_code", "left_anti")
    wanted = allowed if allowed is not None else sources.where("false").select(key)
    if not left.select(key).exceptAll(wanted.select(key)).unionAll(wanted.select(key).exceptAll(left.select(key))).isEmpty():
        raise ContractError(f"{legacy_state}: rows without a counterpart differ from the allowed ones")
    assert_none(left, {"a row without a counterpart has values": ~F.coalesce(empty, F.lit(False))})
    mapped = sources.join(targets, "_code").drop(key, "_code").withColumnRenamed("_target", key).select(*release.columns)
    return release.where(~F.coalesce(old, F.lit(False))).unionByName(mapped)


def attach_release(frame: DataFrame, release: DataFrame | None, key: str, in_scope: Column, values: dict[str, str], status: str, coverage: str, may_lack: Column | None = None) -> DataFrame:
    """``frame`` with the release's ``values`` (name to type), its ``status`` and ``coverage``, whatever the release holds.

    Rows out of scope say so, whatever the release has for them; rows in scope without one are ``unavailable``, which is an
    error unless ``may_lack`` holds for them or there is no release at all (null). Unknown coverage is 0.
    """
    if release is None:
        none = frame.withColumns({c: F.lit(None).cast(k) for c, k in values.items()})
        return none.withColumns({coverage: F.lit(0.0), status: F.when(in_scope, "unavailable").otherwise("outside_scope")})
    lacks = frame.where(in_scope & ~F.coalesce(may_lack if may_lack is not None else F.lit(False), F.lit(False))).join(release.select(key), key, "left_anti")
    if (n := lacks.count()) > 0:
        raise ContractError(f"the release lacks {n} rows in scope")
    own = release.select(key, *values, F.col(status).alias("_status"), F.col(coverage).alias("_coverage"), F.lit(True).alias("_there"))
    out = join_preserving(frame, own, [key])
    said = F.when(~in_scope, "outside_scope").when(F.col("_there").isNull(), "unavailable").otherwise(F.col("_status"))
    return out.withColumns({coverage: F.coalesce("_coverage", F.lit(0.0)), status: said}).drop("_status", "_coverage", "_there")


def ranking_sidecar(identity: DataFrame, counties: DataFrame, housing: DataFrame | None, knots: Sequence[tuple[float, float]], in_scope_states: Sequence[str], legacy: Sequence[str] = ("09",)) -> DataFrame:
    """Counties that both the identity table and the bundle have, with their trailing market and the affordability pillar.

    ``identity``: ``place_id, name, state``; ``counties``: ``county_fips`` and measures; ``housing``: ``county_fips, housing_valid_months,
    median_active_listings, median_ppsf, area`` (null: no market at all). The bundle must have every identity row of a state in scope and of the
    ``legacy`` states (whose codes are not translated). ``u_housing`` is null below ``LEAST_MONTHS``; a pillar with an unknown part is unknown.
    """
    bundle = assert_unique(counties, ["county_fips"]).withColumnRenamed("county_fips", "place_id").drop("name", "state")
    ids = assert_unique(identity.select("place_id", "name", "state"), ["place_id"])
    gone = ids.join(bundle, "place_id", "left_anti").withColumn("_st", F.left("place_id", F.lit(2)))
    if (bad := gone.where(F.col("_st").isin([*legacy, *in_scope_states])).first()) is not None:
        raise ContractError(f"{bad.place_id}: {'a changed code without a counterpart' if bad['_st'] in legacy else 'not in the bundle'}")
    rows = ids.join(bundle, "place_id")
    if housing is None:
        rows = rows.withColumns({"housing_valid_months": F.lit(None).cast("long"), **{c: F.lit(None).cast("double") for c in ("median_active_listings", "median_ppsf", "area")}})
    else:
        rows = join_preserving(rows, housing.withColumnRenamed("county_fips", "place_id"), ["place_id"])
    rows = rows.withColumn("u_housing", housing_utility(F.col("area"), F.col("housing_valid_months"), knots, LEAST_MONTHS))
    return rows.withColumn("u_affordability", weighted_utility([(finite(F.col(c).cast("double")), w) for c, w in AFFORDABILITY]))

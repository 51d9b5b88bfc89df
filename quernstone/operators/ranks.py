"""Exact ranks and percentiles that never sort a whole table, or a whole group, into one partition.

Every rank here depends on a value only through sums over smaller (or larger) distinct values. So rows are first reduced
to distinct values (with map-side combining), running sums are taken over these, and the result is joined back by value. Up to
``BUCKET_ROWS`` distinct values are one window; more are cut into buckets of about as many, each group at approximate
quantiles, with sums inside each bucket shifted by the buckets before (bucket bounds affect balance only); beyond ``BUCKETS``
of them they are dealt by ranges, written in order, and shifted by the ranges before. The distinct values are written to the shared folder once, as they are read
several times; so a chain of ranks is a plan that grows by one join a rank. ``ecdfs`` and ``weighted_lower_percentiles`` rank
several columns in one pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.numbering import accumulated
from quernstone.sources.shared import written

#: Distinct values that one window task takes, and buckets that quantiles are asked for; beyond, ranges are written.
BUCKET_ROWS, BUCKETS = 250_000, 64
#: Ranked values (a name and three numbers) that are broadcast to the rows of several measures.
BROADCAST_VALUES = 100_000
#: Points that are compared with each other at a time, and blocks of fronts that are compared in pairs.
BLOCK, BLOCKS = 2048, 4096


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in ``names``, nulls too; ``right`` has them with an underscore in front."""
    out = F.lit(True)
    for c in names:
        out &= left[c].eqNullSafe(right[f"_{c}"])
    return out


def running_sums(distinct: DataFrame, value: str, sums: dict[str, str], by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``distinct`` with ``upto`` sums: for each (output, input) in ``sums`` the sum over values <= this one, within ``by``.

    Also ``<output>_all``: the sum over all values. Values must be numeric, distinct within ``by`` and not null. ``buckets``
    follows from the number of values unless it is given.
    """
    by, v = list(by), F.col(value).cast("double")
    if buckets is None:
        n = distinct.count()  # of a written table: from its footers
        if n <= BUCKET_ROWS:
            group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
            upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
            return distinct.withColumns({o: F.sum(i).over(upto) for o, i in sums.items()} | {f"{o}_all": F.sum(i).over(group) for o, i in sums.items()})
        buckets = -(-n // BUCKET_ROWS)
        if buckets > BUCKETS:
            return accumulated(distinct, [value], sums, by)
    cuts = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    # written: they are read twice, and approximate quantiles hang on the order in which parts arrive
    marks = written(distinct.groupBy(*by).agg(F.percentile_approx(v, cuts, F.lit(1000)).alias("_marks")).withColumnsRenamed({c: f"_{c}" for c in by}), "marks")
    # a row for each group; without groups one row
    cut = distinct.join(marks, _same(distinct, marks, by)) if by else distinct.crossJoin(F.broadcast(marks))
    cut = cut.select(*distinct.columns, F.size(F.filter("_marks", lambda m: m < v)).alias("_b"))
    totals = cut.groupBy(*by, "_b").agg(*[F.sum(i).alias(f"_{o}") for o, i in sums.items()])
    # at most `buckets` rows a group
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}_before") for o in sums]
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_bucket"), *shifts, *[F.sum(f"_{o}").over(group).alias(f"{o}_all") for o in sums])
    totals = totals if by else F.broadcast(totals)
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(totals, _same(cut, totals, by) & (cut["_b"] == totals["_bucket"])).withColumns({o: F.sum(i).over(inside) + F.col(f"_{o}_before") for o, i in sums.items()})
    return out.select(*distinct.columns, *sums, *[f"{o}_all" for o in sums])


def _distinct(df: DataFrame, value: str, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.sum(weight).alias("w")] if weight is not None else [])
    return written(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs), "distinct")


def _back(df: DataFrame, ranked: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    r = ranked.select(*[F.col(c).alias(f"_{c}") for c in (*by, value)], out)
    same = df[value] == r[f"_{value}"]
    for c in by:
        same &= df[c].eqNullSafe(r[f"_{c}"])
    return df.join(r, same, "left").select(*df.columns, out)


def average_tie_percentile(df: DataFrame, value: str, out: str, by: Sequence[str] = (), force_zero: bool = False) -> DataFrame:
    """100 * (average rank - 1) / (N - 1) over non-null values; one value alone gets 0; null stays null.

    ``force_zero``: the value 0 gets 0 after ranking (zeros still take up ranks).
    """
    r = running_sums(_distinct(df, value, by), value, {"le": "n"}, by)
    n = F.col("le_all")
    rank = (F.col("le") - F.col("n")) + (F.col("n") - 1) / 2
    score = F.when(n > 1, 100.0 * rank / (n - 1)).otherwise(0.0)
    score = F.when(F.col(value) == 0, 0.0).otherwise(score) if force_zero else score
    return _back(df, r.withColumn(out, score), value, by, out)


def ecdf(df: DataFrame, value: str, out: str, by: Sequence[str] = (), invert: bool = False) -> DataFrame:
    """Average-tie position in [0, 1] among finite values; one value alone gets 1; ``invert`` ranks descending; others are null."""
    if dict(df.dtypes)[value] in ("double", "float"):
        raw = F.col(value)
        named = df.withColumn("_finite", F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw))
        return _ecdf(named, "_finite", out, by, invert).drop("_finite")
    return _ecdf(df, value, out, by, invert)


def _ecdf(df: DataFrame, value: str, out: str, by: Sequence[str], invert: bool) -> DataFrame:
    r = running_sums(_distinct(df, value, by), value, {"le": "n"}, by)
    n, rank = F.col("le_all"), (F.col("le") - F.col("n")) + (F.col("n") - 1) / 2
    at = F.when(n > 1, ((n - 1 - rank) if invert else rank) / (n - 1)).otherwise(1.0)
    return _back(df, r.withColumn(out, at), value, by, out)


def _unpivot(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, name, v``, finite values only."""
    double = lambda c: F.col(c).cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.when(~F.isnan(double(c)) & (F.abs(double(c)) != float("inf")), double(c)).alias("v")) for c in columns])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.name", "x.v").where("v is not null")


def ecdfs(df: DataFrame, key: str, measures: dict[str, tuple[str, bool]]) -> DataFrame:
    """``ecdf`` of several measures in one pass: output to (measure, invert). Rows have unique keys."""
    long = _unpivot(df, key, sorted({m for m, _ in measures.values()}))
    distinct = written(long.groupBy("name", "v").agg(F.count("*").alias("n")), "distinct")
    few = distinct.count() <= BROADCAST_VALUES
    r = running_sums(distinct, "v", {"le": "n"}, ["name"])
    n, rank = F.col("le_all"), (F.col("le") - F.col("n")) + (F.col("n") - 1) / 2
    r = r.withColumns({"_up": F.when(n > 1, rank / (n - 1)).otherwise(1.0), "_down": F.when(n > 1, (n - 1 - rank) / (n - 1)).otherwise(1.0)})
    # by their number, as the size of a compressed file says little of what a broadcast takes
    ranked = long.join(r.select("name", "v", "_up", "_down").hint("broadcast" if few else "merge"), ["name", "v"])
    pick = lambda o, m, inv: F.max(F.when(F.col("name") == m, F.col("_down" if inv else "_up"))).alias(o)
    wide = ranked.groupBy(F.col(key).alias("_key")).agg(*[pick(o, m, inv) for o, (m, inv) in measures.items()])
    return df.join(wide.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")


def weighted_lower_percentiles(df: DataFrame, key: str, weight: str, columns: dict[str, str], digits: int = 2) -> DataFrame:
    """``weighted_lower_percentile`` of several columns in one pass: output to column. Rows have unique keys."""
    w = F.when(F.col(weight) > 0, F.col(weight).cast("decimal(28,6)")).otherwise(F.lit(0).cast("decimal(28,6)")).alias("w")
    double = lambda c: F.col(c).cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), double(c).alias("v")) for c in sorted(set(columns.values()))])
    long = df.select(F.col(key).alias("_key"), w, F.explode(cells).alias("x")).select("_key", "w", "x.name", "x.v").where("v is not null")
    r = running_sums(written(long.groupBy("name", "v").agg(F.sum("w").alias("w")), "distinct"), "v", {"le": "w"}, ["name"])
    share = 100.0 * (F.col("le") - F.col("w")).cast("double") / F.col("le_all").cast("double")
    r = r.select("name", "v", F.when(F.col("le_all") > 0, F.rint(share * 10.0**digits) / 10.0**digits).alias("_p"))
    ranked = long.drop("w").join(r, ["name", "v"])
    wide = ranked.groupBy("_key").agg(*[F.max(F.when(F.col("name") == c, F.col("_p"))).alias(o) for o, c in columns.items()])
    return df.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")


def max_rank_percentile(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """100 * share of non-null values <= this one."""
    r = running_sums(_distinct(df, value, by), value, {"le": "n"}, by)
    return _back(df, r.withColumn(out, 100.0 * F.col("le") / F.col("le_all")), value, by, out)


def weighted_lower_percentile(df: DataFrame, value: str, weight: str, out: str, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """100 * weight of smaller values / all weight, half-even to ``digits``. Rows of weight 0 or null don't calibrate,
    but get a rank (above all calibrating values: 100)."""
    w = F.when(F.col(weight) > 0, F.col(weight).cast("decimal(28,6)")).otherwise(F.lit(0).cast("decimal(28,6)"))
    # where no row calibrates, there are no percentiles: `must_calibrate` of the block scores fails on that
    r = running_sums(_distinct(df, value, by, w), value, {"le": "w"}, by)
    share = 100.0 * (F.col("le") - F.col("w")).cast("double") / F.col("le_all").cast("double")
    return _back(df, r.withColumn(out, F.when(F.col("le_all") > 0, F.rint(share * 10.0**digits) / 10.0**digits)), value, by, out)


def inclusive_tail_magnitude(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """log10(N / number of values >= this one), half-even to 4 digits."""
    r = running_sums(_distinct(df, value, by), value, {"le": "n"}, by)
    n, tail = F.col("le_all"), F.col("le_all") - F.col("le") + F.col("n")
    return _back(df, r.withColumn(out, F.rint(F.log10(n / tail) * 1e4) / 1e4 + 0.0), value, by, out)


def competition_rank(df: DataFrame, score: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """1, 1, 3, ... by descending score; null stays null."""
    r = running_sums(_distinct(df, score, by), score, {"le": "n"}, by)
    return _back(df, r.withColumn(out, (F.col("le_all") - F.col("le") + 1).cast("long")), score, by, out)


def _front(points: np.ndarray) -> np.ndarray:
    """Which points no other one dominates (at least as high everywhere, higher somewhere), in blocks."""
    order = np.argsort(-points.sum(1), kind="stable")  # what dominates a point comes before it
    kept = np.zeros((0, points.shape[1]))
    alive = np.zeros(len(points), bool)
    for at in range(0, len(order), BLOCK):
        idx = order[at : at + BLOCK]
        idx = idx[~_dominated(points[idx], kept)]
        idx = idx[~_dominated(points[idx], points[idx])]
        alive[idx] = True
        kept = np.concatenate([kept, points[idx]])
    return alive


def _dominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for at in range(0, len(others), BLOCK):
        q = others[at : at + BLOCK]
        left = np.flatnonzero(~out)
        if len(left):
            p = points[left][:, None, :]
            out[left] = ((q[None] >= p).all(2) & (q[None] > p).any(2)).any(1)
    return out


def pareto_flags(df: DataFrame, key: str, dimensions: Sequence[str], out: str = "pareto") -> DataFrame:
    """True for rows that no other row dominates (at least as high everywhere, higher somewhere); equals both stay, rows with a null are false.

    Rows are reduced to distinct points and to the front of each partition (a point dominated anywhere is dominated in the
    whole). The fronts are dealt again in order of their sums and cut into blocks, each reduced to its own front; blocks then meet by
    id where their bounds allow dominance, a pair of blocks in a call. There are about ``BLOCKS`` blocks at most (larger ones, of
    fronts of over ``BLOCK * BLOCKS`` points), so the table of bounds is small whatever the size; no task holds all fronts, also where every
    row is in one.
    """
    dims = list(dimensions)
    points = df.select(*[F.col(c).cast("double").alias(c) for c in dims]).dropna().distinct()
    kind = ", ".join(f"`{c}` double" for c in dims)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = np.zeros((0, len(dims)))
        for pdf in batches:
            both = np.concatenate([front, pdf.to_numpy(float)])
            front = both[_front(both)]
        yield pd.DataFrame(front, columns=dims)

    fronts = written(points.mapInPandas(local, kind), "fronts")
    size = max(BLOCK, -(-fronts.count() // BLOCKS))

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, np.zeros((0, len(dims)))
        for pdf in itertools.chain(batches, [None]):
            held = held if pdf is None else np.concatenate([held, pdf.to_numpy(float)])
            while len(held) >= size or (pdf is None and len(held)):
                x, held = held[:size], held[size:]
                x = np.ascontiguousarray(x[_front(x)])
                yield pd.DataFrame({"id": [(part << 32) + made], "points": [x.tobytes()], "low": [x.min(0).tolist()], "high": [x.max(0).tolist()]})
                made += 1

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.points:
                yield pd.DataFrame(np.frombuffer(p).reshape(-1, len(dims)), columns=dims)

    def losers(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.frombuffer(pdf[c].iloc[0]).reshape(-1, len(dims)) for c in ("points", "others"))
        return pd.DataFrame(x[_dominated(x, y)], columns=dims)

    # in order of sums, blocks at the top dominate many of those below and few above
    ordered = fronts.repartitionByRange(sum((F.col(c) for c in dims[1:]), F.col(dims[0])).desc())
    blocks = written(ordered.mapInPandas(blocked, "id bigint, points binary, low array<double>, high array<double>"), "blocks")
    bounds = blocks.select("id", "low", "high")
    other = bounds.withColumnsRenamed({c: f"o_{c}" for c in bounds.columns})
    other = F.broadcast(other) if blocks.count() <= 4 * BLOCKS else other
    pairs = bounds.join(other, F.expr("id <> o_id and forall(arrays_zip(low, o_high), p -> p.o_high >= p.low)")).select("id", "o_id")
    both = pairs.join(blocks.select("id", "points"), "id").join(blocks.select(F.col("id").alias("o_id"), F.col("points").alias("others")), "o_id")
    gone = both.groupBy("id", "o_id").applyInPandas(losers, kind).distinct()
    inside = blocks.select("points").mapInPandas(unpacked, kind)
    best = inside.join(gone.withColumnsRenamed({c: f"_{c}" for c in dims}), F.expr(" and ".join(f"`{c}` = `_{c}`" for c in dims)), "left_anti")
    # two blocks hold no equal points: points are distinct
    best = best.withColumnsRenamed({c: f"_{c}" for c in dims}).withColumn("_best", F.lit(True))
    same = F.expr(" and ".join(f"cast(`{c}` as double) = `_{c}`" for c in dims))
    return df.join(best, same, "left").select(*df.columns, F.coalesce("_best", F.lit(False)).alias(out))

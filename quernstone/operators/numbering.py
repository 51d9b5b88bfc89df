"""Exact row numbers and pages of a table in order, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.contracts import ContractError
from quernstone.sources.shared import written

#: Rows of (part, group) offsets that are broadcast: a few numbers and a group's key each.
BROADCAST_OFFSETS = 200_000


def ordered_parts(df: DataFrame, order: Sequence[str], tag: str = "ordered") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written, with ``_part`` (in order) and ``_at`` (place in its file).

    Each task writes its range in order, so a file and a place in it are a place in the whole order.
    """
    plain = written(df.repartitionByRange(*order).sortWithinPartitions(*order), tag)
    name = F.col("_metadata.file_name")
    # files of a task that wrote several follow each other by name
    part = F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 9, "0"), name)
    return plain.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_at"))


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_number", by: Sequence[str] = (), start: int = 1, total: str | None = None) -> DataFrame:
    """Row numbers from ``start`` in ascending ``order`` (nulls first) within ``by`` (nulls are a group); ``total``: the group's rows.

    Two passes: the ranges are written in order, then each part counts its rows of each group, and a row's number is its place
    in its part plus the rows of the parts before. ``order`` should be total: rows that tie in all of it are numbered as they
    come and can't be split over tasks. Works alike on empty tables. No column may begin with an underscore.
    """
    by, keys = list(by), [*by, *order]
    placed = ordered_parts(df, keys)
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    counts = written(counts, "offsets")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each part and group
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], (before - F.col("_first") + start).alias("_shift"), F.sum("_rows").over(group).alias("_total"))
    if counts.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same = placed["_part"] == F.col("_p")
    for c in by:
        same &= placed[c].eqNullSafe(F.col(f"_by_{c}"))
    more = [F.col("_total").alias(total)] if total else []
    return placed.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out), *more)


def pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """The inventory of ``df`` in pages of ``size`` rows by ``key``, which must be unique and not null.

    ``page`` (from 0), ``rows, first_key, last_key, keys_sha256`` (lowercase hex of the keys as text in order, each with a
    line feed). A page is ``size`` keys, whatever the table's size.
    """
    n = numbered(df.select(key), [key], "_n", start=0)
    g = n.groupBy(F.floor(F.col("_n") / size).cast("long").alias("page"))
    ids = F.sort_array(F.collect_list(key))
    return g.agg(F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sha2(F.concat(F.array_join(ids.cast("array<string>"), "\n"), F.lit("\n")), 256).alias("keys_sha256"))


def checked_pages(inventory: DataFrame, got: DataFrame, page: str, key: str) -> DataFrame:
    """``got``: rows that arrived, with the page they came by. One row for each page of either side: ``page, status``.

    ``complete``: the page has its keys, each once; ``short`` / ``surplus``: rows missing or too many; ``other_keys``: as many
    rows, but not these; ``missing``: no row came; ``unexpected``: no such page.
    """
    ids = F.sort_array(F.collect_list(key))  # a page is a bounded number of keys; one that a source overfills is the source's own unit
    have = got.groupBy(F.col(page).cast("long").alias("page")).agg(F.count("*").alias("_n"), F.sha2(F.concat(F.array_join(ids.cast("array<string>"), "\n"), F.lit("\n")), 256).alias("_sha"))
    both = inventory.select("page", "rows", "keys_sha256").join(have, "page", "full")
    status = (
        F.when(F.col("rows").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") < F.col("rows"), "short").when(F.col("_n") > F.col("rows"), "surplus")
        .when(F.col("_sha") != F.col("keys_sha256"), "other_keys").otherwise("complete")
    )
    return both.select("page", status.alias("status"))


def assert_pages(inventory: DataFrame, got: DataFrame, page: str, key: str) -> None:
    bad = checked_pages(inventory, got, page, key).where("status <> 'complete'").first()
    if bad is not None:
        raise ContractError(f"page {bad.page}: {bad.status}")


def accumulated(df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """For each (output, input) in ``sums`` the sum over the rows up to this one in ascending ``order`` within ``by``, and ``<output>_all`` over all.

    Inputs are not null, decimals or whole numbers. As ``numbered``: running sums within each written range, plus the sums of the
    ranges before. ``order`` must be total for the sums of single rows to be defined.
    """
    by = list(by)
    placed = ordered_parts(df, [*by, *order])
    parts = written(placed.groupBy("_part", *by).agg(*[F.sum(i).alias(f"_{o}") for o, i in sums.items()]), "offsets")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each part and group
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}_before") for o in sums]
    offsets = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], *shifts, *[F.sum(f"_{o}").over(group).alias(f"{o}_all") for o in sums])
    offsets = F.broadcast(offsets) if parts.count() <= BROADCAST_OFFSETS else offsets
    same = placed["_part"] == F.col("_p")
    for c in by:
        same &= placed[c].eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # a range of the table
    run = placed.withColumns({f"_{o}_upto": F.sum(i).over(inside) for o, i in sums.items()}).join(offsets, same)
    return run.select(*df.columns, *[(F.col(f"_{o}_upto") + F.col(f"_{o}_before")).alias(o) for o in sums], *[f"{o}_all" for o in sums])


def order_faults(df: DataFrame, key: str, arrays: Sequence[str] = ()) -> DataFrame:
    """Rows of a stored payload that break its order: ``part, place, key, fault``, as the rows lie in the files, without a sort.

    ``not_ascending``: the key isn't above the one before it, the first of a file than the last of the file before (by name);
    ``null_key``; ``ragged``: ``arrays`` of a row differ in length (a null array has none). ``df`` must be read from files.
    Neighbours within a file meet by their places (an equi-join), files by a row each.
    """
    name = F.col("_metadata.file_name")
    rows = df.select(name.alias("part"), F.col("_metadata.row_index").alias("place"), F.col(key).alias("key"), *[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(arrays)])
    ends = rows.groupBy("part").agg(F.max_by("key", "place").alias("_last"))
    ends = ends.select(F.col("part").alias("_p"), F.lag("_last").over(Window.partitionBy(F.lit(1)).orderBy("part")).alias("_floor"))  # a row for each file
    before = rows.select(F.col("part").alias("_q"), (F.col("place") + 1).alias("_next"), F.col("key").alias("_prev"))
    both = rows.join(before, (rows["part"] == F.col("_q")) & (rows["place"] == F.col("_next")), "left").join(ends, rows["part"] == F.col("_p"))
    falls = F.col("key") <= F.when(F.col("place") == 0, F.col("_floor")).otherwise(F.col("_prev"))
    ragged = F.lit(False)
    for i in range(1, len(arrays)):
        ragged |= F.col("_s0") != F.col(f"_s{i}")
    faults = F.array_compact(F.array(F.when(F.col("key").isNull(), "null_key"), F.when(falls, "not_ascending"), F.when(ragged, "ragged")))
    return both.select("part", "place", "key", F.explode(faults).alias("fault"))

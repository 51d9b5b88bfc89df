"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source's target over its size is the expected number of copies of each of its documents; the whole part is taken
as it is. The fractions are rounded together: two documents' fractions meet, mass (words) moves from one to the other
until one of them is 0 or 1, with odds that keep each document's expectation, and the other goes on. Words of a source
are kept exactly at every step, so a mix misses a target by less than one document. Documents are dealt into buckets of
bounded expected size (whatever the source); each bucket leaves one residual, and buckets' residuals meet again in a
reduction tree, ``FAN`` at a time, until one is left for each source. Odds come from hashes of ids: reruns agree.

Rows alike in id, source and size (rows without an id among them, in any number) are one item: of m such rows with
fraction p, whole(m p) get a copy more, which is pivotal rounding of equal sizes carried through, and one fraction is left
to meet the others. So no bucket holds more than its share, however many rows repeat.

Defined cases: null text has size 0 and is taken 0 times; null source is a source of its own, ordered last; null ids
are rounded like others; repeated rows are separate documents; ids are of any type that can be ordered; an empty table
gives an empty result; other columns are ignored. Source totals, a row for each source, go to the driver (a mix names its
sources).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import small_table, written

FAN = 48
WORD = r"[^\x20\x09-\x0D]+"
TINY = 1e-9
#: Rows that one row of repeats is turned into at a time.
STEP = 4096


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes; none above ``most`` times its size, the excess reshared."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left = max(0.0, left - sum(out[i] for i in full))
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _fold(seed: int, id_type: str) -> str:
    """SQL that folds an array of (id, size, n, base, more, p) into the residual and what has been decided.

    With residual a and next x: up = words that can move to a, down = words that can move from a. a gains with the odds
    down / (up + down), which keeps both expectations; whichever becomes whole is decided, the other is the residual.
    """
    names = ("id", "size", "n", "base", "more")
    kept = lambda x: ", ".join(f"'{c}', {x}.{c}" for c in names)
    item = f"struct<id:{id_type},size:bigint,n:bigint,base:int,more:bigint,p:double>"
    u = f"pmod(xxhash64({seed}, y.a.id, y.a.size, y.x.id, y.x.size), 9007199254740992L) / 9007199254740992D"
    moved = f"named_struct('a', named_struct({kept('z.a')}, 'p', {{a}}), 'x', named_struct({kept('z.x')}, 'p', {{x}}), 'first', {{first}})"
    gain = moved.format(
        a="if((1 - z.a.p) * z.a.size <= z.x.p * z.x.size, 1D, z.a.p + z.up / z.a.size)",
        x="if((1 - z.a.p) * z.a.size <= z.x.p * z.x.size, greatest(0D, z.x.p - z.up / z.x.size), 0D)",
        first="(1 - z.a.p) * z.a.size <= z.x.p * z.x.size",
    )
    lose = moved.format(
        a="if(z.a.p * z.a.size <= (1 - z.x.p) * z.x.size, 0D, z.a.p - z.down / z.a.size)",
        x="if(z.a.p * z.a.size <= (1 - z.x.p) * z.x.size, least(1D, z.x.p + z.down / z.x.size), 1D)",
        first="z.a.p * z.a.size <= (1 - z.x.p) * z.x.size",
    )
    said = "named_struct('id', {0}.id, 'size', {0}.size, 'n', {0}.n, 'base', {0}.base, 'more', {0}.more + cast(round({0}.p) as bigint))"
    pair = f"""transform(transform(array(named_struct('a', acc.a, 'x', x)), y -> named_struct('a', y.a, 'x', y.x,
          'up', least((1 - y.a.p) * y.a.size, y.x.p * y.x.size), 'down', least(y.a.p * y.a.size, (1 - y.x.p) * y.x.size), 'u', {u})),
        z -> if(z.up + z.down > 0, if(z.u * (z.up + z.down) < z.down, {gain}, {lose}), named_struct('a', z.a, 'x', z.x, 'first', true)))"""
    step = f"""(acc, x) -> if(acc.a is null, named_struct('a', x, 'out', acc.out),
        transform({pair}, r -> if(r.first,
            named_struct('a', r.x, 'out', concat(acc.out, array({said.format("r.a")}))),
            named_struct('a', r.a, 'out', concat(acc.out, array({said.format("r.x")}))))) [0])"""
    decided = f"array<struct<id:{id_type},size:bigint,n:bigint,base:int,more:bigint>>"
    return f"aggregate(items, named_struct('a', cast(null as {item}), 'out', cast(array() as {decided})), {step})"


def source_totals(sized: DataFrame) -> list[tuple[str | None, int, int]]:
    """(source, size, items), by code point, null last. ``sized``: ``id, source, size, n`` rows alike."""
    rows = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n")).collect()
    return sorted(((r.source, int(r.size or 0), r.n) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))


def pivotal_copies(items: DataFrame, seed: int = 17) -> DataFrame:
    """``items``: ``id, size, k`` (source number), ``n`` (rows), ``base`` (whole copies of each), ``p`` (fraction of each), ``buckets`` (of its source).

    Returns ``id, size, k, n, base, more``: of the ``n`` rows ``more`` are taken ``base + 1`` times, the others ``base`` times.
    """
    id_type = items.schema["id"].dataType.simpleString()
    # of n equal rows more get one copy further, and one fraction is left
    items = items.withColumn("more", F.floor(F.col("n") * F.col("p") + TINY)).withColumn("p", F.greatest(F.lit(0.0), F.col("n") * F.col("p") - F.col("more")))
    whole = (F.col("p") <= TINY) | (F.col("p") >= 1 - TINY) | (F.col("size") == 0)
    names = ["id", "size", "n", "base", "more"]
    done = [items.where(whole).select("k", *names[:-1], (F.col("more") + F.when(F.col("p") >= 1 - TINY, 1).otherwise(0)).alias("more"))]
    item = F.struct("id", "size", "n", F.col("base").cast("int").alias("base"), "more", "p")
    level = items.where(~whole).select("k", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("buckets")).alias("bucket"), item.alias("item"))
    most = items.agg(F.max("buckets")).first()[0] or 1
    depth = 0
    while True:
        folded = level.groupBy("k", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items")).select("k", "bucket", F.expr(_fold(seed + depth, id_type)).alias("f"))
        folded = written(folded.select("k", "bucket", "f.a", "f.out"), f"mix{depth}")
        done.append(folded.select("k", F.explode("out").alias("o")).select("k", "o.*"))
        if most == 1:
            break
        most, depth = -(-most // FAN), depth + 1
        level = folded.select("k", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("a").alias("item"))
    # the last residual of a source: a lone draw with its probability
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "a.id", "a.size"), F.lit(1 << 53)) / float(1 << 53)
    done.append(folded.where("a is not null").select("k", "a.id", "a.size", "a.n", "a.base", (F.col("a.more") + F.when(u < F.col("a.p"), 1).otherwise(0)).alias("more")))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def mix_items(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row for rows alike in id, source and size: ``id, source, size, n, base, more, source_size, target``.

    Sources by code point (null last) weigh ``weights``, repeating; targets add up to ``share`` of all words, none above
    ``most`` (a whole number) times its source.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_size(F.col(text_col)).alias("size"))
    sized = written(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sized")
    totals = source_totals(sized)
    targets = water_fill([s for _, s, _ in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    plan = []
    for k, ((source, total, n), target) in enumerate(zip(totals, targets, strict=True)):
        c = min(most, target / total) if total else 0.0
        plan.append((source, k, total, float(target), int(c), c - int(c), max(1, -(-n // FAN))))
    kinds = {"source": pa.string(), "k": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "base": pa.int32(), "p": pa.float64(), "buckets": pa.int64()}
    plan_df = small_table(spark, plan, list(kinds.items()))
    ready = sized.join(plan_df, sized.source.eqNullSafe(plan_df.source)).select("id", "size", "n", "k", "base", "p", "buckets")
    return pivotal_copies(ready, seed).join(plan_df.select("k", "source", "source_size", "target"), "k").drop("k")


def text_size(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken``; arguments as for ``mix_items``."""
    # a row for each of n, in steps, so that no array grows with n
    out = mix_items(docs, **how).select("*", F.explode(F.expr(f"sequence(0, (n - 1) div {STEP})")).alias("step"))
    out = out.select("*", F.explode(F.expr(f"sequence(step * {STEP} + 1, least(n, (step + 1) * {STEP}))")).alias("i"))
    copies = F.col("base") + (F.col("i") <= F.col("more")).cast("long")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))

"""Near-duplicates: MinHash signatures joined by a multi-index Hamming join, links confirmed on full shingle sets.

Signatures are 16-bit MinHash symbols. The first ``KEYED`` of them, cut into chunks of ``CHUNK`` symbols, are the index:
if two signatures differ in at most ``2 * chunks - 1`` of these symbols, some chunk has at most one wrong symbol (pigeonhole),
so indexing each chunk with each of its symbols left out brings every such pair together. At similarity 0.75 a quarter
of the symbols differ on average; the bound lies over five standard deviations above. Pairs further apart than
``FAR`` of all symbols (six deviations) are dropped, and the rest are confirmed on whole sets.

Documents with equal sets are one class. Buckets of at most ``SMALL`` classes give their pairs (under ``SMALL`` / 2 a class). In
larger ones, so that pairs grow as the bucket and not as its square, every class is paired with one pivot only: the class
that has most company over its large buckets, as the original of many near copies has (copies of it need not be near each
other). While confirmed links leave such buckets in several components and pivots find links (one in ``GAIN`` of their pairs), those
components that had no pivot yet get one of their own, up to ``TURNS`` times; what is then left is joined by its rarest shingles (two sets of similarity t share one of their n - ceil(t n) + 1 rarest), where only
pairs across components and of sizes within a step of 1 / t count. So no partner is lost, and no bucket is enumerated but what its
links leave unresolved: texts that share just under t of their shingles with very many others. Their pairs by a common
rare shingle are dealt in blocks of ``BLOCK`` classes, each block against the others in a task of its own, so that no task
holds such a group; the pairs themselves are as many as the sets make necessary.

Defined cases: null or empty texts (or only white space) have no shingles, are linked with nothing and kept; fewer
words than ``width`` make one shingle; a null id takes its component's id (null if no row of the component has one) and
is not kept; rows repeating an id are the same document; ids are numbers below 2^62; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import drop_written, lean, small_batches, written
from quernstone.llm.components import components
from quernstone.llm.shingles import minhash, multipliers, shingle_sets

SYMBOLS, KEYED, CHUNK, SMALL = 128, 42, 3, 8
FAR = 61
#: Rows without an id go by a hash of their text from here on; ids lie below.
UNNAMED = 1 << 62
#: Classes of a group of pairs that go to a task together.
BLOCK = 512
#: Further pivots that a bucket gets before its classes are joined by their rarest shingles, as long as one in ``GAIN`` of the pairs is a link.
TURNS, GAIN = 3, 2
#: Documents whose texts are needed again are found by a broadcast up to this many ids (16 MB), by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def _sketch(width: int, muls: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()), pa.array([minhash(x, muls).tobytes() if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "n", "digest", "sig"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and symbol left out; a key holds its place and its symbols, so keys never collide."""
    per_chunk = CHUNK
    for batch in batches:
        for k in range(0, batch.num_rows, 4000):
            part = batch.slice(k, 4000)
            sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.int64)
            keys = []
            for c in range(KEYED // CHUNK):
                chunk = sig[:, c * CHUNK : (c + 1) * CHUNK]
                for left_out in range(CHUNK):
                    key = np.full(len(sig), c * per_chunk + left_out, np.int64)
                    for j in range(CHUNK):
                        if j != left_out:
                            key = (key << 16) | chunk[:, j]
                    keys.append(key)
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(part.column(0).to_numpy(), m)), pa.array(np.tile(part.column(1).to_numpy(), m))], names=["key", "id", "n"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs (a, b, sig_a, sig_b) at most ``FAR`` symbols apart."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for j in (2, 3))
            near = pa.array((x != y).sum(1) <= FAR)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"])

    return run


def _confirm(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= per_cent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["id", "shingle"])


def _pairs_of(bucketed: DataFrame, per_cent: int) -> DataFrame:
    """Pairs within small buckets whose sizes allow the similarity; ``bucketed``: ``key, id, n``."""
    near = f"100 * least(x.n, y.n) >= {per_cent} * greatest(x.n, y.n)"
    pairs = f"flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> {near}), y -> struct(least(x.id, y.id) as a, greatest(x.id, y.id) as b))))"
    return bucketed.groupBy("key").agg(F.collect_set(F.struct("id", "n")).alias("g")).select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")


def _few(small: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast up to ``BROADCAST_IDS`` rows, shuffled beyond."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def _states(large: DataFrame, company: DataFrame, comps: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """``key, id, company, c, seen`` of the members of large buckets; ``seen``: the class's component has had a pivot."""
    if comps is None:
        return large.join(_few(company).withColumn("c", F.col("id")).withColumn("seen", F.lit(False)), "id")
    named = company.join(_few(comps), "id", "left").select("id", "company", F.coalesce("component", "id").alias("c"))
    had = written(named.join(_few(tried), "id", "left_semi").select("c", F.lit(True).alias("had")).distinct(), "seen")
    states = written(named.join(_few(had), "c", "left").select("id", "company", "c", F.coalesce("had", F.lit(False)).alias("seen")), "states")
    return large.join(_few(states), "id")


def _pivots(at: DataFrame) -> DataFrame:
    """``key, pivot, pc`` of buckets of several components: the class with most company of those that are not ``seen`` (null: none)."""
    free = F.when(~F.col("seen"), F.struct((-F.col("company")).alias("less"), "id", "c"))
    keys = at.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(free).alias("p")).where("low < high")
    return keys.select("key", F.col("p.id").alias("pivot"), F.col("p.c").alias("pc"))


def _stars(at: DataFrame, pivots: DataFrame) -> DataFrame:
    """The classes of a bucket that are not ``seen`` with the bucket's pivot, across components."""
    pivots = _few(pivots.where("pivot is not null"))
    return at.where(~F.col("seen")).join(pivots, "key").where("c <> pc").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    sig = reps.select("id", "sig")
    joined = sig.withColumnsRenamed({"id": "a", "sig": "sa"}).join(_few(written(pairs, "found")), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(lean(_differing), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    joined = sets.withColumnsRenamed({"id": "a", "shingles": "xa"}).join(_few(pairs), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "xb"}), "b")
    return joined.select("a", "b", "xa", "xb").mapInArrow(lean(_confirm(per_cent)), "a bigint, b bigint")


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components ``id, component`` after further links: only the components that these touch are put together."""
    few = _few(comps)
    ends = more.join(few.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(few.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
    over = written(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "over")
    moved = comps.join(_few(over).select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(over.join(few.select("id"), "id", "left_anti")), "components")


def _prefix_pairs(sets: DataFrame, comps: DataFrame, per_cent: int) -> DataFrame:
    """Pairs across components that share one of their rarest shingles. ``comps``: ``id, c`` of the unresolved ids.

    In two sets sorted by rarity, what is common begins at the first common shingle; so no more can be common than is
    left from there on (``at`` counts what came before), and a pair whose rest is too short is out. Sizes are classed by
    powers of 100 / ``per_cent``; pairs lie in one class or in two that follow each other.
    """
    postings = written(sets.join(comps.select("id"), "id", "left_semi").mapInArrow(lean(_posting), "id bigint, shingle bigint"), "postings")
    often = postings.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = postings.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    size = F.size("s")
    prefix = F.slice("s", F.lit(1), (size - F.ceil(size * per_cent / F.lit(100)) + 1).cast("int"))
    rare = ranked.select("id", size.alias("n"), F.posexplode(prefix).alias("at", "x")).where("x.df > 1").select("id", "n", "at", "x.shingle").join(comps, "id")
    rare = rare.withColumn("step", F.floor(F.log("n") / math.log(100 / per_cent) + 1e-9).cast("int") if per_cent < 100 else F.lit(0))
    groups = rare.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low < high")
    rare = rare.join(groups.select("shingle", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "shingle")
    rare = written(rare.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "rare")
    x = rare.select("shingle", "block", F.col("step").alias("own"), F.explode(F.expr("array(step, step - 1)")).alias("step"), *[F.col(c).alias(f"{c}x") for c in ("id", "n", "c", "at")])
    y = rare.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "step", *[F.col(c).alias(f"{c}y") for c in ("id", "n", "c", "at")])
    near = F.expr(f"cx <> cy and (own > step or idx < idy) and 100 * least(nx, ny) >= {per_cent} * greatest(nx, ny) and {100 + per_cent} * least(nx - atx, ny - aty) >= {per_cent} * (nx + ny)")
    return x.join(y, ["shingle", "block", "step"]).where(near).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Links need ``100 * common >= per_cent * union``; ``per_cent`` must be 75 or more for the index's bound to hold.
    """
    if per_cent < 75:
        raise ValueError("the index guarantees pairs from 75 per cent on")
    text = F.col(text_col)
    unnamed = F.xxhash64(text).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), text.alias("text"))
    with small_batches(docs.sparkSession):
        sketches = written(rows.mapInArrow(lean(_sketch(width, multipliers(SYMBOLS))), "doc_id bigint, n bigint, digest binary, sig binary"), "sketches")
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), "n", "sig")).alias("r"))
    reps = written(classes.select("digest", "r.id", "r.n", "r.sig"), "classes")

    keys = reps.select("id", "n", "sig").mapInArrow(lean(_keys), "key bigint, id bigint, n bigint")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(keys.join(shared, "key"), "members")
    large = members.where(F.col("size") > SMALL)
    company = written(large.groupBy("id").agg(F.sum("size").alias("company")), "company")
    large = written(large.select("key", "id"), "large")
    at = written(_states(large, company, None, None), "at")
    pivots = written(_pivots(at), "pivots")
    found = _pairs_of(members.where(F.col("size") <= SMALL).select("key", "id", "n"), per_cent).unionByName(_stars(at, pivots)).distinct()
    pairs = written(_near(found, reps), "pairs")

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(company.select("id")).distinct(), "needed")
    needed_rows = rows.withColumnRenamed("doc_id", "id").join(_few(needed), "id", "left_semi")
    with small_batches(docs.sparkSession):
        sets = written(needed_rows.mapInArrow(lean(_sets(width)), "id bigint, shingles binary"), "sets")
    links = written(_confirmed(pairs, sets, per_cent), "links")
    comps = written(components(links), "components")

    # large buckets that confirmed links leave in several components; read from tables, so that no bucket is dealt whole
    tried, turn, worth = written(pivots.select(F.col("pivot").alias("id")).distinct(), "tried"), 1, links.count() * GAIN >= pairs.count()
    while True:
        at = written(_states(large, company, comps, tried), "at")
        pivots = written(_pivots(at), "pivots")
        if not pivots.limit(1).count():
            break
        last = turn > TURNS or not worth
        if last:
            across = _prefix_pairs(sets, written(at.join(_few(pivots.select("key")), "key", "left_semi").select("id", "c").distinct(), "unresolved"), per_cent)
        else:
            across = _stars(at, pivots)
            tried = written(tried.unionByName(pivots.where("pivot is not null").select(F.col("pivot").alias("id"))).distinct(), "tried")
        across = written(_near(across, reps), "across")
        more = written(_confirmed(across, sets, per_cent), "more-links")
        gained, turn = more.count(), turn + 1
        worth = gained * GAIN >= max(across.count(), 1)
        if gained:
            comps = _joined(comps, more)
        if last:
            break
    for done in (members, shared, large, pairs, sets):
        drop_written(done)
    linked = reps.select("digest", "id").join(comps, "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    out = sketches.select("doc_id", "n", "digest").join(written(linked, "class-components"), "digest", "left")
    own, component = named("doc_id"), F.when(F.col("digest").isNull(), named("doc_id")).otherwise(named("c"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(own == component, F.col("digest").isNull()).alias("kept"))

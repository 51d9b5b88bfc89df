"""Connected components of a table of links, by random-priority contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import drop_written, written

#: Whom the vertices follow is broadcast up to this many edges (at most twice as many rows of two numbers, 16 MB).
BROADCAST_EDGES = 500_000


def components(links: DataFrame) -> DataFrame:
    """``links``: ``a, b`` (bigint, not null). Returns ``id, component`` (smallest id) for every id in a link.

    Each round every vertex follows its neighbour (or itself) of least hashed priority, edges move to the vertices that
    were followed, and equal edges merge. Priorities are drawn anew every second round: with new ones a constant share of
    the vertices goes, whatever the shape, so the rounds grow with the logarithm of the largest component; with the same
    ones again a star, left around its least vertex, goes whole. Vertices' neighbours are only ever aggregated.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("at", F.col("id")), "labels")
    turn = 0
    while left := edges.count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn // 2), F.col(c)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        follow = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("u"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        follow = written(follow, "follow")
        to = F.broadcast(follow) if left <= BROADCAST_EDGES else follow
        moved = edges.join(to.withColumnsRenamed({"u": "a", "to": "ta"}), "a").join(to.withColumnsRenamed({"u": "b", "to": "tb"}), "b")
        new_edges = written(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        new_labels = written(labels.join(to.withColumnRenamed("u", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at")), "labels")
        for old in (edges, labels, follow):
            drop_written(old)
        edges, labels, turn = new_edges, new_labels, turn + 1
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(least, "at").select("id", "component")

"""A corpus pipeline of ``quernstone.llm`` operators over ``documents``: classify, deduplicate, decontaminate, mix, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, row_key, table, written
from quernstone.llm.decontaminate import clean_documents
from quernstone.llm.minhash_dedup import BROADCAST_IDS, near_duplicates
from quernstone.llm.queries import ACCEPT, quality_scores, tokenizer_path
from quernstone.llm.source_mix import mix_items, text_size
from quernstone.llm.token_output import token_output

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are judged by the thresholds' prior, rows that repeat alike."""
    scored = quality_scores(spark, docs, sf_dir, names=("__grade", "__accept"))
    return scored.where(F.col("__accept") >= ACCEPT).select(*docs.columns)


def sized(small: DataFrame) -> DataFrame:
    """To be broadcast up to ``BROADCAST_IDS`` rows of a few numbers, to be shuffled beyond."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id (null ids last, then by place in the table).

    Every row is a document of its own, whatever its id. Rows without words belong to no group and stay.
    """
    keyed = row_key(docs).withColumn("__key", F.pmod(F.xxhash64("__file", "__row"), F.lit(1 << 61)))
    with Scratch() as s:
        found = near_duplicates(keyed, id_col="__key").where("n_shingles > 0").select(F.col("doc_id").alias("__key"), "component_id")
        groups = found.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1")
        linked = written(found.join(groups.select("component_id"), "component_id"), "linked")
        named = linked.join(keyed.select("__key", F.col("doc_id").alias("id"), "__file", "__row"), "__key")
        named = written(named, "named")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__file", "__row")).alias("stays"))
        gone = named.join(first.select("component_id", F.col("stays.__file").alias("f"), F.col("stays.__row").alias("r")), "component_id").where("__file <> f or __row <> r")
        gone = s.keep(written(gone.select("__file", "__row"), "gone"))
    return keyed.join(sized(gone), ["__file", "__row"], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts stay, rows that repeat are judged alike."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it: repeats are further rows, and untaken rows go.

    Which of several rows alike in id, source and size are taken once more goes by their place in the table.
    """
    keyed = row_key(docs)
    with Scratch() as s:
        items = mix_items(docs).where("base + more > 0").withColumnsRenamed({"id": "i_id", "source": "i_source", "size": "i_size"})
        items = written(items.select("i_id", "i_source", "i_size", "n", "base", "more"), "items")
        places = keyed.select("doc_id", "source", text_size(F.col("text")).alias("size"), "__file", "__row")
        found = written(places.join(items, F.expr("doc_id <=> i_id and source <=> i_source and size = i_size")), "found")
        alike = ["doc_id", "source", "size"]
        several = found.where("n > 1")
        in_file = several.withColumn("i", F.row_number().over(Window.partitionBy(*alike, "__file").orderBy("__row")))
        files = several.groupBy(*alike, "__file").agg(F.count("*").alias("rows"))
        before = files.withColumn("before", F.sum("rows").over(Window.partitionBy(*alike).orderBy("__file")) - F.col("rows"))
        before = before.select(*[F.col(c).alias(f"b_{c}") for c in alike], F.col("__file").alias("b_file"), "before")
        placed = in_file.join(before, F.expr("doc_id <=> b_doc_id and source <=> b_source and size = b_size and __file = b_file"))
        copies = found.where("n = 1").select("__file", "__row", (F.col("base") + F.col("more")).alias("__copies"))
        copies = copies.unionByName(placed.select("__file", "__row", (F.col("base") + (F.col("i") + F.col("before") <= F.col("more")).cast("long")).alias("__copies")))
        taken = s.keep(written(copies.where("__copies > 0"), "taken"))
    both = keyed.join(sized(taken), ["__file", "__row"])
    return both.select(*docs.columns, F.explode(F.expr("sequence(1, __copies)")).alias("__copy")).drop("__copy")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and a row for each document row as read back from them (null texts: the end id alone)."""
    return token_output(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_files),
]

#: None: a trained classifier and seeded rounding are not SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch() as s:
            docs = s.keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs

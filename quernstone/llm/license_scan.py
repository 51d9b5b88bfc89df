"""License scans: base phrases, and licence templates through a positional rare-token index. DataFrame operations only.

Templates are the wordings of public licences and notices in ``license_texts``. Their longer words are counted over all
files; of each template the ``RAREST`` words of highest inverse document frequency make the index, which maps a word to its
templates and positions. All index words of a file are looked up, at all their places (the bound is on the index, per
template, never on a file), and postings of a template that agree on the relative position (file position less template
position) count together. A template is a candidate from ``COVER`` of the weight of its index words, and a match if its
mandatory key phrases stand in the file.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Base phrases count at all places where
their words stand consecutively.

Defined cases: null and empty texts have no words and no labels; rows that repeat a document
give equal rows; null ids are files too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import ascii_lower, written
from quernstone.llm.license_texts import TEMPLATES

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that alone say nothing of a licence.
COMMON = frozenset("this that with from under the and any are terms version work file following source code form subject copy person free you may can use provided permitted published charge files international binary program without all which have been will would should their these those each even hope part whole only being such other".split())
COVER, RAREST = 0.6, 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_words() -> list[tuple[str, int, str, int]]:
    """(word, template, label, position) of the templates' longer words."""
    out, k = [], 0
    for label, templates in TEMPLATES.items():
        for wording, _ in templates:
            words = re.findall("[0-9a-z]+", wording.lower())
            out += [(w, k, label, i) for i, w in enumerate(words) if w not in COMMON and len(w) > 3]
            k += 1
    return out


def positional_index(idf: dict[str, float], rarest: int = RAREST) -> list[tuple[str, int, str, int, float, float, int]]:
    """(word, template, label, position, weight, weight of the template, places of the template) of each template's ``rarest`` words."""
    out = []
    for k, group in itertools.groupby(template_words(), lambda r: r[1]):
        own = list(group)
        kept = set(sorted({w for w, *_ in own}, key=lambda w: (-idf[w], w))[:rarest])
        own = [r for r in own if r[0] in kept]
        whole = sum(idf[w] for w, *_ in own)
        out += [(w, k, label, i, idf[w], whole, len(own)) for w, _, label, i in own]
    return out


def _places(phrase: str) -> str:
    """SQL for the starts, from 0, of the phrase in ``words``."""
    parts = phrase.split()
    same = " and ".join(f"get(words, i + {j}) = '{w}'" for j, w in enumerate(parts))
    return f"filter(sequence(0, size(words) - 1), i -> {same})"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per file: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    vocabulary = sorted({w for w, *_ in template_words()})
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), words_of(text).alias("words"))
    listed = F.array(*map(F.lit, vocabulary))
    rows = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", listed), F.col("words")).alias("words"))
    rows = written(rows, "license-words")
    total = rows.count()
    files = rows.where("words is not null").groupBy("doc_id", "th").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    files = written(files, "license-files")
    # document frequencies of the templates' words, over all rows; the index has a row for each of their places: fixed tables
    own = files.select("copies", F.explode(F.array_intersect(F.col("words"), listed)).alias("word")).groupBy("word").agg(F.sum("copies").alias("df")).collect()
    df = {r.word: r.df for r in own}
    index = positional_index({w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary})
    index_df = F.broadcast(spark.createDataFrame(index, "word string, template int, label string, at int, weight double, whole double, size int"))
    words = F.array(*map(F.lit, sorted({w for w, *_ in index})))
    bound = F.array(F.struct("words", F.array_intersect("words", words).alias("looked")))
    hits = F.transform(bound, lambda z: F.filter(F.transform(z["words"], lambda w, i: F.named_struct(F.lit("pos"), i, F.lit("word"), w)), lambda p: F.array_contains(z["looked"], p["word"])))[0]
    looked = files.select("doc_id", "th", F.explode(hits).alias("p")).select("doc_id", "th", "p.pos", "p.word")
    votes = looked.join(index_df, "word").groupBy("doc_id", "th", "template", "label", (F.col("pos") - F.col("at")).alias("place")).agg(F.sum("weight").alias("got"), F.first("whole").alias("whole"), F.first("size").alias("size"), F.count("*").alias("n"))
    best = votes.where("n >= least(2, size)").groupBy("doc_id", "th", "template", "label").agg(F.max(F.col("got") / F.col("whole")).alias("cover")).where(F.col("cover") >= cover)
    keys = [(k, p) for k, (_, ps) in enumerate((t for ts in TEMPLATES.values() for t in ts)) for p in ps]
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    verified = functools.reduce(lambda a, b: a & b, [(F.col("template") != k) | F.contains(line, F.lit(f" {p} ")) for k, p in keys])
    method = best.join(files.withColumnsRenamed({"doc_id": "f_id", "th": "f_th"}), F.expr("th = f_th and doc_id <=> f_id")).where(verified)
    method = method.groupBy("doc_id", "th").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    method = written(method.withColumnsRenamed({"doc_id": "m_id", "th": "m_th"}), "license-method")

    base = rows
    for k, phrase in enumerate(BASE):
        base = base.withColumn(f"at{k}", F.when(F.array_contains("words", phrase.split()[0]) & F.array_contains("words", "license"), F.expr(_places(phrase))))
    base = base.withColumns({f"at{k}": F.coalesce(f"at{k}", F.array().cast("array<int>")) for k in range(len(BASE))}).drop("words")
    places = F.concat(*[f"at{k}" for k in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]))
    joined = base.join(method, F.expr("th = m_th and doc_id <=> m_id"), "left")
    every = F.array_union(labels, F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("cover", F.lit(0.0)))).alias("score"),
    )

"""Benchmark decontamination by template canonicalisation. DataFrame operations only.

Numbers, names (capitalised words within a sentence) and units after numbers become typed placeholders, so that a
question with other parameters keeps its template. Names and units depend on the case of the text, so every text also has
a second form, ``UNCASED``: words without case, and only numbers as placeholders. Windows of ``WINDOW`` tokens of
either form of every document and of every benchmark item are joined by hash. Matches of an item at one place of a
document in one form count together: those at one offset between the two, and also those of a chain of offsets, each less
than the item's length from the one before (a copy with words put in or left out), where each window of the item counts
once, at its smallest offset. A place is contaminated if at least ``min_share`` of the item's windows match there and its slots
are consistent: within the matched windows, equal values in the item stand against equal values in the document, and the
other way round. What stands between or after them is the document's own.

Windows with fewer than ``LITERAL`` literal tokens say nothing and are left out; items shorter than a window are one
window of their own length. Items that have no window left in one of the two forms (short questions, rows of numbers) are
also found verbatim, by all of their words, numbers and names in sequence (third form, ``PLAIN``, case aside); an item of
one word only in a document that is that word. Items that are alike in a form (same template, and values that are equal
at the same slots) are one class of it: it is matched once and reported by its smallest item id, so a template with
very many fillings costs no more than one. Benchmark windows are broadcast up to ``BROADCAST_WINDOWS`` rows (16 bytes
each), joined by a shuffle beyond.

Defined cases: null and empty texts match nothing; null ids are documents too; repeated rows each count; an item without
an id makes documents contaminated, but is not named; an empty benchmark leaves all documents clean, an empty table gives
an empty result; other columns are ignored (or kept, in ``clean_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, written

WINDOW, LITERAL = 8, 4
BROADCAST_WINDOWS = 1_000_000
BROADCAST_IDS = 1_000_000
#: Forms of a text: typed placeholders; words without case, where only numbers are placeholders; words and numbers.
TYPED, UNCASED, PLAIN = 0, 1, 2
#: Units that become a placeholder behind a number (fixed values).
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inch", "inches", "yards", "l", "ml", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "months", "years", "mph", "kmh", "percent", "dollars", "euros", "pounds", "cents", "degrees", "meters", "metres", "grams", "kilograms", "kilometers")
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
_SEPARATORS = r"[\x00\x04-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def marked_tokens(text: Column) -> Column:
    """Tokens with their case lowered; names, numbers and units begin with their mark."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}]", " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;:] )(?=\p{Lu}\p{Ll})", NAME)
    numbers = F.regexp_replace(F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", ""), r"(?<![\p{L}\d])(\d+)\s?(?:(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\d]))?", f" {NUMBER}$1 {UNIT}$2 ")
    t = F.when(F.regexp_like(t, F.lit(r"\d")), numbers).otherwise(t)
    return F.filter(F.split(F.lower(t), _SEPARATORS), lambda w: (w != "") & (w != UNIT))


def template(tokens: Column) -> Column:
    """Marked tokens as typed placeholders."""
    return F.transform(tokens, lambda w: F.when(w < "\u0004", F.substring(w, 1, 1)).otherwise(w))


def uncased(tokens: Column) -> Column:
    """Marked tokens as words without case (capitals, as these also join the two forms of letters like sharp s) and numbers as placeholders."""
    return F.transform(tokens, lambda w: F.when(w > "\u0004", F.upper(w)).when(w.startswith(NUMBER), NUMBER).otherwise(F.upper(F.substring(w, 2, 1 << 30))))


def plain(tokens: Column) -> Column:
    """Marked tokens as words without case, numbers as they are."""
    return F.transform(tokens, lambda w: F.upper(F.when(w > "\u0004", w).otherwise(F.substring(w, 2, 1 << 30))))


FORMS = {TYPED: template, UNCASED: uncased, PLAIN: plain}


def window_hashes(tokens: Column, form: int, width: int) -> Column:
    """``pos`` (from 1) and ``h`` of the windows."""
    # tokens are bound once; named within the inner lambda, their expression would be evaluated for each window
    window = lambda t, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(form), F.slice(t, i, F.lit(width))).alias("h"))
    fits = lambda t: F.size(t) == 1 if width == 1 else F.size(t) >= width
    one = lambda t: F.when(fits(t), F.transform(F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: window(t, i))).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))
    return F.transform(F.array(FORMS[form](tokens)), one)[0]


def _classes(items: DataFrame) -> DataFrame:
    """``cid, item_id, form, marked, t`` of the items' classes in each form; ``items``: ``item_id, marked``."""
    # a form tells if some window has enough literal tokens; PLAIN is for items that have none in one of the two others
    tells = lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - WINDOW + 1, F.lit(1))), lambda i: F.size(F.filter(F.slice(t, i, F.lit(WINDOW)), lambda w: w > "\u0004")) >= LITERAL)
    both = tells(template(F.col("marked"))) & tells(uncased(F.col("marked")))
    slot = {TYPED: lambda w: w < "\u0004", UNCASED: lambda w: w.startswith(NUMBER), PLAIN: lambda w: F.lit(False)}
    values = lambda k: F.transform("marked", lambda w: F.when(slot[k](w), w).otherwise(""))
    forms = F.array(*[F.struct(F.lit(k).alias("form"), make(F.col("marked")).alias("t"), values(k).alias("values")) for k, make in FORMS.items()])
    every = items.where(F.size("marked") > 0).select("item_id", "marked", both.alias("both"), F.explode(forms).alias("f")).select("item_id", "marked", "both", "f.*").where((F.col("form") != PLAIN) | ~F.col("both"))
    every = every.withColumn("cid", F.xxhash64("form", "t", F.expr("transform(values, v -> if(v = '', 0, array_position(values, v)))")))
    first = F.min(F.struct(F.col("item_id").isNull(), "item_id", "marked", "t")).alias("m")
    return every.groupBy("cid", "form").agg(first).select("cid", "m.item_id", "form", "m.marked", "m.t")


def _class_windows(classes: DataFrame) -> DataFrame:
    """``cid, form, width, at, h`` of windows with enough literal tokens, and of all windows of ``PLAIN``."""
    windows = classes.select("cid", "form", F.least(F.lit(WINDOW), F.size("t")).alias("width"), "t")
    windows = windows.select("cid", "form", "width", "t", F.explode(F.expr("sequence(1, size(t) - width + 1)")).alias("at"))
    part = F.slice("t", F.col("at"), F.col("width"))
    return windows.where((F.col("form") == PLAIN) | (F.size(F.filter(part, lambda w: w > "\u0004")) >= LITERAL)).select("cid", "form", "width", "at", F.xxhash64("form", part).alias("h"))


def _consistent(pairs: Column) -> Column:
    """Distinct pairs of values are one to one."""
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["x"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["y"]))) == F.size(pairs))


def leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document, item and place: ``doc_id, th, item_id, offset, matched, share`` (``th``: hash of the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    items = written(benchmark.select(F.col(item_col).alias("item_id"), marked_tokens(F.col(item_text_col)).alias("marked")), "items")
    classes = written(_classes(items), "item-classes")
    windows = written(_class_windows(classes), "item-windows")
    kinds = sorted((r.form, r.width) for r in windows.select("form", "width").distinct().collect())  # at most WINDOW values a form
    if not kinds:
        return rows.where("false").select("doc_id", "th", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("matched"), F.lit(0.0).alias("share"))
    fits = windows.count() <= BROADCAST_WINDOWS
    found = rows.select("doc_id", "th", marked_tokens(F.col("text")).alias("m"))
    found = found.select("doc_id", "th", F.explode(F.concat(*[window_hashes(F.col("m"), form, width) for form, width in kinds])).alias("w")).select("doc_id", "th", "w.pos", "w.h")
    own = windows.select("h", "cid", "form", "width", "at")
    hits = found.join(F.broadcast(own) if fits else own, "h").select("doc_id", "th", "cid", "form", "width", (F.col("pos") - F.col("at")).alias("offset"), "at")
    # rows that repeat a document match once each: distinct windows
    total = windows.groupBy("cid").agg(F.count("*").alias("windows")).join(classes.select("cid", F.size("t").alias("length")), "cid")
    place = ["doc_id", "th", "cid", "form", "width"]
    steps = hits.groupBy(*place, "offset").agg(F.collect_set("at").alias("ats")).join(total, "cid")
    order = Window.partitionBy("doc_id", "th", "cid").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag("offset").over(order) >= F.col("length"), F.lit(False)).cast("int")
    chains = steps.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.transform("ats", lambda a: F.struct(a.alias("at"), F.col("offset").alias("by")))
    chains = chains.groupBy(*place, "windows", "chain").agg(F.collect_list(F.struct("offset", here.alias("hits"))).alias("steps"))
    # each offset by itself, and all of a chain together
    union = F.array_sort(F.flatten(F.transform("steps", lambda x: x["hits"])))
    both = chains.withColumn("all", F.when((F.size("steps") > 1) & (F.col("form") != PLAIN), union))
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["at"] < x["at"]))
    every = F.when(F.col("all").isNotNull(), F.array(F.struct(F.array_min(F.transform("steps", lambda x: x["offset"])).alias("offset"), first.alias("hits"))))
    places = both.select(*place, "windows", F.explode(F.concat("steps", F.coalesce(every, F.slice("steps", 1, 0)))).alias("p"))
    places = places.select(*place, "windows", "p.offset", "p.hits", F.size("p.hits").cast("long").alias("matched")).withColumn("share", F.col("matched") / F.col("windows"))
    places = places.where(F.when(F.col("form") == PLAIN, F.col("matched") == F.col("windows")).otherwise(F.col("share") >= min_share))
    places = written(places, "places")
    # slots: the candidates' texts once more
    wanted = places.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).distinct()
    wanted = F.broadcast(wanted) if places.count() <= BROADCAST_IDS else wanted
    texts = rows.join(wanted, F.expr("th = w_th and doc_id <=> w_id"), "left_semi").groupBy("doc_id", "th").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), marked_tokens(F.col("text")).alias("words"))
    both = places.join(texts, F.expr("th = d_th and doc_id <=> d_id")).join(classes.select("cid", "item_id", "marked"), "cid")
    # only positions within matched windows
    covered = F.expr("array_distinct(flatten(transform(hits, a -> transform(sequence(a.at, a.at + width - 1), i -> struct(i, a.by)))))")
    pairs = F.expr("""transform(array(struct(marked as m, words as w)), z -> array_distinct(filter(transform(covered, c -> struct(get(z.m, c.i - 1) as x, get(z.w, c.i - 1 + c.by) as y)),
        p -> p.x < '\u0004' and p.y < '\u0004' and left(p.x, 1) = left(p.y, 1) and (form = 0 or form = 1 and left(p.x, 1) = '\u0002'))))[0]""")
    both = both.withColumn("covered", covered).withColumn("pairs", pairs).where(_consistent(F.col("pairs")))
    # one row for a place: the form with the greater share, the typed one if they are equal
    best = both.groupBy("doc_id", "th", "item_id", "offset").agg(F.max(F.struct("share", -F.col("form"), "matched")).alias("best"))
    return best.select("doc_id", "th", "item_id", "offset", "best.matched", "best.share")


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per contaminated document: ``doc_id, th, item_ids, n_matched, best_share``."""
    return leaks(docs, benchmark, **how).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("matched").alias("n_matched"), F.max("share").alias("best_share"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they are."""
    with Scratch() as s:
        bad = s.keep(written(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")), "contaminated"))
    same = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).eqNullSafe(F.col("bad_th")) & docs[id_col].eqNullSafe(F.col("bad_id"))
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, same, "left_anti")

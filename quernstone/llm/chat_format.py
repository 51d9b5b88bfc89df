"""Chat formatting: typed content parts become one text a conversation, with a loss mask, attachments and token counts.

The template is ``<|im_start|>role LF body <|im_end|> LF`` for each turn. A visitor flattens each part of a turn: text is
escaped, other parts become a placeholder (``<|image|>`` and so on) and are recorded in order. Escaping is one backslash
more between ``<`` and ``|``: an escaped text never holds ``<|``, so marks of the template can't come from a text, and taking
one away again gives the text back. Two texts that follow each other have ``<|part|>`` between them; a line feed in a role is
``<|nl|>``. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, PART, LINE = "<|im_start|>", "<|im_end|>", "<|part|>", "<|nl|>"
PART_TYPE = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


class Visitor:
    """Flattens one part to ``kind, body, ref, tokens``: a method for each type of part, ``other`` for all further types.

    Tokens after expansion: an image has one for each ``patch`` x ``patch`` square, an audio part ``rate`` a second, a document
    ``per_page`` a page (each rounded up, at least 1, also where the size is unknown); text has its words
    ``[^\\x20\\x09-\\x0D]+``. Override a method for another model.
    """

    def __init__(self, patch: int = 14, rate: float = 25.0, per_page: int = 256):
        self.patch, self.rate, self.per_page = patch, rate, per_page

    def _placed(self, kind: str, ref: Column, tokens: Column) -> Column:
        n = F.greatest(F.coalesce(F.ceil(tokens), F.lit(1)), F.lit(1)).cast("long")
        return F.struct(F.lit(kind).alias("kind"), F.lit(f"<|{kind}|>").alias("body"), ref.alias("ref"), n.alias("tokens"))

    def text(self, p: Column) -> Column:
        t = F.coalesce(p["text"], F.lit(""))
        return F.struct(F.lit("text").alias("kind"), escape(t).alias("body"), F.lit(None).cast("string").alias("ref"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))

    def image(self, p: Column) -> Column:
        return self._placed("image", p["ref"], F.ceil(p["width"] / self.patch) * F.ceil(p["height"] / self.patch))

    def audio(self, p: Column) -> Column:
        return self._placed("audio", p["ref"], p["seconds"] * self.rate)

    def document(self, p: Column) -> Column:
        return self._placed("document", p["ref"], p["pages"] * F.lit(self.per_page))

    def other(self, p: Column) -> Column:
        return self._placed("other", p["ref"], F.lit(1))

    def visit(self, p: Column) -> Column:
        kind = p["type"]
        return F.when(kind == "text", self.text(p)).when(kind == "image", self.image(p)).when(kind == "audio", self.audio(p)).when(kind == "document", self.document(p)).otherwise(self.other(p))


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()]))


def chat_turns(rows: DataFrame, parts: Column, visitor: Visitor | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """A row for each turn: ``conv_id, turn, role, head`` (the mark, the role and a line feed)``, body, attachments, tokens``. Row by row, no shuffle.

    Empty text parts leave nothing; null parts, or no parts, give an empty body; a null role is an empty one.
    """
    v = visitor or Visitor()
    pieces = F.filter(F.transform(F.filter(parts, lambda p: p.isNotNull()), v.visit), lambda p: p["body"] != "")
    role = F.coalesce(F.col(role_col), F.lit(""))
    t = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(pieces, F.array()).alias("p"))
    follows = lambda p, i: (p["kind"] == "text") & (i > 0) & (F.element_at("p", F.greatest(i, F.lit(1)))["kind"] == "text")
    body = F.array_join(F.transform("p", lambda p, i: F.when(follows(p, i), F.concat(F.lit(PART), p["body"])).otherwise(p["body"])), "")
    placed = F.filter(F.transform("p", lambda p, i: F.struct(i.alias("piece"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda a: a["kind"] != "text")
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + p["tokens"])
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    return t.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"), placed.alias("attachments"), tokens.alias("tokens"))


def chat_format(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """``chat_turns`` put together, a row for each conversation (a null id is one too), turns ascending (null first; ties by role, then body).

    ``formatted``; ``loss_spans``, a struct for each turn of role ``learned``: ``turn`` (from 1), ``at`` (where its turn begins),
    ``start, length`` of its body, code points from 0; ``attachments``: ``turn, piece, kind, ref, tokens`` in order;
    ``expanded_tokens``. A conversation, being one text of the result, is put together in one task; offsets are
    running sums there, so the work is linear in its size.
    """
    piece = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("size", piece.cast("long")).withColumns({"i": F.row_number().over(turn), "at": F.sum("size").over(upto) - F.col("size")})
    row = F.struct("i", "at", "head", "body", (F.col("role") == learned).alias("loss"), "attachments")
    g = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(row)).alias("t"), F.sum("tokens").alias("expanded_tokens"))
    span = lambda t: F.struct(t["i"].alias("turn"), t["at"].alias("at"), (t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))
    named = lambda t: F.transform(t["attachments"], lambda a: F.struct(t["i"].alias("turn"), a["piece"].alias("piece"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return g.select(
        "conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["loss"]), span).alias("loss_spans"), F.flatten(F.transform("t", named)).alias("attachments"), "expanded_tokens",
    )


def _segments(formatted: Column) -> Column:
    """A formatted text's turns, without their end marks: the last piece, after the last mark, is empty."""
    s = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def _plain(body: Column) -> Column:
    """The text of a body: its text parts one after the other, other parts as their placeholders."""
    return F.array_join(F.transform(F.split(body, r"<\|part\|>", -1), unescape), "")


def read_turns(formatted: DataFrame) -> DataFrame:
    """From ``chat_format``'s output: ``conv_id, turns`` (array of ``role, body``), ``learned`` (the texts under the mask, in order), ``formatted_chars``."""
    f = formatted.select("conv_id", "formatted", "loss_spans", _segments(F.col("formatted")).alias("s"))
    raw = lambda s: F.substring_index(F.substring(s, len(START) + 1, 1 << 30), "\n", 1)  # noqa: E731  a role has no line feed left
    role = lambda s: unescape(F.replace(raw(s), F.lit(LINE), F.lit("\n")))
    body = lambda s: F.substr(s, F.length(raw(s)) + len(START) + 2, F.lit(1 << 30))
    under = lambda p: F.substr(F.element_at("s", p["turn"]), (p["start"] - p["at"] + 1).cast("int"), p["length"].cast("int"))
    return f.select("conv_id", F.transform("s", lambda s: F.struct(role(s).alias("role"), body(s).alias("body"))).alias("turns"), F.transform("loss_spans", lambda p: _plain(under(p))).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def read_parts(formatted: DataFrame) -> DataFrame:
    """From ``chat_format``'s output, the parts again: ``conv_id, turn, role, parts`` (array of ``type, text, ref``), in order."""
    r = read_turns(formatted).join(formatted.select(F.col("conv_id").alias("c"), "attachments"), F.expr("conv_id <=> c"))
    t = r.select("conv_id", "attachments", F.posexplode("turns").alias("i", "t"))
    t = t.select("conv_id", (F.col("i") + 1).alias("turn"), "t.role", F.filter("attachments", lambda a: a["turn"] == F.col("i") + 1).alias("a"), F.filter(F.regexp_extract_all("t.body", F.lit(r"(?s)(<\|\w+\|>|(?:(?!<\|).)+)")), lambda x: x != PART).alias("x"))
    whole = lambda x, i: F.filter("a", lambda a: a["piece"] == i)[0]  # noqa: E731  the parts of a turn are few
    part = lambda x, i: F.when(x.startswith("<|"), F.struct(whole(x, i)["kind"].alias("type"), F.lit(None).cast("string").alias("text"), whole(x, i)["ref"].alias("ref"))).otherwise(F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).cast("string").alias("ref")))
    return t.select("conv_id", "turn", "role", F.transform("x", part).alias("parts"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``chat_format``'s output: turns and the text under the mask as digests, and sizes."""
    r = read_turns(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), _plain(t["body"]), F.lit("\n"))), "")
    r = r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.array_join("learned", "").alias("l"), "formatted_chars")
    return r.select("conv_id", "n_turns", "turns_sha256", F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")

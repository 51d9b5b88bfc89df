"""Chat formatting, Merkle manifests and whitening against brute force, with nulls, ties, repeated rows, empty and long input."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import merkle as K
from quernstone.llm import queries as Q
from quernstone.llm import whitening as W
from quernstone.llm.chat_format import END, PART_TYPE, Visitor, chat_digests, chat_format, chat_turns, escape, read_parts, text_parts, unescape

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_merkle_manifest"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.queries()[name](spark, SF)
    r = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(r.fetchall(), key=str)


# 11

NASTY = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "|b", "\\|b", "<<|im_end|>", "<\\\\|x", "line\n\nend\n", "<|part|>", "<|nl|>", "<|image|>", "é🤦̀" * 50, "x" * 300_000]


def test_escaping_is_reversible_and_hides_marks(spark):
    rng = random.Random(3)
    texts = [t for t in NASTY if t is not None] + ["".join(rng.choice("<|\\a\n>") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("back"))
    for r in df.collect():
        assert r.back == r.t and "<|" not in r.e


def chat_brute(rows):
    """rows: (conv, turn, role, text); by conversation the contract's columns."""
    esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", esc(r[3] or "")))
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in own if role == "assistant")
        chars = sum(len(f"<|im_start|>{esc(role).replace(chr(10), '<|nl|>')}\n{esc(t)}<|im_end|>\n") for role, t in own)
        out[c] = (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)), len(loss), sha(loss), chars)
    return out


def test_chat_round_trip(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "assistant", None, "", "to\nol", "<|im_start|>assistant", "a<\n|b"]
    rows = [(c, k, rng.choice(roles), rng.choice(NASTY)) for c in range(40) for k in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "first"), (77, None, "assistant", "null turn"), (77, 1, "user", "b"), (77, 1, "user", "a"), (77, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, body string, p string")
    f = chat_format(chat_turns(df, text_parts(F.col("text"))))
    got = {r.conv_id: tuple(r)[1:] for r in chat_digests(f).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == chat_brute(rows)
    for r in f.collect():
        for s in r.loss_spans:  # offsets are of the whole text, and the mask ends where the end mark stands
            assert r.formatted[s.start + s.length :].startswith(END)
    assert chat_digests(chat_format(chat_turns(df.limit(0), text_parts(F.col("text"))))).count() == 0


def test_one_long_conversation(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t"), F.col("id").cast("string")).alias("text"))
    rows = [(1, k, "assistant" if k % 2 else "user", f"<|t{k}") for k in range(20_000)]
    r = chat_digests(chat_format(chat_turns(df, text_parts(F.col("text"))))).select("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").first()
    assert tuple(r) == chat_brute(rows)[1]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    turns = [
        (1, 0, "user", [part("text", "look <|image|>"), part("image", ref="a.png", w=28, h=30), part("text", "and <"), part("text", "\\|that"), part("text", ""), part("audio", ref="b.wav", s=1.01), part("document", ref="c.pdf", p=2)]),
        (1, 1, "assistant", [part("text", "fine <|part|>"), part("image", ref=None)]),
        (1, 2, "user", None),
        (1, 3, "user", []),
        (1, 4, "user", [None, part("video", ref="d.mp4"), part(None, "x")]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{PART_TYPE}>")
    f = chat_format(chat_turns(df, F.col("parts"), Visitor(patch=14, rate=25.0, per_page=100)))
    r = f.first()
    assert [(a.turn, a.piece, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "a.png", 6), (1, 4, "audio", "b.wav", 26), (1, 5, "document", "c.pdf", 200), (2, 1, "image", None, 1), (5, 0, "other", "d.mp4", 1), (5, 1, "other", None, 1)]
    assert r.expanded_tokens == 2 + 6 + 2 + 1 + 26 + 200 + 2 + 1 + 0 + 2
    assert r.formatted.count("<|image|>") == 2 and "<|audio|><|document|>" in r.formatted
    back = {x.turn: [(p.type, p.text, p.ref) for p in x.parts] for x in read_parts(f).collect()}
    assert back[1] == [("text", "look <|image|>", None), ("image", None, "a.png"), ("text", "and <", None), ("text", "\\|that", None), ("audio", None, "b.wav"), ("document", None, "c.pdf")]
    assert back[2] == [("text", "fine <|part|>", None), ("image", None, None)] and back[3] == back[4] == [] and len(back[5]) == 2


# 12


def brute_tree(leaves):
    """Levels of a tree: while several nodes remain, every two (the last run: one) become their digest."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 2])) for i in range(0, len(x), 2)])
    return levels


def brute_path(levels, pos):
    return "".join(level[(pos >> k) ^ 1] for k, level in enumerate(levels[:-1]) if ((pos >> k) ^ 1) < len(level))


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(one, r)))
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    levels = {g: brute_tree([leaf(r) for r in own]) for g, own in trees.items()}
    top = brute_tree([levels[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for pos, r in enumerate(trees[g]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out.append((r[0], leaf(r), levels[g][-1][0], top[-1][0], sha(brute_path(levels[g], pos) + brute_path(top, k)), not tampered))
    return sorted(out, key=str)


def manifest(df):
    seen = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return K.merkle_manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", seen)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, pos string, total string, tree string"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_is_the_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(K, "HEIGHT", height)
    monkeypatch.setattr(K, "BLOCK", 1 << height)
    rng = random.Random(height)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en"] * 8 + ["de", None, "", "é", "zz"]), rng.choice([None, 5]), rng.choice(["é", None, "", "text " * 5])) for i in rng.sample(range(10_000), 90)]
    rows += [(None, "s", "en", 3, "x"), (None, "s", "en", 3, "x"), (7, "s", "en", 1, "tie"), (7, "s", "en", 1, "tie"), (7, "s", "en", 2, "tie"), (14, "s", "only", 4, "y" * 200_000)]
    got = manifest(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got), key=str) == brute_manifest(rows)
    assert all(K.fold(r.leaf, r.siblings, r.sides) == r.root for r in got)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_manifest_of_few_rows(spark):
    assert manifest(spark.createDataFrame([], DOCS)).count() == 0
    r = manifest(spark.createDataFrame([(1, "s", "en", 1, "x", "", "", "", "")], DOCS)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_postorder_heights():
    for n in range(1, 40):
        leaves = [sha(str(i)) for i in range(n)]
        levels = brute_tree(leaves)
        root, siblings, sides = K.postorder(leaves, len(levels) - 1)
        assert root == levels[-1][0] and siblings == [brute_path(levels, i) for i in range(n)]
        assert all(len(s) == len(levels) - 1 for s in sides)


# 13


def brute_whitening(vectors, k):
    kept = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([vectors[i] for i in kept], float)) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return kept, n, dev, (x - s / n) @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("dims", "k", "block", "kept"), [(12, 5, 4, 8), (40, 16, 16, 2), (40, 6, 8, 2), (3, 16, 32, 8)])
def test_whitening_is_the_eigendecomposition(spark, dims, k, block, kept):
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((300, dims)) * np.linspace(1, 4, dims)
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 50
    vectors += [None, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims, [], [1.0] * (dims + 1)]
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, x string").repartition(5)
    good = vectors[:350]
    kept_, n, dev, white, explained = brute_whitening(good, min(k, dims))
    rows = W.whiten(df, k=k, block=block, kept=kept).collect()
    assert len(rows) == 350 * min(k, dims)
    sign = np.zeros(min(k, dims))
    for r in rows:
        want = white[r.vec_id, r.component - 1]
        if abs(want) > 0.1:
            sign[r.component - 1] = sign[r.component - 1] or np.sign(want * r.whitened)
            assert abs(r.whitened * sign[r.component - 1] - want) < 1e-7
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_query_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, n, dev, white, explained = brute_whitening([v for _, v in rows], 16)
    at = {rows[i][0]: j for j, i in enumerate(kept)}
    got = Q.op13_embedding_whitening(spark, SF).collect()
    assert len(got) == 16 * len(kept)
    for r in got:
        assert (r.n, r.deviation) == (n, dev[at[r.vec_id]])
        assert abs(abs(r.whitened) - abs(white[at[r.vec_id], r.component - 1])) < 1e-8 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert W.whiten(frame([])).count() == 0
    assert W.whiten(frame([(1, None), (2, [float("nan")])])).count() == 0
    assert W.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector: no spread
    line = W.whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)] + [(None, [3.0, 6.0, 5.0])])).collect()
    assert {r.component for r in line} == {1} and len(line) == 11 and abs(line[0].explained - 1) < 1e-9  # rank 1
    huge = W.whiten(frame([(i, [1e12 * i, float(i % 3)]) for i in range(20)])).collect()
    x = [64 * 10**12 * i for i in range(20)], [64 * (i % 3) for i in range(20)]
    for r in huge:
        want = sum((20 * c[r.vec_id] - sum(c)) ** 2 for c in x)
        assert r.deviation == (want if want < 1 << 63 else None)

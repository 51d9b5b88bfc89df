"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of lexicon words, of lexicon stems and of lexicon words behind obfuscation, their counts, closeness of such words
to second-person pronouns, shares of capitals, punctuation and symbols, obfuscation rates. The lexicon holds fixed
insults and the words and stems that training documents labelled toxic have far more often than others. Trees
are fitted on second-order logistic gradients over binned features. Raw scores of two folds, each predicted with the
lexicon and the trees that were learned from the other fold alone, give the isotonic map to probabilities.

Fitted on at most ``sample_rows`` labelled training rows (a documented bound; of rows that repeat an id, the text that is
least in byte order stands for it); every row is scored on its whole text.

Defined cases: null and empty texts have zero features and a score like any other; with one label value only, scores are that value's
share (0 without any); rows without a label are not learned from; null ids are scored; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written
from quernstone.llm.quality import sample_texts, sampled_ids
from quernstone.llm.shingles import bytes_to_words

#: Common insults, and second-person pronouns of four languages.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "bastard", "hate", "kill", "ugly", "filthy", "vermin", "retard", "shut")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "vosotros")
STEM = 6
NEAR = 6

_words = bytearray(b" " * 256)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128:
        _words[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _words[_b] = _b
WORD_BYTES = bytes(_words)
_plain = bytearray(WORD_BYTES)
for _from, _to in zip(b"013457@$!|", b"oieastasil", strict=True):
    _plain[_from] = _to
PLAIN_BYTES, PLAIN_DROP = bytes(_plain), b"*_-'"
# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 '!', 5 '?', 6 other ASCII punctuation, 7 white space
_CLASS = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "!" else 5 if _c == "?" else 7 if _c in " \t\n\r\x0b\x0c" else 6 if _b > 32 else 0
_CLASS[128:] = 1
_DISGUISE = np.zeros(256, bool)
_DISGUISE[list(b"013457@$!|*")] = True

FEATURES = ("word_density", "word_count", "stem_density", "stem_count", "plain_density", "disguised", "near_you", "near_you_density", "capitals", "exclamation", "question", "punctuation", "digits", "disguise_rate", "log_words", "kinds")


@dataclass
class Lexicon:
    """Words and stems as their UTF-8 bytes, one character a byte (a stem may end within a character)."""

    words: tuple[str, ...]
    stems: tuple[str, ...] = ()
    _made: dict = field(default_factory=dict, repr=False)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self._made:
            of = lambda ws: np.sort(bytes_to_words(" ".join(ws).encode("latin-1"), WORD_BYTES)[0]) if ws else np.zeros(0, np.uint64)
            self._made["all"] = (of(self.words), of(self.stems), of([w.encode().decode("latin-1") for w in SECOND_PERSON]))
        return self._made["all"]


def _is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def text_features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    data = (text or "").encode("utf-8")
    out = np.zeros(len(FEATURES))
    if not data:
        return out
    words, stems, you = lexicon.hashes()
    hashes, _, heads = bytes_to_words(data, WORD_BYTES, STEM)
    arr = np.frombuffer(data, np.uint8)
    n_class = np.bincount(_CLASS[arr], minlength=8).astype(float)
    letters, size, n = max(1.0, n_class[1] + n_class[2]), float(len(arr)), max(1, len(hashes))
    hit, stem = _is_in(hashes, words), _is_in(heads, stems)
    plain = _is_in(bytes_to_words(data.translate(None, PLAIN_DROP), PLAIN_BYTES)[0], words)
    bad = np.flatnonzero(hit | stem)
    near = 0
    if len(bad):
        at = np.flatnonzero(_is_in(hashes, you))
        if len(at):
            k = np.searchsorted(at, bad)
            gap = np.minimum(np.abs(bad - at[np.minimum(k, len(at) - 1)]), np.abs(bad - at[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
    letter = (_CLASS[arr] == 1) | (_CLASS[arr] == 2)
    disguise = int((letter[:-2] & _DISGUISE[arr[1:-1]] & letter[2:]).sum()) if len(arr) > 2 else 0
    out[:] = (
        100 * hit.sum() / n, hit.sum(), 100 * stem.sum() / n, stem.sum(), 100 * plain.sum() / n, max(0, int(plain.sum()) - int(hit.sum())), near, 100 * near / n,
        n_class[2] / letters, 100 * n_class[4] / size, 100 * n_class[5] / size, 100 * n_class[6] / size, 100 * n_class[3] / size, 100 * disguise / n, np.log1p(len(hashes)), len(np.unique(hashes[hit])),
    )
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth as arrays: node k has children 2k + 1 and 2k + 2; goes right if x > cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw, feature, cut, leaf = np.full(n, base), [], [], []
    inner = 2**depth - 1
    slot = (np.arange(d) * bins)[None, :] + code
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first) * d * bins)[:, None] + slot
            gs, hs = (np.bincount(at.ravel(), np.repeat(v, d), count * d * bins).reshape(count, d, bins).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain = np.where((hs >= least) & (ht - hs >= least), gain, 0.0)
            for k in range(count):
                best = int(gain[k].argmax())
                j, b = divmod(best, bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], c[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        own = node - inner
        value = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + ridge)
        raw += value[own]
        feature.append(f)
        cut.append(c)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaf), depth)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean raw score, rate) of each pool, both ascending."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, t in zip(raw[order], y[order], strict=True):
        pools.append([t, 1.0, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, x2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2] + x2]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        even = np.interp(raw, *self.knots)
        # a thousandth of the raw probability keeps the order within a pool
        return np.clip(0.999 * even + 0.001 / (1 + np.exp(-np.clip(raw, -40, 40))), 0.0, 1.0)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct words and stems (marked) with its fold and label."""
    for batch in batches:
        for fold, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = set((text or "").encode("utf-8").translate(WORD_BYTES).split())
            rows = [w.decode("latin-1") for w in words] + [">" + s.decode("latin-1") for s in {w[:STEM] for w in words if len(w) > STEM}]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([fold] * len(rows), pa.int32()), pa.array([label] * len(rows), pa.int32())], names=["kind", "fold", "label"])


def _feature_rows(lexicons: list[Lexicon]):
    """Features under each lexicon, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.concatenate([text_features(t, lexicon) for lexicon in lexicons]).tolist() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "fold", "label", "x"])

    return run


def _learned(kinds: DataFrame, folds: tuple[int, ...], counts: dict[tuple[int, int], int], lexicon_words: int) -> Lexicon:
    """The fixed insults, and the kinds that toxic documents of ``folds`` have far more often. ``kinds``: ``kind, fold, t, c``."""
    n1, n0 = (max(1, sum(counts.get((f, label), 0) for f in folds)) for label in (1, 0))
    odds = F.log(((F.col("t") + 0.5) / n1) / ((F.col("c") + 0.5) / n0))
    sums = kinds.where(F.col("fold").isin(*folds)).groupBy("kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = sums.where("t >= 4").withColumn("odds", odds).where("odds > 2.2").orderBy(F.desc("t"), "kind").limit(lexicon_words).collect()
    return Lexicon(tuple(sorted({*INSULTS, *(r.kind for r in best if r.kind[0] != ">")})), tuple(sorted(r.kind[1:] for r in best if r.kind[0] == ">")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, lexicon_words: int = 300, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """``labels``: ``doc_id, label`` (0 or 1) of training rows.

    At most ``sample_rows`` labelled rows are learned from, and at most ``lexicon_words`` words and pairs of words that tell toxic rows from
    others join the fixed lexicon; neither bounds what is scored.
    """
    spark = docs.sparkSession
    ids = sampled_ids(labels.where("label is not null"), ["label"], sample_rows).collect()  # at most sample_rows rows
    share = float(np.mean([r.label for r in ids])) if ids else 0.0
    if len({r.label for r in ids}) < 2:
        return ToxicityModel(Lexicon(INSULTS), None, (np.zeros(1), np.zeros(1)), share)
    # an id's rows are in one fold
    place = {i: k % 2 for k, i in enumerate(dict.fromkeys(r.doc_id for r in ids))}
    sample = spark.createDataFrame([(r.doc_id, place[r.doc_id], r.label) for r in ids], "doc_id bigint, fold int, label int")
    texts = written(sample_texts(docs, sample, id_col, text_col).select("doc_id", "fold", "label", "text"), "toxicity-sample")
    counts: dict[tuple[int, int], int] = {}
    for r in ids:
        counts[place[r.doc_id], r.label] = counts.get((place[r.doc_id], r.label), 0) + 1
    kinds = texts.select("fold", "label", "text").mapInArrow(_kinds, "kind string, fold int, label int")
    kinds = written(kinds.groupBy("kind", "fold").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "toxicity-kinds")
    lexicons = [_learned(kinds, folds, counts, lexicon_words) for folds in ((0,), (1,), (0, 1))]
    rows = texts.mapInArrow(_feature_rows(lexicons), "doc_id bigint, fold int, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    x, y, fold = np.array([r.x for r in rows]).reshape(len(rows), 3, len(FEATURES)), np.array([r.label for r in rows], float), np.array([r.fold for r in rows])
    if len(set(zip(fold.tolist(), y.tolist(), strict=True))) < 4:  # a fold of one label calibrates nothing: the trees' own probabilities
        even = np.linspace(-8, 8, 65)
        return ToxicityModel(lexicons[2], fit_trees(x[:, 2], y), (even, 1 / (1 + np.exp(-even))), share)
    raw = np.zeros(len(rows))
    for k in (0, 1):
        raw[fold == k] = fit_trees(x[fold != k, 1 - k], y[fold != k]).raw(x[fold == k, 1 - k])
    return ToxicityModel(lexicons[2], fit_trees(x[:, 2], y), isotonic(raw, y), share)


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x = np.stack([text_features(t, model.lexicon) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, score, predicted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))

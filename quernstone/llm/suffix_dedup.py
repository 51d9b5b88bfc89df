"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix matters only through its first ``WIDTH`` bytes (a window). Suffixes are sorted into ever finer groups by
most-significant-digit passes; the groups after the last digit are exactly the equal windows, and a window is repeated
if its group has two members. Digits are taken outward from an anchor: the ``GRAM``-byte string of least hash inside
the window, a function of the window's bytes alone, so equal windows have equal anchors at equal offsets. The anchor is
the first digit; neighbouring suffixes share it, and travel as one record (anchor position, range of offsets) until a
digit tells them apart. Each pass cuts records into narrower ranges of offsets, where the bytes common to the range
(its core) are the digits known so far, and the bytes of all its windows (its union) are all there are:

- unions equal to another record's: all windows of the range are repeated; done;
- a core that no other record has: no window is; done;
- otherwise the range is cut into ``CUTS[k]``-wide ones for the next pass, until ranges are single windows.

In the terms of a most-significant-digit sort: read the bytes of a window outward from its anchor. The first digit is the
anchor's ``GRAM`` bytes with its offset's place; pass k (``CUTS[k]``) takes as its digit the bytes that come newly into the
core when ranges narrow from ``CUTS[k - 1]`` to ``CUTS[k]`` offsets, on either side of it; the last, of width 1, has the
whole 400 bytes in the core. A core's digest names a group of equal leading digits, so the groups of a pass are those of
the pass before cut by one more digit, the sort stops at ``WIDTH`` bytes, and groups of one member (or of unions that are
equal throughout) are left out of later passes as in any radix sort. Which order groups of different digits have among each
other plays no part in which windows are equal, so digests stand for digits and groups are not put in order.

Of equal unions one record goes on as a partner of the others. Groups are only counted, never gathered, so a passage in
a third of all documents takes no task more. Long texts are read in slices; a record cut by a slice is settled by later
passes.

Defined cases: null text is empty; texts under ``WIDTH`` bytes lose nothing; overlapping repeats within one text count;
rows that repeat an id and text are separate copies (all their windows repeat); null ids are documents too; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import drop_written, written

WIDTH, GRAM = 400, 192
OFFSETS = WIDTH - GRAM + 1
CUTS = (32, 4, 1)
SLICE = 1 << 18
#: Documents with open records are found by a broadcast up to this many, by a shuffle beyond.
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 63, 256, np.uint64)
_STEP = np.random.Generator(np.random.PCG64(29)).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(arr: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (192 = 128 + 64) bytes from each position."""
    h, size, k = _RANDOM[arr], 1, 0
    at = {}
    while size < 128:
        h = h[:-size] * _STEP[k] + h[size:]
        size, k = size * 2, k + 1
        at[size] = h
    n = len(arr) - GRAM + 1
    h = at[128][:n] * _STEP[k] + at[64][128 : 128 + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(arr: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records for the windows beginning at ``starts`` (ascending): anchor, least and greatest start, anchor's hash."""
    h = _gram_hashes(arr)
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: leftmost
    size = 1
    while size * 2 <= OFFSETS:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = OFFSETS - size
    v = np.minimum(v[: len(v) - rest], v[rest:])
    at = (v[starts] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
    end = np.append(cut[1:], len(starts)) - 1
    return at[cut], starts[cut], starts[end], h[at[cut]].astype(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of whole short texts, or slices of long ones: (document, its offset in the buffer, offset in the text, bytes)."""
    buffer: list[bytes] = []
    held: list[tuple[int, int, int, int]] = []
    size = 0
    for i, b in enumerate(texts):
        if len(b) < WIDTH:
            continue
        for at in range(0, len(b) - WIDTH + 1, SLICE):
            part = b if len(b) <= SLICE else b[at : at + SLICE + WIDTH - 1]
            if size and size + len(part) > SLICE:
                yield b"".join(buffer), held
                buffer, held, size = [], [], 0
            held.append((i, size, at, len(part)))
            buffer.append(part)
            size += len(part)
            if len(b) <= SLICE:
                break
    if held:
        yield b"".join(buffer), held


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            ids, hashes = part.column(0), part.column(1)
            texts = [(t or "").encode() for t in part.column(2).to_pylist()]
            for buffer, held in _pieces(texts):
                arr = np.frombuffer(buffer, np.uint8)
                starts = np.concatenate([np.arange(at, at + n - WIDTH + 1) for _, at, _, n in held])
                pos, first, last, anchor = anchors(arr, starts)
                where = np.searchsorted(np.array([at for _, at, _, _ in held]), first, "right") - 1
                shift = np.array([text_at - at for _, at, text_at, _ in held])[where]
                doc = pa.array(np.array([i for i, *_ in held])[where])
                low, high = pos - last, pos - first
                spans = zip(first.tolist(), (last + WIDTH).tolist(), (low * 512 + high).tolist(), strict=True)
                union = [xxhash.xxh3_128_digest(buffer[a:b], s) for a, b, s in spans]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(doc), hashes.take(doc), pa.array(pos + shift), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(anchor), pa.array(union, pa.binary())],
                    names=["doc_id", "th", "pos", "low", "high", "core", "whole"],
                )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open record's windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("low", pa.int16()), ("high", pa.int16()), ("partner", pa.bool_()), ("bytes", pa.binary())])
    for batch in batches:
        for i, th, text, opened in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = (text or "").encode()
            rows = [{"doc_id": i, "th": th, **r, "bytes": b[r["pos"] - r["high"] : r["pos"] - r["low"] + WIDTH]} for r in opened]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[k : k + 4096], schema=schema)


def _cut(width: int):
    """Ranges of a record's windows, ``width`` offsets each, with digests of core and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "low", "high", "partner", "core", "whole"]
        kinds = [pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary(), pa.binary()]
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for rid, top, b, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in ranges:
                    for node in range(r["low"] // width * width, r["high"] + 1, width):
                        low, high = max(r["low"], node), min(r["high"], node + width - 1)
                        whole = digest(b[top - high : top - low + WIDTH], low * 512 + high)
                        core = whole if width == 1 else digest(b[top - node : top - node - width + 1 + WIDTH], node)
                        out.append((rid, low, high, r["partner"], core, whole))
                if len(out) > 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _settle(records: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """(records whose windows are all repeated, records that go on) of one pass; ``keys`` name a record."""
    often = written(records.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), f"{tag}-cores")
    met = written(records.join(often, "core"), f"{tag}-met")
    equal = written(met.groupBy("whole").agg(F.count("*").alias("w"), F.min(F.struct(*keys, "low", "high")).alias("one"), F.first("core").alias("core")).where("w > 1"), f"{tag}-equal")
    repeated = written(met.where("not partner").join(equal.select("whole"), "whole").select(*keys, "low", "high"), f"{tag}-repeated")
    mixed = written(met.join(equal.select("whole"), "whole", "left_anti").select(*keys, "low", "high", "partner", "core"), f"{tag}-mixed")
    open_cores = mixed.where("not partner").select("core").distinct()
    partners = equal.join(open_cores, "core", "left_semi").select("one.*", F.lit(True).alias("partner"))
    # partners alone in a core have nothing left to tell
    going = mixed.join(open_cores, "core", "left_semi").drop("core").unionByName(partners)
    going = written(going, f"{tag}-open")
    for done in (often, met, equal, mixed):
        drop_written(done)
    return repeated, going


def _lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge spans, remove them, and describe what is left."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for i, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = (text or "").encode()
            runs: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            kept, at = hashlib.sha256(), 0
            for a, z in runs:
                kept.update(b[at:a])
                at = z
            kept.update(b[at:])
            for k, v in zip(rows, (i, len(b), sum(z - a for a, z in runs), len(runs), kept.hexdigest(), [x for r in runs for x in r]), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=list(rows))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs``: ``doc_id, th, text``. Returns ``doc_id, th, a, b``: byte ranges that repeated windows cover."""
    schema = "doc_id bigint, th bigint, pos bigint, low smallint, high smallint, core bigint, whole binary"
    records = written(docs.mapInArrow(_records, schema), "records").withColumn("partner", F.lit(False))
    where = ["doc_id", "th", "pos"]
    repeated, going = _settle(records, where, "root")
    span = lambda df: df.select("doc_id", "th", (F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + WIDTH).alias("b"))
    spans = [span(repeated)]
    opened = going.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "low", "high", "partner")).alias("opened"))
    opened = written(opened.select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), "opened"), "opened")
    same = F.expr("doc_id <=> o_id and th = o_th")
    keys = opened.select("o_id", "o_th")
    texts = docs.join(F.broadcast(keys), same, "left_semi") if opened.count() <= BROADCAST_IDS else docs
    found = texts.join(opened, same).select("doc_id", "th", "text", "opened")
    held = found.mapInArrow(_contexts, "doc_id bigint, th bigint, pos bigint, low smallint, high smallint, partner boolean, bytes binary")
    held = written(held.withColumn("rid", F.monotonically_increasing_id()), "contexts")
    going = held.select("rid", "low", "high", "partner")
    base = held.select("rid", "doc_id", "th", "pos", F.col("high").cast("int").alias("top"), "bytes")
    for width in CUTS:
        ranges = going.groupBy("rid").agg(F.collect_list(F.struct("low", "high", "partner")).alias("ranges"))
        cut = base.join(ranges, "rid").select("rid", "top", "bytes", "ranges").mapInArrow(_cut(width), "rid bigint, low smallint, high smallint, partner boolean, core binary, whole binary")
        repeated, going = _settle(written(cut, f"cut{width}"), ["rid"], f"cut{width}")
        spans.append(span(repeated.join(base.drop("bytes", "top"), "rid")))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, removed_share, spans``.

    ``has_repeats``: some byte is removed; ``removed_share``: removed bytes over all (0 for empty texts); ``spans``: starts and
    ends of removed runs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(rows).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = written(spans.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans"), "spans")
    both = rows.join(spans, F.expr("th = s_th and doc_id <=> s_id"), "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(_lose, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
    share = F.col("n_removed") / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), share.alias("removed_share"), "spans")

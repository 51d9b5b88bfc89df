"""Token ids in a compact binary format: canonical length-limited Huffman blocks.

Writing: texts become ids (one scan; ids go to an intermediate table), the ids of all documents are counted, and the
counts give one canonical code whose lengths are at most ``limit`` bits (package-merge). Documents are dealt by ranges
of ``doc_id`` and encoded in ascending order. A file row is an independent block of whole documents: the bit stream
(big-endian, 32-bit words), a bit-offset checkpoint for every ``LANE`` ids, and the documents' ids and counts. The code
itself is a table ``id, bits`` beside the blocks; canonical codes need no more. Blocks live in Parquet containers, so
Spark's commit protocol decides which task attempt's output counts.

Reading: a lookup table over ``limit`` bits gives a code's id and length; all checkpoints of a batch of blocks advance
side by side, one id a step.

Defined cases: null text is empty and yields the end id alone; null ``doc_id`` sorts first; rows with equal ids are
ordered by a hash of their token ids (equal rows follow each other); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import drop_written, hand_back, lean, new_path, small_batches, small_table, written

LANE = 128
BLOCK_IDS = 1 << 16

# Texts of these characters are cut into pieces here, with the classes that the tokenizer's own pattern has on them;
# all other texts go to the library whole.
_SAFE = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ–—‘-„…]*")
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t\n\r "
# Words and numbers come first, as most pieces are; a contraction begins with an apostrophe, so the order among these three is free.
_PIECE = re.compile(rf" ?[{_LETTER}]+| ?[{_DIGIT}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(own))
    letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Recent(dict):
    """A memo of bounded size: when full it keeps the last generation only."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


def _cuts_pieces(spec: dict) -> bool:
    """Byte-level BPE with the pattern of ``_PIECE``: no normaliser, no space put in front, plain merges."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    odd = any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return bool(level and plain and not odd and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


class Encoder:
    """Whole texts to ids with the ``tokenizers`` library, special tokens not added.

    Byte-level BPE merges within the pieces of its split pattern only, so a piece's ids never depend on its
    neighbours; pieces are remembered. That holds for files of the form
    ``_cuts_pieces`` tells; with any other file the library encodes whole texts.
    """

    def __init__(self, path: str, memo: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tok.model, byte_letters()
        self.cuts = _cuts_pieces(json.loads(self.tok.to_str()))
        self.pieces = Recent(self._piece, memo)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            piece = piece.replace(" ", self.letters[32])
        else:
            letters = self.letters
            piece = "".join([letters[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.cuts or not _SAFE.fullmatch(text) or any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, packages = [], leaves[:0]
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[used] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    codes, code, at = np.zeros(len(bits), np.uint32), 0, 0
    for i in order:
        code <<= int(bits[i]) - at
        at = int(bits[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(bits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` leading bits: the id and its code's length."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (limit - bits[order].astype(np.int64))
    ids, lens = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(spans.sum())
    ids[:n], lens[:n] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return ids, lens


def encode_block(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream and the checkpoints (bit offset of each ``LANE``-th id)."""
    n = bits[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
    size = int(word[-1]) + 2 if len(ids) else 1
    # codes don't overlap, so sums of parts below 2^32 are exact in doubles
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return (high + low).astype(np.uint64).astype(">u4").tobytes(), at[::LANE].astype(np.int64)


def decode_blocks(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray], limit: int) -> list[np.ndarray]:
    """Ids of blocks ``(bit stream, checkpoints, number of ids)``; all lanes advance together."""
    words = np.concatenate([np.frombuffer(b, ">u4").astype(np.uint64) for b, _, _ in blocks] + [np.zeros(2, np.uint64)])
    base = np.cumsum([0] + [len(b) // 4 for b, _, _ in blocks])[:-1]
    lanes = [len(c) for _, c, _ in blocks]
    at = np.concatenate([c.astype(np.int64) + 32 * int(k) for (_, c, _), k in zip(blocks, base, strict=True)])
    left = np.concatenate([np.full(k, LANE) if n % LANE == 0 else np.r_[np.full(k - 1, LANE), n % LANE] for k, (_, _, n) in zip(lanes, blocks, strict=True)]) if sum(lanes) else np.zeros(0, np.int64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    ids, lens = table
    out = np.zeros((len(at), LANE), np.uint32)
    live = np.argsort(-left, kind="stable")  # shorter lanes last
    at, left = at[live], left[live]
    for step in range(LANE):
        n = int(np.searchsorted(-left, -step, "left"))  # lanes with more than step ids
        if not n:
            break
        a = at[:n]
        top = ((pairs[a >> 5] << (a & 31).astype(np.uint64)) >> np.uint64(64 - limit)).astype(np.int64)
        out[live[:n], step] = ids[top]
        at[:n] = a + lens[top]
    found, k = [], 0
    for n_lanes, (_, _, n) in zip(lanes, blocks, strict=True):
        found.append(out[k : k + n_lanes].reshape(-1)[:n])
        k += n_lanes
    return found


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), f"<u{width}")


_ENCODERS: dict[str, Encoder] = {}


def _to_ids(path: str, end_id: int | None):
    """A row for each document, and one at a task's end with how often each id came (null elsewhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
            hand_back()  # what reading the file took
        encoder, pack = _ENCODERS[path], zstandard.ZstdCompressor(level=3).compress
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        total = np.zeros(0, np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                got = [encoder(t or "") + end for t in part.column(1).to_pylist()]
                n = np.bincount(np.frombuffer(b"".join(got), encoder.kind), minlength=len(total))
                n[: len(total)] += total
                total = n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(x) for x in got], pa.binary()), pa.nulls(len(got), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n`` of a task's rows of counts."""
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = np.frombuffer(x, "<i8")
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _to_blocks(width: int, bits: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # texts are done with: the worker's encoder and its memo go
        codes = canonical_codes(bits)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal seq, before, held
            stream, marks = encode_block(np.concatenate(ids), codes, bits)
            row = {"part": part, "seq": seq, "ids_before": before, "n_ids": held, "doc_ids": list(docs), "doc_sizes": [len(x) for x in ids], "checkpoints": marks.astype(np.int64).tolist(), "bits": stream}
            seq, before, held = seq + 1, before + held, 0
            docs.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _unpacked(data, width)
                if held and held + len(x) > block_ids:
                    yield block()
                docs.append(i)
                ids.append(x)
                held += len(x)
        if docs:
            yield block()

    return run


_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])
_BLOCK = "part int, seq bigint, ids_before bigint, n_ids bigint, doc_ids array<bigint>, doc_sizes array<bigint>, checkpoints array<bigint>, bits binary"


def _from_blocks(bits: np.ndarray, limit: int, starts: dict[int, int], emit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits, limit)
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                rows = batch.slice(k, 32).to_pylist()
                found = decode_blocks([(r["bits"], np.array(r["checkpoints"], np.int64), r["n_ids"]) for r in rows], table, limit)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], emit: []}
                for r, ids in zip(rows, found, strict=True):
                    start, at = starts[r["part"]] + r["ids_before"], 0
                    ids = ids.astype("<u4")
                    for doc, n in zip(r["doc_ids"], r["doc_sizes"], strict=True):
                        own = ids[at : at + n]
                        out["doc_id"].append(doc)
                        out["start"].append(start + at)
                        out["n_tokens"].append(n)
                        out[emit].append(zlib.crc32(own.tobytes()) if emit == "ids_crc32" else own.astype(np.int64).tolist())
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out[emit], pa.int64() if emit == "ids_crc32" else pa.list_(pa.int64()))], names=list(out))

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = 16, block_ids: int = BLOCK_IDS) -> None:
    """Write ``path/blocks`` (blocks in ascending ``doc_id`` order) and ``path/code`` (id, bits)."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        ids = written(rows.mapInArrow(lean(_to_ids(tokenizer_path, end_id)), "doc_id bigint, ids binary, counts binary"), "ids", "none")
    # one row for each id of the vocabulary, however many documents
    counts = ids.where("counts is not null").select("counts").mapInArrow(lean(_counts), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([0, *(r.id for r in counts)]) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    bits = code_lengths(total, limit)
    small_table(spark, [(int(i), int(bits[i])) for i in np.flatnonzero(bits)], [("id", pa.int32()), ("bits", pa.int32())]).coalesce(1).write.parquet(f"{path}/code")
    ordered = ids.where("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(lean(_to_blocks(width, bits, block_ids)), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_written(ids)


def read_token_files(spark: SparkSession, path: str, limit: int = 16, digest: bool = True) -> DataFrame:
    """Per document ``doc_id, start, n_tokens`` and ``ids_crc32`` (``digest``) or ``ids``, decoded from the files."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most one row for each id of the vocabulary
    bits = np.zeros(max([0, *(r.id for r in code)]) + 1, np.uint8)
    for r in code:
        bits[r.id] = r.bits
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # parts are ranges of doc_id in order; one number for each written part
    starts, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r.part], total = total, total + r.n
    emit = "ids_crc32" if digest else "ids"
    return blocks.mapInArrow(lean(_from_blocks(bits, limit, starts, emit)), f"doc_id bigint, start bigint, n_tokens bigint, {emit} {'bigint' if digest else 'array<bigint>'}")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **how) -> DataFrame:
    """Write the files and return what reading them back gives."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **how)
    return read_token_files(docs.sparkSession, path, how.get("limit", 16))

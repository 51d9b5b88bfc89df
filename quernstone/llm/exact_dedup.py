"""Exact deduplication with Patricia-trie owners.

Texts fall into parts by 16 bits of their content hash and by their length; within a part a compressed radix trie holds
their full bytes, so texts with common beginnings share edges and a terminal is a text. Every task first inserts its own
rows (keys: part, then bytes) and hands on terminals only (bytes once, smallest id, count): a group of copies leaves a
task as one row, so no hot group travels. Terminals are dealt by part, sorted by it, and inserted into tries again; the
subtree of a part is complete as soon as the next one begins, is spilled to the output and freed. Bytes decide equality,
never the hash. A part's distinct texts are what a task holds at once: those of one length that agree in 16 bits.

Defined cases: null text counts as empty; a null id never owns a text unless all ids of the group are null, in which
case ``keep_id`` is null and ``kept`` false; rows that repeat the smallest id are all kept (ids are meant to be
unique); ids are 64-bit numbers below 2^63 - 1, which stands for "no id"; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(rb" {2,}")
NONE = (1 << 63) - 1


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of white space (U+0020, U+0009 to U+000D) as one space; null is empty."""
    if not text:
        return b""
    b = text.encode("utf-8").translate(_TO_SPACE)
    return _RUNS.sub(b" ", b) if b"  " in b else b


#: Bytes of a part's name, and of terminals in one batch.
HEAD, BATCH_BYTES = 10, 8 << 20


def head(b: bytes) -> bytes:
    """A text's part, the leading digits of its key: 16 bits of the content hash, then the length."""
    return xxhash.xxh3_64_digest(b)[:2] + len(b).to_bytes(8, "big")


class Node:
    __slots__ = ("edge", "kids", "low", "count")

    def __init__(self, edge: bytes, low: int = NONE, count: int = 0):
        self.edge, self.kids, self.low, self.count = edge, None, low, count


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals hold the smallest id and the number of rows.

    ``limit`` bounds the bytes held: beyond it ``insert`` takes out the largest subtree of the root and returns
    its terminals, which the caller hands on.
    """

    def __init__(self, limit: int | None = None):
        self.kids: dict[int, Node] = {}
        self.weight: dict[int, int] = {}
        self.held, self.limit = 0, limit

    def insert(self, key: bytes, low: int, count: int = 1) -> list[tuple[bytes, int, int]]:
        kids, at, n, first = self.kids, 0, len(key), key[0]
        while True:
            node = kids.get(key[at])
            if node is None:
                kids[key[at]] = Node(key[at:], low, count)
                return self._grown(first, n - at)
            edge = node.edge
            if key.startswith(edge, at):
                at += len(edge)
                if at == n:
                    node.low, node.count = min(node.low, low), node.count + count
                    return []
                if node.kids is None:
                    node.kids = {}
                kids = node.kids
                continue
            common = _common(edge, key, at)
            upper = Node(edge[:common])
            node.edge = edge[common:]
            upper.kids = {node.edge[0]: node}
            kids[key[at]] = upper
            at += common
            if at == n:
                upper.low, upper.count = low, count
                return self._grown(first, 0)
            upper.kids[key[at]] = Node(key[at:], low, count)
            return self._grown(first, n - at)

    def _grown(self, first: int, size: int) -> list[tuple[bytes, int, int]]:
        size += 200
        self.weight[first] = self.weight.get(first, 0) + size
        self.held += size
        if self.limit is None or self.held <= self.limit:
            return []
        return list(self.cut(max(self.weight, key=self.weight.get)))

    def cut(self, first: int) -> Iterator[tuple[bytes, int, int]]:
        """Take out the subtree below a first byte."""
        self.held -= self.weight.pop(first, 0)
        todo = [(b"", self.kids.pop(first))]
        while todo:
            path, node = todo.pop()
            path += node.edge
            if node.count:
                yield path, node.low, node.count
            if node.kids:
                todo.extend((path, x) for x in node.kids.values())

    def drain(self) -> Iterator[tuple[bytes, int, int]]:
        for first in list(self.kids):
            yield from self.cut(first)


def _common(edge: bytes, key: bytes, at: int) -> int:
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


_TERMINALS = "head binary, body binary, low bigint, n bigint"
_OWNERS = "text_sha256 string, keep_id bigint, group_size bigint"
_MEMBERS = "doc_id bigint, text_sha256 string"


def _terminal_batch(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[:HEAD] for k, _, _ in rows], pa.binary()), pa.array([k[HEAD:] for k, _, _ in rows], pa.binary()), pa.array([x for _, x, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.int64())],
        names=["head", "body", "low", "n"],
    )


def _batches_of(rows: Iterator[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    """Terminals in batches of bounded bytes."""
    held: list[tuple[bytes, int, int]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if len(held) == 512 or size > BATCH_BYTES:
            yield _terminal_batch(held)
            held, size = [], 0
    if held:
        yield _terminal_batch(held)


def _local_tries(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = normalise(text)
                if out := trie.insert(head(b) + b, NONE if i is None else i):
                    yield from _batches_of(out)
        yield from _batches_of(trie.drain())

    return run


def _owner_batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _, _ in rows], pa.string()), pa.array([None if x == NONE else x for _, x, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.int64())],
        names=["text_sha256", "keep_id", "group_size"],
    )


def _merge_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by head: each head's subtree is whole when the next head begins. Only hashes of texts leave it."""
    trie, now, rows = PatriciaTrie(), None, []
    hashed = lambda: ((hashlib.sha256(memoryview(k)[HEAD:]).hexdigest(), low, n) for k, low, n in trie.drain())
    for batch in batches:
        for h, body, low, n in zip(*batch.columns, strict=True):
            h = h.as_py()
            if h != now:
                rows.extend(hashed())
                now = h
                if len(rows) >= 512:
                    yield _owner_batch(rows)
                    rows = []
            trie.insert(h + body.as_py(), low.as_py(), n.as_py())
    rows.extend(hashed())
    if rows:
        yield _owner_batch(rows)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(normalise(t)).hexdigest() for t in batch.column(1).to_pylist()], pa.string())],
            names=["doc_id", "text_sha256"],
        )


def trie_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 64 << 20) -> DataFrame:
    """One row for each distinct normalised text: ``text_sha256, keep_id, group_size``.

    ``task_bytes`` bounds the trie that a map task holds; larger tries spill whole subtrees.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    terminals = rows.mapInArrow(_local_tries(task_bytes), _TERMINALS)
    return terminals.repartition("head").sortWithinPartitions("head").mapInArrow(_merge_tries, _OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    owners = written(trie_owners(docs, id_col, text_col, task_bytes), "owners")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = rows.mapInArrow(_members, _MEMBERS)
    # members of one text may be a third of all rows: both sides are plain exchanges, so a hot partition can be split
    return members.join(owners, "text_sha256", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )

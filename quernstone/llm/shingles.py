"""Sets of word shingles as 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np

_MULS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER_SPACED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[32] = 0  # a space adds nothing to the word before it
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
    _BLOCK_POWERS = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64))
_BLOCK_POWERS[1:], _BLOCK_POWERS[0] = _BLOCK_POWERS[:-1].copy(), 1  # words of one block hash alike with or without it
SLICE = 1 << 21


def bytes_to_words(data: bytes, table: bytes, head: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes and starts of the words that ``table`` (bytes to bytes, separators to spaces) leaves: polynomials over
    random byte values. With ``head``, also hashes of the words' first ``head`` bytes."""
    arr = np.frombuffer(data.translate(table), np.uint8)
    space = arr == 32
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return (np.zeros(0, np.uint64), starts, np.zeros(0, np.uint64))[: 3 if head else 2]
    sizes = np.diff(starts, append=len(arr))
    at = np.arange(starts[0], len(arr)) - np.repeat(starts, sizes)
    value = _TABLE[arr[starts[0] :]] * _POWERS[at & 0xFFF]
    if int(sizes.max()) > 1 << 12:
        value *= _BLOCK_POWERS[(at >> 12) & 0xFFFF]
    out = mix64(np.add.reduceat(value, starts - starts[0])), starts
    if not head:
        return out
    total = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([arr, np.full(head, 32, np.uint8)])
    inside = np.ones(len(starts), bool)
    for k in range(head):
        b = padded[starts + k]
        inside &= b != 32
        total += np.where(inside, _TABLE[b] * _POWERS[k], np.uint64(0))
    return *out, mix64(total)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    return bytes_to_words(data, _LOWER_SPACED)


def text_slices(data: bytes) -> list[bytes]:
    """Cut at white space, so that long texts take bounded memory."""
    out, at = [], 0
    while len(data) - at > SLICE:
        cut = max(data.rfind(c, at, at + SLICE) for c in (b" ", b"\n"))
        if cut <= at:
            break
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct ``width``-word shingles, sorted; fewer words make one shingle, no words none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        h, starts = word_hashes(b" ".join(group))
        ends = np.cumsum([len(b) + 1 for b in group])
        edges = np.concatenate([[0], np.searchsorted(starts, ends)])
        out.extend(_one(h[a:b], width) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        group.clear()
        held = 0

    for text in texts:
        data = text.encode("utf-8") if text else b""
        if len(data) > SLICE:
            flush()
            out.append(_one(np.concatenate([word_hashes(x)[0] for x in text_slices(data)]), width))
            continue
        group.append(data)
        held += len(data)
        if held > SLICE:
            flush()
    flush()
    return out


def _one(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(width, n)
    out = h[: n - w + 1] * _MULS[0]
    for j in range(1, w):
        out = out + h[j : n - w + 1 + j] * _MULS[j % 8]
    out = mix64(out + np.uint64(w))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def multipliers(k: int, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(sets: np.ndarray, muls: np.ndarray, block: int = 512) -> np.ndarray:
    """16-bit MinHash symbols, one for each multiplier."""
    low = np.full(len(muls), ~np.uint64(0))
    for k in range(0, len(sets), block):
        np.minimum(low, (muls[:, None] * sets[None, k : k + block]).min(1), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)

"""Word and window hashes of many texts at a time, in numpy.

Hashes are polynomials modulo 2**64 over prefix sums, so the hash of any window is two look-ups.
Words are hashed from their UTF-8 bytes; a word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.
Texts are taken in pieces of bounded size, so memory follows the longest text's words at most.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time.
SLICE = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    factors = np.full(size, base, U)
                    factors[0] = 1
                    setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finalizer known from splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _hash_slice(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in some bytes that begin and end between words."""
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _BYTES.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts


def _lane_slice(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_hash_slice`, by mixing eight bytes after eight: no words are built to collide as in a polynomial."""
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    found = mix(left.astype(U), 21)
    rows, at = np.arange(len(starts)), starts
    while len(rows):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        found[rows] = mix(found[rows] ^ lane, 22)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return found, starts


def word_hashes(texts: list[bytes], lanes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and the index of each text's first word (one more at the end).

    ``lanes`` takes the hash that mixes eight bytes after eight.
    """
    found, bounds, base = [], [np.zeros(1, np.int64)], 0
    batch: list[bytes] = []

    def flush() -> None:
        nonlocal base
        if not batch:
            return
        joined = b" ".join(batch)
        lengths = np.fromiter((len(x) + 1 for x in batch), np.int64, len(batch))
        hashes, starts = _pieces(joined, _lane_slice if lanes else _hash_slice)
        found.append(hashes)
        bounds.append(base + np.searchsorted(starts, np.cumsum(lengths)))
        base += len(hashes)
        batch.clear()

    size = 0
    for text in texts:
        if size and size + len(text) > SLICE:
            flush()
            size = 0
        batch.append(text)
        size += len(text) + 1
    flush()
    return np.concatenate(found) if found else np.zeros(0, U), np.concatenate(bounds)


def _pieces(raw: bytes, slice_hashes) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) <= 2 * SLICE:
        return slice_hashes(np.frombuffer(raw, np.uint8))
    data, at, hashes, starts = np.frombuffer(raw, np.uint8), 0, [], []
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # never inside a word
            end += 1
        h, s = slice_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


class Windows:
    """Hashes of runs of words, by start and length."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _WORDS.get(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(words) + 1, U)
            np.cumsum(words * self.up[: len(words)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, length, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + np.asarray(length).astype(U), seed)


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of its least one, the first of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    if span < width:
        a, b = at[:n], at[width - span : width - span + n]
        at = np.where(values[b] < values[a], b, a)
    return at[:n]


def chunks(batches, id_at: int, text_at: int, size: int = 4 << 20):
    """Record batches as lists of ids and UTF-8 texts of about ``size`` bytes; NULL text is empty."""
    ids, texts, total = [], [], 0
    for batch in batches:
        column = batch.column(text_at)
        for start in range(0, batch.num_rows, 256):
            part = column.slice(start, 256).to_pylist()
            for key, text in zip(batch.column(id_at).slice(start, 256).to_pylist(), part):
                raw = text.encode("utf-8") if text else b""
                if total and total + len(raw) > size:
                    yield ids, texts
                    ids, texts, total = [], [], 0
                ids.append(key)
                texts.append(raw)
                total += len(raw)
    if ids:
        yield ids, texts

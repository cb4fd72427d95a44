"""Texts as bytes: words, their hashes and their shingles, with numpy.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return; A-Z count as a-z. Null texts are empty.
"""

from __future__ import annotations

import ctypes

import numpy as np

# Bytes of text hashed at once: a table of powers has as many entries.
SPAN = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1

_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
# One random 64-bit number for each lower-cased byte.
_value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_lower]
_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < size:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, factor in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and where they end."""
    blank = _space[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = np.concatenate([[0], edge, [len(raw)]]) if len(raw) else np.zeros(1, np.int64)
    if len(raw) and blank[0]:
        edges = edges[1:]
    if len(edges) % 2:
        edges = edges[:-1]
    return edges[0::2], edges[1::2]


def _hash_span(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _power_tables(max(SPAN, len(raw)))
    start, end = _bounds(raw)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_value[raw] * up[: len(raw)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the text; a span never ends inside a word."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) <= SPAN:
        return _hash_span(raw)[2]
    parts, at = [], 0
    while at < len(raw):
        end = at + SPAN
        if end < len(raw):
            gaps = np.flatnonzero(_space[raw[at:end]])
            while not len(gaps) and end < len(raw):
                end += SPAN
                gaps = np.flatnonzero(_space[raw[at:end]])
            if end < len(raw) and len(gaps):
                end = at + int(gaps[-1]) + 1
        parts.append(_hash_span(raw[at:end])[2])
        at = end
    return np.concatenate(parts)


def many_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many words each text has."""
    hashes, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            raw = np.frombuffer(b" ".join(held), dtype=np.uint8)
            start, _, got = _hash_span(raw)
            lengths = np.fromiter((len(t) for t in held), dtype=np.int64, count=len(held))
            ends = np.cumsum(lengths + 1)
            counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
            hashes.append(got)
        held, size = [], 0

    for text in texts:
        if size + len(text) + 1 > SPAN:
            flush()
        if len(text) >= SPAN:
            got = word_hashes(text)
            hashes.append(got)
            counts.append(np.array([len(got)]))
        else:
            held.append(text)
            size += len(text) + 1
    flush()
    none = np.zeros(0, dtype=np.uint64)
    return (
        np.concatenate(hashes) if hashes else none,
        np.concatenate(counts).astype(np.int64) if counts else none.astype(np.int64),
    )


def shingles(words: np.ndarray, width: int, distinct: bool = True) -> np.ndarray:
    """The hashes of all runs of ``width`` words; distinct ones are sorted.

    Fewer words than that make one shingle; no words make none.
    """
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    width = min(width, len(words))
    last = len(words) - width + 1
    total = np.full(last, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total) + words[k : k + last]
    total = mix(total)
    return np.unique(total) if distinct else total


def release() -> None:
    """Gives memory that a task is done with back to the system: workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(texts, limit: int = 8 << 20):
    """Slices of a list of byte strings, each of about ``limit`` bytes."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow text column as bytes; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]

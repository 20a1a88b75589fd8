"""Vectorised hashing of texts with numpy, for use inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np

#: Odd multipliers, so that they have inverses modulo 2**64.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Bytes or words that are hashed at a time: arrays of a megabyte stay in the cache and leave no large gaps behind.
SLICE = 1 << 17

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def tidy() -> None:
    """Give freed memory back to the system; a worker lives on after its task, and its executor counts what it keeps."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)


BYTE_CODES = _table(1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..base**(n-1) modulo 2**64, and their inverses."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())

        def row(b):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            return np.cumprod(x)

        got = _powers[base] = (row(base), row(pow(base, -1, 1 << 64)))
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """s with s[j] - s[i] = sum of values[k] * base**k over i <= k < j."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=s[1:])
    return s


def run_hashes(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A hash of every run of ``width`` consecutive 64-bit values, in slices."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, SLICE):
        part = values[a : a + SLICE + width - 1]
        s = prefix_sums(part, base)
        m = len(part) - width + 1
        out[a : a + m] = (s[width:] - s[:-width]) * powers(base, m)[1]
    return mix(out)


def join_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, each followed by a line feed, and where each starts (one more at the end)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), offsets


def word_bounds(buf: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``in_word`` (a table of 256 booleans) allows."""
    w = np.zeros(len(buf) + 2, np.int8)
    w[1:-1] = in_word[buf]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each word's bytes; words are ascending and apart."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo = starts[i]
        s = prefix_sums(BYTE_CODES[buf[lo : ends[j - 1]]], base)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (s[b] - s[a]) * powers(base, len(s))[1][a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def arrow_slices(batches, text: str, chars: int = 1 << 19, rows: int = 256):
    """Arrow batches in pieces of at most so many rows and about so many bytes of ``text``; other columns are not copied."""
    import pyarrow.compute as pc

    for batch in batches:
        tidy()
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            before = size[i - 1] if i else 0
            j = min(batch.num_rows, i + rows, max(i + 1, int(np.searchsorted(size, before + chars, "right"))))
            yield batch.slice(i, j - i)
            i = j
    tidy()


def with_columns(batch, drop: tuple, **new):
    """An Arrow batch without ``drop`` and with new columns."""
    import pyarrow as pa

    keep = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n not in drop]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(new.values()), names=[n for n, _ in keep] + list(new))


def slices(texts: list, chars: int = 1 << 19):
    """Ranges (i, j) of texts of about so many characters together."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)

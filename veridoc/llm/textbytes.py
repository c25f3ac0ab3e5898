"""Texts of an Arrow batch as one run of bytes, and hashes over it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(11)
#: A random odd value for each byte; as it is, and with A-Z like a-z.
MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MIX_LOWER = MIX.copy()
MIX_LOWER[ord("A") : ord("Z") + 1] = MIX[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse, modulo 2**64, for i below n."""
    if _powers.get("p", MIX[:0]).size < n:
        size = 1 << max(19, (n - 1).bit_length())
        _powers["p"] = np.cumprod(np.append(U(1), np.full(size - 1, PRIME, U)), dtype=U)
        _powers["q"] = np.cumprod(np.append(U(1), np.full(size - 1, pow(PRIME, -1, 1 << 64), U)), dtype=U)
    return _powers["p"], _powers["q"]


def forget() -> None:
    """Lets the powers go; who needs them makes them anew."""
    _powers.clear()


def blend(x: np.ndarray) -> np.ndarray:
    """A finalizer: spreads each value over all 64 bits, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def running(data: np.ndarray, mix: np.ndarray = MIX) -> np.ndarray:
    """Sums from which ``span`` takes the hash of any stretch."""
    p, _ = powers(data.size + 1)
    out = np.empty(data.size + 1, U)
    out[0] = 0
    np.cumsum(mix[data] * p[: data.size], dtype=U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end), whatever its place."""
    _, q = powers(sums.size)
    return blend((sums[end] - sums[start]) * q[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and the offsets of each; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int):
    """Runs of rows with about ``most`` bytes (a longer text has a run of its own)."""
    a = 0
    while a < off.size - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; ``gap`` tells for each byte value whether it separates."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~gap[data]
    inner = off[(off > 0) & (off < data.size)]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1

"""Arrow batches, word hashing and number helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are turned into numpy arrays at once.
CHUNK = 1 << 19


def keyed_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


#: What operators have left in this process for their own later tasks: a name, and what lets it go.
_left: dict[str, Callable[[], None]] = {}


def leave(name: str, forget: Callable[[], None]) -> None:
    """Something stays in this worker until it serves a function that does not use it."""
    _left[name] = forget


def let_go(uses: str) -> None:
    """Lets go of all that was left here under other names."""
    for name in [x for x in _left if x != uses]:
        _left.pop(name)()


def released(fn: Callable, uses: str = "") -> Callable:
    """fn, with the memory that it freed given back at the end: workers live on and serve other stages.

    What others have left in the worker is let go before, but for what it `uses`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def arrow_map(df: DataFrame, columns: list[str | Column], fn: Callable, schema: str, uses: str = "") -> DataFrame:
    """mapInArrow over the named columns only, so that nothing else is read or sent to Python."""
    return df.select(*columns).mapInArrow(released(fn, uses), schema)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as no other column (in any case of letters) has."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a larger row has a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (xor-shift and multiply rounds)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, mod 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size, out = max(n, CHUNK + 1024), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


class WordRule:
    """Which bytes belong to a word, and the lower-case form of each byte."""

    def __init__(self, separators: bytes) -> None:
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32


#: Letters a-z, digits and every byte of a character beyond ASCII, after A-Z are lowered.
ALNUM = WordRule(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))


def split_words(data: np.ndarray, rule: WordRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words in bytes that are already lowered by `rule`.

    Works through the bytes in pieces cut between words; a hash depends on the word's bytes
    alone, not on its place.
    """
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            gaps = np.flatnonzero(~rule.inside[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                more = next((k for k in range(to, n, CHUNK) if not rule.inside[data[k : k + CHUNK]].all()), n)
                to = n if more == n else more + int(np.flatnonzero(~rule.inside[data[more : more + CHUNK]])[0]) + 1
        piece = data[at:to]
        flags = np.zeros(len(piece) + 2, np.int8)
        flags[1:-1] = rule.inside[piece]
        edges = np.flatnonzero(np.diff(flags))
        s, e = edges[::2], edges[1::2]
        if len(s):
            up, down = powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, U64)
            np.cumsum((piece.astype(U64) + U64(1)) * up[: len(piece)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, seed, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in the sorted keys of each value, -1 where it isn't one."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a zero byte after each, and where each row begins (plus the end)."""
    data = np.frombuffer(b"\0".join([*rows, b""]), np.uint8)
    begins = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in rows], out=begins[1:])
    return data, begins

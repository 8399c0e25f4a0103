"""Elias-Fano coded monotone sequences over memory-mapped arrays; all lookups work on arrays.

n values below u are kept as their low l = log2(u / n) bits, packed, and their
high parts in unary: bit (v >> l) + i is set for the i-th value. A count of set
bits before each 64-bit word finds the i-th set (or unset) bit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from .common import open_fs, write_file

U = np.uint64


def _words(at: np.ndarray, bits: np.ndarray, count: int) -> np.ndarray:
    """64-bit words with ``bits`` (uint64) put at the ascending bit places ``at``."""
    out = np.zeros(count, U)
    if len(at):
        w = at >> 6
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        out[w[starts]] = np.bitwise_or.reduceat(bits << (at & 63).astype(U), starts)
    return out


class EliasFano:
    def __init__(self, n: int, base: int, l: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):  # noqa: E741
        self.n, self.base, self.l, self.low, self.high, self.ones = n, base, l, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        """values: ascending, as int64 or uint64."""
        n, base = len(values), int(values[0]) if len(values) else 0
        v = (values - values.dtype.type(base)).astype(U)
        l = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0  # noqa: E741
        at = np.arange(n, dtype=np.int64)
        high = (v >> U(l)).astype(np.int64) + at
        # At least one unset bit follows the last value.
        words = _words(high, np.ones(n, U), (int(high[-1]) // 64 if n else 0) + 2)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
        low = np.zeros(0, U)
        if l:
            bits, at = v & U((1 << l) - 1), at * l
            low = _words(at, bits, (n * l >> 6) + 2)
            over = (at & 63) + l > 64
            low[(at[over] >> 6) + 1] |= bits[over] >> (64 - (at[over] & 63)).astype(U)
        return cls(n, base, l, low, words, ones)

    def arrays(self, name: str) -> dict:
        return {f"{name}.meta": np.array([self.n, self.l], np.int64), f"{name}.base": np.array([self.base], np.int64 if self.base < 2**63 else U), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def load(cls, arrays: dict, name: str) -> "EliasFano":
        n, l = map(int, arrays[f"{name}.meta"])  # noqa: E741
        return cls(n, int(arrays[f"{name}.base"][0]), l, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        at = i * self.l
        w, s = at >> 6, (at & 63).astype(U)
        v = self.low[w] >> s
        over = np.flatnonzero(s)
        v[over] |= self.low[w[over] + 1] << (U(64) - s[over])
        return v & U((1 << self.l) - 1)

    @staticmethod
    def _in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th (from 0) set bit of each word."""
        at = np.zeros(len(x), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & U((1 << step) - 1)).astype(np.int64)
            go = r >= c
            r = r - c * go
            x = np.where(go, x >> U(step), x)
            at += step * go
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i (int64), less the base."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        at = (w << 6) + self._in_word(self.high[w], i - self.ones[w])
        return ((at - i).astype(U) << U(self.l) | self._low(i)).astype(np.int64)

    def zeros(self) -> np.ndarray:
        """Unset bits before each word; kept, of a size with ``ones``."""
        if not hasattr(self, "_zeros"):
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        return self._zeros

    def _after_zero(self, r: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most r: those before the r-th unset bit."""
        z = self.zeros()
        w = np.searchsorted(z, r, side="right") - 1
        return (w << 6) + self._in_word(~self.high[w], r - z[w]) - r

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each value (less the base, uint64) the place of the first one at or above it, and whether it is equal.

        first and last: places between which to look, for callers that know them.
        """
        top = (values >> U(self.l)).astype(np.int64)
        most = (len(self.high) << 6) - self.n - 1
        beyond = top > most
        top = np.minimum(top, most)
        # The values of the bucket of ``top`` stand between two unset bits.
        low, high = np.zeros(len(top), np.int64), self._after_zero(top)
        k = np.flatnonzero(top > 0)
        low[k] = self._after_zero(top[k] - 1)
        low[beyond] = high[beyond] = self.n
        if first is not None:
            low, high = np.clip(low, first, last), np.clip(high, first, last)
        wanted = values & U((1 << self.l) - 1)
        end = high.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            mid = (low[left] + high[left]) >> 1
            less = self._low(mid) < wanted[left]
            low[left[less]] = mid[less] + 1
            high[left[~less]] = mid[~less]
            left = left[low[left] < high[left]]
        found = np.zeros(len(top), bool)
        k = np.flatnonzero(low < end)
        found[k] = self._low(low[k]) == wanted[k]
        return low, found


def dump(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after the other, aligned to 8 bytes, behind a JSON directory."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    said = json.dumps(head).encode()
    said += b" " * (-len(said) % 8)

    def fill(out):
        out.write(len(said).to_bytes(8, "little") + said)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(bytes(-a.nbytes % 8))

    write_file(uri, fill)


def arrays_of(raw: np.ndarray) -> dict[str, np.ndarray]:
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, at, many) in head.items():
        start = 8 + n + at
        out[name] = np.ndarray(many, kind, raw, start) if many else np.empty(0, kind)
    return out


def loaded(uri: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, in memory."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return arrays_of(np.frombuffer(f.read(), np.uint8))


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, memory-mapped where the file system allows, else in memory."""
    fs, path = open_fs(uri)
    return arrays_of(np.memmap(path, np.uint8, "r")) if fs.type_name == "local" else loaded(uri)


class Opened(dict):
    """URI -> what ``make`` gives of the file's arrays. Files that cannot be mapped take memory: beyond HELD_BYTES the first opened go."""

    HELD_BYTES = 256 << 20

    def __init__(self, make: Callable[[dict], object]):
        super().__init__()
        self.make, self.sizes = make, {}

    def __missing__(self, uri: str):
        arrays = mapped(uri)
        if open_fs(uri)[0].type_name != "local":
            self.sizes[uri] = sum(a.nbytes for a in arrays.values())
            while len(self.sizes) > 1 and sum(self.sizes.values()) > self.HELD_BYTES:
                old = next(iter(self.sizes))
                del self.sizes[old]
                self.pop(old, None)
        v = self[uri] = self.make(arrays)
        return v

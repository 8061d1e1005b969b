"""Elias-Fano sequences and a two-level n-gram trie in flat, mappable buffers."""

from __future__ import annotations

import numpy as np

SCALE = 65000 / 30.0  # codes for -ln(p) from 0 to 30; code 65535 is probability 0
ZERO = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes, equal steps in the logarithm (relative error under 0.03 %)."""
    out = np.full(len(p), ZERO, dtype=np.uint16)
    some = p > 0
    out[some] = np.clip(np.rint(-np.log(p[some]) * SCALE), 0, 65000).astype(np.uint16)
    return out


_DECODE = np.exp(-np.arange(65536) / SCALE)
_DECODE[65001:] = 0.0


def dequantise(codes: np.ndarray) -> np.ndarray:
    return _DECODE[codes]


class EliasFano:
    """A monotone sequence of 64-bit values: low bytes in columns, high parts in unary.

    The width of the low part is rounded up to whole bytes, so values are read without
    shifting across words; that costs at most seven bits a value.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, width: int, n: int):
        self.low, self.high, self.width, self.n = low, high, width, n
        bits = np.unpackbits(high, count=None) if len(high) else np.zeros(0, np.uint8)
        ends = np.flatnonzero(bits == 0)
        # element i's high part is the number of zeros before its one; starts[h]: elements whose high part is below h
        self.starts = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64) if n else np.zeros(2, np.int64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = 0
        while width < 56 and n and (universe >> (width * 8)) > n:
            width += 1
        low = np.empty((width, n), dtype=np.uint8)
        for k in range(width):
            low[k] = (values >> np.uint64(8 * k)).astype(np.uint8)
        top = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        bits = np.zeros((int(top[-1]) + 2 + n) if n else 0, dtype=np.uint8)
        if n:
            bits[top + np.arange(n)] = 1
        return EliasFano(low, np.packbits(bits), width, n)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(self.width):
            out |= self.low[k][i].astype(np.uint64) << np.uint64(8 * k)
        high = np.searchsorted(self.starts, i, side="right") - 1
        return out | high.astype(np.uint64) << np.uint64(8 * self.width)

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(self.width):
            out |= self.low[k][i].astype(np.uint64) << np.uint64(8 * k)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position in [lo, hi) of the first value of at least ``x``; hi if there is none."""
        high = (x >> np.uint64(8 * self.width)).astype(np.int64)
        last = len(self.starts) - 2
        inside = high <= last
        h = np.minimum(high, max(last, 0))
        a = np.where(inside, self.starts[h], self.n)
        b = np.where(inside, self.starts[h + 1], self.n)
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        want = x & np.uint64((1 << (8 * self.width)) - 1)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            less = self._low_at(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]

    def dump(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "shape": np.array([self.width, self.n], dtype=np.int64)}

    @staticmethod
    def load(parts: dict[str, np.ndarray]) -> EliasFano:
        width, n = (int(v) for v in parts["shape"])
        return EliasFano(np.asarray(parts["low"]).reshape(width, n), np.asarray(parts["high"]), width, n)


class Trie:
    """Contexts and, under each, its successors with quantised discounted probabilities.

    ``contexts`` (sorted) with ``backoff`` codes; ``pointers``: where each context's
    successors begin (monotone); ``successors``: rank of the context * 2^32 + word id
    (monotone), so a word is searched relative to its context, within its pointers.
    """

    def __init__(self, contexts, backoff, pointers: EliasFano, successors: EliasFano, codes):
        self.contexts, self.backoff, self.pointers, self.successors, self.codes = contexts, backoff, pointers, successors, codes

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """From rows (context, 32-bit word, count); repeated rows are added up, counts of 0 dropped."""
        some = count > 0
        context, word, count = context[some], word[some], count[some].astype(np.float64)
        contexts, rank = np.unique(context, return_inverse=True)
        keys = rank.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, count = keys[edge], np.add.reduceat(count, edge) if len(edge) else count
        owner = (keys >> np.uint64(32)).astype(np.int64)
        n = len(contexts)
        total = np.bincount(owner, weights=count, minlength=n)
        kinds = np.bincount(owner, minlength=n)
        pointers = np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64)
        return Trie(
            contexts, quantise(discount * kinds / np.maximum(total, 1)), EliasFano.build(pointers, len(keys) + 1), EliasFano.build(keys, max(n, 1) << 32), quantise((count - discount) / total[owner])
        )

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of the discounted probability, code of the back-off weight; 1 for an unknown context)."""
        code, back = np.full(len(context), ZERO, np.uint16), np.zeros(len(context), np.uint16)
        if not len(self.contexts):
            return code, back
        rank = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = np.flatnonzero(self.contexts[rank] == context)
        rank = rank[known]
        back[known] = self.backoff[rank]
        lo, hi = self.pointers.at(rank).astype(np.int64), self.pointers.at(rank + 1).astype(np.int64)
        x = rank.astype(np.uint64) << np.uint64(32) | word[known].astype(np.uint64)
        at = self.successors.successor(x, lo, hi)
        in_range = np.flatnonzero(at < hi)
        hit = in_range[self.successors.at(at[in_range]) == x[in_range]]
        code[known[hit]] = self.codes[at[hit]]
        return code, back

    def dump(self) -> bytes:
        """One flat buffer: a directory of (name, kind, place, size), then the arrays, 8-byte aligned."""
        import json

        parts = {"contexts": self.contexts, "backoff": self.backoff, "codes": self.codes}
        for level in ("pointers", "successors"):
            parts |= {f"{level}.{k}": v for k, v in getattr(self, level).dump().items()}
        blobs, at, index = [], 0, {}
        for name, v in parts.items():
            raw = np.ascontiguousarray(v).tobytes()
            index[name] = [v.dtype.str, at, v.size]
            blobs.append(raw + b"\0" * (-len(raw) % 8))
            at += len(blobs[-1])
        head = json.dumps(index).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(blobs)

    @staticmethod
    def load(buffer) -> Trie:
        """From a buffer or a ``numpy.memmap`` of bytes; arrays are views, nothing is copied."""
        import json

        raw = np.frombuffer(buffer, dtype=np.uint8) if not isinstance(buffer, np.ndarray) else buffer
        size = int.from_bytes(raw[:8].tobytes(), "little")
        index = json.loads(raw[8 : 8 + size].tobytes())
        view = lambda name: raw[8 + size + index[name][1] :][: index[name][2] * np.dtype(index[name][0]).itemsize].view(index[name][0])
        level = lambda name: EliasFano.load({k: view(f"{name}.{k}") for k in ("low", "high", "shape")})
        return Trie(view("contexts"), view("backoff"), level("pointers"), level("successors"), view("codes"))

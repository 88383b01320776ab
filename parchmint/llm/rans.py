"""A static range asymmetric numeral system over interleaved lanes, in numpy.

Symbol i of a block belongs to lane i % LANES; a step codes one symbol of every lane. States
are 64-bit and give off 32-bit words. Every CHECKPOINT steps the block records its lanes' states
and its place in the words, so that a reader can start there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES, CHECKPOINT = 1024, 64
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
W32 = np.uint64(32)


@dataclass
class Table:
    """Frequencies scaled to 2**SCALE_BITS; every symbol that occurs has one at least."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        size = int(self.symbols.max(initial=0)) + 1
        self.f = np.zeros(size, dtype=np.uint64)
        self.f[self.symbols] = self.freq
        self.c = np.zeros(size, dtype=np.uint64)
        self.c[self.symbols] = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64) if len(self.freq) else []
        self.slot = np.repeat(self.symbols, self.freq).astype(np.uint32)


def scaled(symbols: np.ndarray, counts: np.ndarray) -> Table:
    """Counts to frequencies whose sum is 2**SCALE_BITS, by largest remainders, one at least."""
    if len(symbols) > 1 << SCALE_BITS:
        raise ValueError(f"more than 2**{SCALE_BITS} symbols")
    if not len(symbols):
        return Table(np.empty(0, np.int64), np.empty(0, np.int64))
    spare = (1 << SCALE_BITS) - len(symbols)
    share = counts / counts.sum() * spare
    freq = np.floor(share).astype(np.int64)
    freq[np.argsort(freq - share, kind="stable")[: spare - freq.sum()]] += 1
    return Table(symbols.astype(np.int64), freq + 1)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table) -> dict:
    """A block: n, states and words to start from, checkpoints, crc32 of the ids."""
    n, k = len(ids), np.uint64(SCALE_BITS)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    n_words, marks = 0, []
    for step in range(steps - 1, -1, -1):
        s = ids[step * LANES : (step + 1) * LANES]
        f, c, own = table.f[s], table.c[s], x[: len(s)]
        over = own >= f << np.uint64(63 - SCALE_BITS)
        if over.any():
            words = own[over].astype(np.uint32)
            out.append(words)
            n_words += len(words)
            own = np.where(over, own >> W32, own)
        q, r = np.divmod(own, f)
        x[: len(s)] = (q << k) + r + c
        if step % CHECKPOINT == 0:
            marks.append((step, n_words, x.copy()))
    marks.reverse()
    return {
        "n": n,
        "words": np.concatenate(out[::-1]).astype("<u4").tobytes() if out else b"",
        "marks": np.array([n_words - at for _, at, _ in marks], dtype="<i8").tobytes(),
        "states": b"".join(x.astype("<u8").tobytes() for _, _, x in marks),
        "crc": crc(ids),
    }


def decode(block: dict, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint first up to checkpoint last (or the end)."""
    n, k, low = block["n"], np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    marks = np.frombuffer(block["marks"], dtype="<i8")
    if first >= len(marks):
        return np.empty(0, dtype=np.uint32)
    words = np.frombuffer(block["words"], dtype="<u4").astype(np.uint64)
    x = np.frombuffer(block["states"], dtype="<u8").reshape(-1, LANES)[first].astype(np.uint64)
    at, out = int(marks[first]), []
    end = n if last is None or last >= len(marks) else min(n, last * CHECKPOINT * LANES)
    for start in range(first * CHECKPOINT * LANES, end, LANES):
        m = min(LANES, n - start)
        own = x[:m]
        slot = own & low
        s = table.slot[slot]
        own = table.f[s] * (own >> k) + slot - table.c[s]
        need = np.flatnonzero(own < LOW)
        own[need] = own[need] << W32 | words[at : at + len(need)]
        at += len(need)
        x[:m] = own
        out.append(s)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block holds ids; id i belongs to step i // lanes and lane i % lanes.  Every
lane has a state of 63 bits and gives off 32-bit words, which all lanes write to
one stream in the order in which the decoder wants them.  Before every
``segment`` steps the encoder notes the lanes' states and the place in the
stream, and a checksum of the segment's ids, so segments decode alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, SEGMENT, MAGIC = 4096, 128, b"RNS1"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies of ids that add up to 2^bits; ids of frequency 0 cannot be encoded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        if int(self.freq.sum()) != 1 << self.bits or self.bits > 28:
            raise ValueError("frequencies must add up to a power of two of at most 2^28")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, kinds = int(counts.sum()), int((counts > 0).sum())
        bits = min(28, max(12, kinds.bit_length() + 4))
        wide = counts.astype(object) if total >> (62 - bits) else counts.astype(np.int64)  # no overflow
        freq = np.where(counts > 0, np.maximum(wide * (1 << bits) // max(total, 1), 1), 0).astype(np.int64)
        over = int(freq.sum()) - (1 << bits)
        for i in np.argsort(-freq, kind="stable"):  # the largest bear the rounding
            if not over:
                break
            give = min(over, int(freq[i]) // 2) if over > 0 else over
            freq[i] -= give
            over -= give
        return cls(freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 32))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    bits = np.uint64(table.bits)
    freq, start = table.freq[ids], table.start[ids]
    most = freq << np.uint64(63 - table.bits)
    for t in range(steps - 1, -1, -1):
        own = slice(t * lanes, min(n, (t + 1) * lanes))
        f = freq[own]
        x = state[: len(f)]
        full = x >= most[own]
        out = x[full]
        words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x[full] = out >> _WORD
        q = x // f
        x[:] = (q << bits) + (x - q * f) + start[own]
        if t % segment == 0:
            marks.append((t, state.astype("<u8")))
    words.reverse()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    head = struct.pack("<4sIIII", MAGIC, n, lanes, segment, len(marks))
    index, states = [], []
    for k, (t, s) in enumerate(reversed(marks)):
        raw = np.ascontiguousarray(ids[t * lanes : (t + segment) * lanes], "<u4").tobytes()
        index.append(struct.pack("<QI", int(places[t]), zlib.crc32(raw)))
        states.append(s.tobytes())
    body = head + b"".join(index) + b"".join(states) + b"".join(w.tobytes() for w in words)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """An encoded block; its segments decode in any order and place."""

    def __init__(self, data: bytes):
        if len(data) < 24 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the block's checksum does not hold")
        magic, self.n, self.lanes, self.step, self.segments = struct.unpack_from("<4sIIII", data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = struct.calcsize("<4sIIII")
        self.index = [struct.unpack_from("<QI", data, at + 12 * k) for k in range(self.segments)]
        at += 12 * self.segments
        self.states = np.frombuffer(data, "<u8", self.segments * self.lanes, at).reshape(self.segments, self.lanes)
        at += 8 * self.segments * self.lanes
        self.words = np.frombuffer(data, "<u4", (len(data) - 4 - at) // 4, at)

    def decode(self, k: int, table: Table) -> np.ndarray:
        """The ids of segment k."""
        place, checksum = self.index[k]
        first = k * self.step * self.lanes
        n = min(self.n - first, self.step * self.lanes)
        out = np.empty(n, np.uint32)
        state, bits, mask = self.states[k].astype(np.uint64), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
        for a in range(0, n, self.lanes):
            x = state[: min(self.lanes, n - a)]
            slot = x & mask
            ids = table.symbol[slot]
            out[a : a + len(x)] = ids
            x[:] = table.freq[ids] * (x >> bits) + slot - table.start[ids]
            short = np.flatnonzero(x < _LOW)
            x[short] = (x[short] << _WORD) | self.words[place : place + len(short)]
            place += len(short)
        if zlib.crc32(out.astype("<u4").tobytes()) != checksum:
            raise ValueError(f"the checksum of segment {k} does not hold")
        return out

    def all(self, table: Table) -> np.ndarray:
        return np.concatenate([self.decode(k, table) for k in range(self.segments)]) if self.segments else np.empty(0, np.uint32)

"""Words, shingles and XXH64 over whole batches of UTF-8 text, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The fixed values of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array, tail: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, ``tail`` after each, and the n + 1 offsets; a null counts as empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    if tail:
        a = pc.binary_join_element_wise(a, pa.scalar("", pa.large_string()), pa.scalar(tail, pa.large_string()))
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (n + 1)."""
    solid = ~IS_SPACE[raw]
    n = len(raw)
    begins, ends = np.ones(n + 1, bool), np.ones(n + 1, bool)
    begins[1:n] = ~solid[: n - 1]
    begins[off] = True
    ends[:n] = ~solid
    ends[off] = True
    starts = np.flatnonzero(solid & begins[:n])
    stops = np.flatnonzero(solid & ends[1 : n + 1]) + 1
    return starts, stops, np.searchsorted(starts, off)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each: bytes, starts, ends, first word of each text."""
    raw, off = utf8(column, "\n")
    starts, stops, first = spans(raw, off)
    keep = ~IS_SPACE[raw]
    keep[stops] = True
    out = LOWER[raw[keep]]
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts + 1, out=to[1:])
    out[to[1:] - 1] = 32
    return out, to[:-1], to[1:] - 1, first


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 42, long: int = 512, some: int = 1 << 18) -> np.ndarray:
    """XXH64 of each ``raw[start:stop]``, unsigned.

    Short spans go through numpy, ``some`` at once; those of over ``long`` bytes one by one through the library.
    """
    out = np.empty(len(starts), np.uint64)
    wide = stops - starts > long
    for i in np.flatnonzero(wide):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : stops[i]].data, seed)
    short = np.flatnonzero(~wide)
    for at in range(0, len(short), some):
        pick = short[at : at + some]
        out[pick] = _short_xxh64(raw, starts[pick], stops[pick], seed)
    return out


def _short_xxh64(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    n = len(starts)
    # the bytes that these spans lie in, and eight more to read words from
    low = int(starts.min())
    raw, starts, stops = raw[low : int(stops.max())], starts - low, stops - low
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided
    u64 = view(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))
    u32 = view(padded[:4].view(np.uint32), (len(raw) + 1,), (1,))
    size = (stops - starts).astype(np.int64)
    at = starts.astype(np.int64)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(n, s + P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            a, stripes = at[long].copy(), size[long] >> 5
            acc = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(stripes.max())):
                live = np.flatnonzero(stripes > k)
                for lane in range(4):
                    acc[lane][live] = _round(acc[lane][live], u64[a[live] + (32 * k + 8 * lane)])
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for lane in range(4):
                x = (x ^ _round(np.zeros_like(x), acc[lane])) * P1 + P4
            h[long] = x
            at[long] += stripes << 5
        h += size.astype(np.uint64)
        rest = (stops - at).astype(np.int64)
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(live):
                break
            lane = u64[at[live] + 8 * k]
            h[live] = _rot(h[live] ^ _round(np.zeros(1, np.uint64), lane), 27) * P1 + P4
        at += rest & ~7
        rest &= 7
        live = np.flatnonzero(rest >= 4)
        if len(live):
            h[live] = _rot(h[live] ^ (u32[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
            at[live] += 4
            rest[live] -= 4
        for k in range(3):
            live = np.flatnonzero(rest > k)
            if not len(live):
                break
            h[live] = _rot(h[live] ^ (padded[at[live] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * P2
        x = (x ^ (x >> np.uint64(29))) * P3
        return x ^ (x >> np.uint64(32))

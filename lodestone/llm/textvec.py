"""Word and shingle hashes of many texts at once, as array operations on their UTF-8 bytes.

A word is a run of bytes outside space and 0x09-0x0D.  Words are told apart exactly (an Arrow
dictionary of their bytes), and each distinct one gets a keyed name of 64 bits, which is no polynomial
in its bytes.  Long words, lines, whole texts and sets are named by keyed BLAKE2b.

Any bytes are taken, very long texts too; an empty text has no words; equal bytes give equal hashes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

KEY = b"lodestone names"
SHORT = 32
_KEYS = np.frombuffer(blake2b(KEY, digest_size=32).digest(), "<u8") | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


Spans = tuple[np.ndarray, np.ndarray]  # offsets and bytes of different spans


def span_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, Spans]:
    """(code of each span, the spans of the codes) for ascending, disjoint spans; table maps bytes first.

    Exact: two spans have one code if, and only if, their bytes are equal.
    """
    if not len(starts):
        return np.zeros(0, np.int64), (np.zeros(1, np.int64), np.zeros(0, np.uint8))
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    part = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    if table is not None:
        part = table[part]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))])
    found = spans.dictionary_encode()
    _, off, data = found.dictionary.buffers()
    off = np.frombuffer(off, np.int64)[: len(found.dictionary) + 1]
    return found.indices.to_numpy().astype(np.int64), (off, np.frombuffer(data, np.uint8)[: off[-1]])


def name(data: bytes) -> int:
    """64 bits of keyed BLAKE2b."""
    return int.from_bytes(blake2b(data, digest_size=8, key=KEY).digest(), "little")


def names(spans: Spans, table: np.ndarray | None = None) -> np.ndarray:
    """A name of 64 bits for each span; table maps bytes first.

    Spans under 8 bytes have names of their own: their bytes and length, scrambled one to one with a
    key.  Those under SHORT bytes are scrambled 8 bytes at a time, the state under two keys; longer ones
    get BLAKE2b.
    """
    offsets, data = spans
    if table is not None:
        data = table[data]
    size = np.diff(offsets)
    out = np.empty(len(size), np.uint64)
    short = np.flatnonzero(size < SHORT)
    at, left = offsets[short], size[short]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    state, other = np.full(len(short), _KEYS[0], np.uint64), np.full(len(short), _KEYS[1], np.uint64)
    live = np.arange(len(short))
    while len(live):
        n = np.minimum(left[live], 8)
        block = np.ascontiguousarray(windows[np.minimum(at[live], len(padded) - 8)]).view("<u8").ravel()
        block = np.where(n == 8, block, (block & ((np.uint64(1) << (8 * (n % 8)).astype(np.uint64)) - np.uint64(1))) | (n.astype(np.uint64) << np.uint64(56)))
        mixed = mix(state[live] ^ block)
        other[live] = mix(other[live] + (block ^ (mixed >> np.uint64(32))) * _KEYS[2])
        state[live] = mixed
        last = n < 8
        at[live] += 8
        left[live] -= 8
        live = live[~last]
    out[short] = np.where(size[short] < 8, state, mix(state ^ (other >> np.uint64(17)) * _KEYS[3]))
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    for k in np.flatnonzero(size >= SHORT).tolist():
        out[k] = name(view[offsets[k] : offsets[k + 1]])
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Name of raw[starts[i]:ends[i]] for ascending, disjoint, non-empty spans; table maps bytes first."""
    codes, spans = span_codes(raw, starts, ends, table)
    return names(spans)[codes]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the run values[starts[i]:ends[i]] of 64-bit values."""
    data = memoryview(np.ascontiguousarray(values)).cast("B")
    return np.fromiter((name(data[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of keyed BLAKE2b of raw[starts[i]:ends[i]], as two columns."""
    data = memoryview(np.ascontiguousarray(raw)).cast("B")
    out = b"".join(blake2b(data[a:b], digest_size=16, key=KEY).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    pairs = np.frombuffer(out, np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; document d has words first[d]:first[d+1]."""
    n = len(raw)
    solid = ~SPACE[raw]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _rounds(v: list[np.ndarray], n: int) -> None:
    """n rounds of SipHash on its four state words."""
    for _ in range(n):
        v[0] += v[1]
        v[2] += v[3]
        v[1], v[3] = _turn(v[1], 13) ^ v[0], _turn(v[3], 16) ^ v[2]
        v[0] = _turn(v[0], 32)
        v[2] += v[1]
        v[0] += v[3]
        v[1], v[3] = _turn(v[1], 17) ^ v[2], _turn(v[3], 21) ^ v[0]
        v[2] = _turn(v[2], 32)


def tuple_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Keyed hash of the tuple of values at each place: SipHash-1-3 over 64-bit words.

    256 bits of state under a key take each value in twice, before and after a round, so no value can
    make up for another one, as it can in sums and in chains of a single word.
    """
    n = len(columns[0])
    salt = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)  # the fixed start of SipHash
    v = [np.full(n, np.uint64(c) ^ _KEYS[k % 2]) for k, c in enumerate(salt)]
    for column in [*columns, np.uint64(len(columns) * 8 % 256 << 56)]:
        v[3] ^= column
        _rounds(v, 1)
        v[0] ^= column
    v[2] ^= np.uint64(0xFF)
    _rounds(v, 3)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; of the whole sequence, if it is shorter; none without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(size, n)
    return tuple_hashes([word_hashes[k : n - width + 1 + k] for k in range(width)])


def tuple_codes(columns: list[np.ndarray]) -> np.ndarray:
    """A number for the tuple of values at each place, equal for equal tuples alone; values are below 2^31, as are places."""
    out = columns[0]
    for column in columns[1:]:
        _, out = np.unique(out, return_inverse=True)
        out = out * (int(column.max(initial=0)) + 1) + column
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def doc_chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """(first, last) runs of documents of about limit bytes; a longer one comes alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Totals of flags[first[d]:first[d+1]] for each d."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])

"""Byte-level BPE ids of many texts at once.

Pre-tokens are cut by array operations on code points, told apart exactly by an Arrow dictionary of
their bytes, and looked up in a cache of ids by those bytes; only pre-tokens not seen before go
through the BPE library.  Texts with characters outside the
ranges whose classes are settled here, or with a special token's string, go to the tokenizers
library whole, so every text gets exactly that library's ids.

An empty text has no ids; repeated texts get equal ids; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
CACHE = 1 << 19
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSAFE = range(5)


def _classes() -> np.ndarray:
    out = np.full(0x110000, _UNSAFE, np.uint8)
    for low, high in ((0x20, 0x7F), (0xA1, 0x250), (0x391, 0x3CA), (0x400, 0x460), (0x4E00, 0x9FA6)):
        for c in range(low, high):
            kind = unicodedata.category(chr(c))[0]
            out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    out[0xAD] = _UNSAFE
    return out


class ByteBPE:
    """ids(texts): (all ids, offsets per text); add_special_tokens is off."""

    def __init__(self, json_path: str, ranks_path: str):
        import json

        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        with open(json_path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self._whole = None
        self.classes = _classes()
        self._reset()

    @property
    def whole(self):
        """The tokenizers library's own model, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros((1 << 12) + 1, np.int64)

    def _learn(self, piece: bytes) -> int:
        ids = self._bpe(piece)
        k = len(self.known)
        if k + 2 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(len(self.begin), np.int64)))
        at = self.begin[k]
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[at : at + len(ids)] = ids
        self.begin[k + 1] = at + len(ids)
        self.known[piece] = k
        return k

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            flat, n = self._chunk(texts[at:to])
            parts.append(flat)
            counts.append(n)
            at = to
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.concatenate(counts), out=offsets[1:]) if counts else None
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets

    def _starts(self, cps: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions where a pre-token begins; doc: first positions of the (non-empty) texts."""
        n = len(cps)
        first = np.zeros(n, bool)
        first[doc] = True
        change = np.ones(n, bool)
        change[1:] = cls[1:] != cls[:-1]
        change |= first
        space = cls == _SPACE
        begins = change.copy()
        # The last character of white space before a text's next token is cut off from the rest;
        # if it is a space, the next token begins with it.
        heads = np.flatnonzero(change & ~space & ~first)
        heads = heads[space[heads - 1]]
        begins[heads - 1] = True
        begins[heads[cps[heads - 1] == 32]] = False
        quotes = np.flatnonzero(begins & (cps == 39))
        if len(quotes):
            padded = np.concatenate((cps, np.zeros(3, cps.dtype)))
            where = np.concatenate((np.cumsum(first), np.full(3, -1)))  # a text's number
            same = [where[quotes + k] == where[quotes] for k in (1, 2)]
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = same[0] & np.isin(one, [ord(c) for c in "stmd"])
            pair = one.astype(np.int64) << 32 | two
            long = same[1] & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
            for found, width in ((quotes[short], 2), (quotes[long], 3)):
                begins[found + 1] = False
                after = found + width
                inside = (after < n) & (where[np.minimum(after, n)] == where[found])
                after = after[inside]
                # White space after it keeps its own rule: a space before a token was marked above.
                begins[after] |= ~((cls[after] == _SPACE) & ~change[after])
        return np.flatnonzero(begins)

    def _chunk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lens = np.array([len(t) for t in texts], np.int64)
        edges = np.concatenate(([0], np.cumsum(lens)))
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        cls = self.classes[cps]
        odd = np.zeros(len(texts), bool)
        unsafe = np.flatnonzero(cls == _UNSAFE)
        if len(unsafe):
            odd[np.searchsorted(edges, unsafe, side="right") - 1] = True
        for word in self.special:
            if word in joined:
                odd |= np.array([word in t for t in texts])
        starts = self._starts(cps, cls, edges[:-1][lens > 0]) if len(cps) else np.zeros(0, np.int64)
        wide = np.ones(len(cps) + 1, np.int64)
        for low in (0x7F, 0x7FF, 0xFFFF):
            wide[1:] += cps > low
        wide[0] = 0
        at = np.cumsum(wide)[np.append(starts, len(cps))]
        codes, uniques = np.zeros(0, np.int64), []
        if len(starts):
            found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(joined.encode())]).dictionary_encode()
            codes, uniques = found.indices.to_numpy(), found.dictionary.to_pylist()
        if len(self.known) + len(uniques) > CACHE:
            self._reset()
        get = self.known.get
        rows = np.empty(len(uniques), np.int64)
        for k, piece in enumerate(uniques):
            row = get(piece)
            rows[k] = row if row is not None else self._learn(piece)
        row = rows[codes] if len(codes) else np.zeros(0, np.int64)
        size = self.begin[row + 1] - self.begin[row]
        out_at = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.begin[row] - out_at[:-1], size) + np.arange(out_at[-1])
        flat = self.flat[take]
        bounds = out_at[np.searchsorted(starts, edges)]
        counts = np.diff(bounds)
        if odd.any():
            pieces = []
            for d, text in enumerate(texts):
                if odd[d]:
                    own = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                    counts[d] = len(own)
                else:
                    own = flat[bounds[d] : bounds[d + 1]]
                pieces.append(own)
            flat = np.concatenate(pieces)
        return flat, counts


_loaded: dict[tuple[str, str], ByteBPE] = {}


def byte_bpe(json_path: str, ranks_path: str) -> ByteBPE:
    """One per worker process."""
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = ByteBPE(*key)
    return _loaded[key]

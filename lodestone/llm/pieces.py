"""SentencePiece BPE encoding with seeded merge dropout, and decoding.

A text gets a space mark before it and space marks for its spaces, and is cut into segments before
each run of marks; no piece of the vocabulary crosses such a cut, so segments are encoded alone.  In a segment,
the agenda holds the candidate merges of neighbouring symbols, best score first, then leftmost; a
merge taken off the agenda is skipped for good if a keyed hash of (seed, row's salt, the segment's place
in the text, the merge's place and length) falls under the dropout rate.  Dropout 0 is plain BPE.  Characters without a piece, and
the mark itself where the text has it, become byte pieces, so decoding gives every text back.

Every occurrence of every segment draws skips of its own, and runs repeat exactly.  Occurrences of one
length are merged together: for each distinct segment a worker keeps the ranks of its substrings, and
one array step takes the best candidate of every occurrence at once.  Segments over LONG characters are
merged one by one.

Defined cases: null and empty texts have no pieces and decode to the empty text; very long texts are
encoded whole; repeated rows get equal ids; equal scores go leftmost; a null key is a salt like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .textvec import mix

MARK = "▁"
DROPOUT = 0.1
SEED = 3
CACHE = 1 << 22
LONG = 32
CHUNK = 1 << 18
_NONE = np.iinfo(np.int32).max
_MASK = (1 << 64) - 1


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        skip = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        order = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        self.rank = {p: order[x] for p, x in scores.items()}  # the best score is 0
        self.by_length = {}  # pieces of each length, as fixed binaries of code points, with ids and ranks
        for n in range(1, min(max(map(len, self.ids), default=1), LONG) + 1):
            own = [p for p in self.ids if len(p) == n]
            values = pa.array([p.encode("utf-32-le") for p in own], pa.binary(4 * n))
            self.by_length[n] = values, np.array([self.ids[p] for p in own], np.int32), np.array([self.rank[p] for p in own], np.int32)
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if i in skip else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after other characters; segments can't be encoded alone")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")

    def encode(self, segment: str, dropout: float, key: int) -> list[int]:
        """Ids of one segment; key: 64 bits, the occurrence's own."""
        n = len(segment)
        whole = self.ids.get(segment) if not dropout and n == 1 else None
        if whole is not None:
            return [whole]
        text = list(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        agenda: list[tuple[int, int, str]] = []
        for k in range(n - 1):
            both = segment[k : k + 2]
            r = rank.get(both)
            if r is not None:
                agenda.append((r, k, both))
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        limit = int(dropout * 2.0**64)
        while agenda:
            _, left, both = pop(agenda)
            head = text[left]
            right = after[left]
            if not head or right >= n or head + text[right] != both:
                continue  # one of its symbols has merged with another
            if limit:
                # Multiply, shift and multiply again: the keyed hash of this merge's place and length.
                code = ((key ^ (left << 20 | len(both))) * 0x9E3779B97F4A7C15) & _MASK
                if ((code ^ (code >> 29)) * 0xBF58476D1CE4E5B9) & _MASK < limit:
                    continue
            text[left], text[right] = both, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                more = both + text[nxt]
                r = rank.get(more)
                if r is not None:
                    push(agenda, (r, left, more))
            prev = before[left]
            if prev >= 0:
                more = text[prev] + both
                r = rank.get(more)
                if r is not None:
                    push(agenda, (r, prev, more))
        out: list[int] = []
        for piece in text:
            if piece:
                known = self.ids.get(piece)
                if known is not None:
                    out.append(known)
                else:
                    out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


class Encoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be in 0..1")
        self.vocabulary = Vocabulary(path)
        self.dropout, self.seed = dropout, seed
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}  # a segment's number
        self.learnt = 0
        self.size = np.zeros(1 << 12, np.int64)
        self.base = np.zeros(1 << 12, np.int64)  # where its substrings begin: [start * size + length - 1]
        self.used = 0
        self.rank = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int32)  # a substring's ids: where they are in self.store,
        self.width = np.zeros(1 << 16, np.int8)  # and how many
        self.store = np.arange(len(self.vocabulary.pieces), dtype=np.uint32)
        self.spelt: dict[str, int] = {}

    def _spell(self, c: str) -> tuple[int, int]:
        """Where a character without a piece has its byte pieces."""
        raw = c.encode("utf-8", "surrogatepass")
        if c not in self.spelt:
            self.spelt[c] = len(self.store)
            self.store = np.append(self.store, np.array([self.vocabulary.bytes[b] for b in raw], np.uint32))
        return self.spelt[c], len(raw)

    def _learn(self, cps: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new segments cps[start:start + size]; those up to LONG get their substrings' ranks."""
        m, number = len(starts), self.learnt
        self.learnt += m
        while self.learnt > len(self.size):
            self.size, self.base = (np.concatenate((x, np.zeros(len(x), x.dtype))) for x in (self.size, self.base))
        cells = np.where(size <= LONG, size * size, 0)
        base = self.used + np.cumsum(cells) - cells
        self.size[number : self.learnt], self.base[number : self.learnt] = size, base
        low, self.used = self.used, self.used + int(cells.sum())
        while self.used > len(self.rank):
            self.rank, self.first, self.width = (np.concatenate((x, np.zeros(len(x), x.dtype))) for x in (self.rank, self.first, self.width))
        self.rank[low : self.used] = _NONE
        short = np.flatnonzero(size <= LONG)
        for width, (pieces, ids, ranks) in self.vocabulary.by_length.items():
            own = short[size[short] >= width]
            n = size[own] - width + 1
            who = np.repeat(own, n)
            at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            cell = base[who] + at * size[who] + width - 1
            windows = cps[(starts[who] + at)[:, None] + np.arange(width)]
            if width == 1:
                chars, inverse = np.unique(windows, return_inverse=True)
                spelt = np.array([self._spell(chr(c)) for c in chars.tolist()], np.int64).reshape(-1, 2)[inverse.ravel()]
                self.first[cell], self.width[cell] = spelt[:, 0], spelt[:, 1]
            windows = pa.Array.from_buffers(pa.binary(4 * width), len(who), [None, pa.py_buffer(np.ascontiguousarray(windows))])
            found = pa.compute.index_in(windows, value_set=pieces).fill_null(-1).to_numpy()
            hit = found >= 0
            cell, found = cell[hit], found[hit]
            self.rank[cell], self.first[cell], self.width[cell] = ranks[found], ids[found], 1
        return np.arange(number, self.learnt)

    def _merge(self, n: int, base: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which characters begin a piece, occurrences x n, for occurrences of segments of n characters."""
        m, limit = len(base), int(self.dropout * 2.0**64)
        on = np.ones((m, n), bool)
        if n == 1:
            return on
        before = np.tile(np.maximum(np.arange(n + 1) - 1, 0), (m, 1))
        after = np.tile(np.minimum(np.arange(n + 1) + 1, n), (m, 1))

        def ranks(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Rank of the merge into low..high; none if it is skipped or no piece."""
            size = high - low
            out = self.rank[base[rows] + low * n + size - 1]
            if limit:
                h = (keys[rows] ^ (low << 20 | size).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out[(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) <= np.uint64(limit - 1)] = _NONE
            return out

        # One candidate for each inner cut: the merge of the two symbols that it parts.
        best = np.full((m, n + 1), _NONE, np.int32)
        every = np.arange(m)
        for k in range(1, n):
            best[:, k] = ranks(every, np.full(m, k - 1), np.full(m, k + 1))
        act = every
        while len(act):
            own = best[act]
            k = own.argmin(axis=1)  # the leftmost of equal ranks
            live = own[np.arange(len(act)), k] != _NONE
            act, k = act[live], k[live]
            low, high = before[act, k], after[act, k]
            on[act, k] = False
            best[act, k] = _NONE
            after[act, low] = high
            before[act, high] = low
            best[act, low] = np.where(low > 0, ranks(act, before[act, low], high), _NONE)
            best[act, high] = np.where(high < n, ranks(act, low, after[act, high]), _NONE)
        return on

    def _encoded(self, joined: bytes, cps: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each occurrence's begin); starts: of the segments, which follow each other."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        wide = np.ones(len(cps) + 1, np.int64)
        for low in (0x7F, 0x7FF, 0xFFFF):
            wide[1:] += cps > low
        wide[0] = 0
        ends = np.append(starts[1:], len(cps))
        at = np.cumsum(wide)[np.append(starts, len(cps))]
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
        codes, uniques = found.indices.to_numpy(), found.dictionary.to_pylist()
        if self.used > CACHE:
            self._reset()
        numbers = np.fromiter((self.known.get(u, -1) for u in uniques), np.int64, len(uniques))
        fresh = np.flatnonzero(numbers < 0)
        example = np.zeros(len(uniques), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        numbers[fresh] = self._learn(cps, starts[example[fresh]], (ends - starts)[example[fresh]])
        self.known.update(zip((uniques[k] for k in fresh.tolist()), numbers[fresh].tolist()))
        if not self.dropout:  # every occurrence of a segment is the same
            occurrence, keys = numbers, np.zeros(len(numbers), np.uint64)
        else:
            occurrence = numbers[codes]
        size = self.size[occurrence]
        order = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[order], np.arange(LONG + 2))
        counts, groups = np.zeros(len(occurrence), np.int64), []
        for n in range(1, LONG + 1):
            for a in range(edges[n], edges[n + 1], 1 << 16):
                rows = order[a : min(a + (1 << 16), edges[n + 1])]
                base = self.base[occurrence[rows]]
                who, begin = np.nonzero(self._merge(n, base, keys[rows]))
                heads = np.searchsorted(who, np.arange(len(rows)))
                end = np.append(begin[1:], 0)
                end[np.append(heads[1:], len(who)) - 1] = n
                cell = base[who] + begin * n + end - begin - 1
                width = self.width[cell].astype(np.int64)
                total = np.cumsum(width)
                place = total - width - (total - width)[heads][who]
                counts[rows] = np.diff(np.append((total - width)[heads], total[-1]))
                groups.append((rows[who], place, self.first[cell], width))
        bounds = np.zeros(len(occurrence) + 1, np.int64)
        spelt = {}
        for r in order[edges[LONG + 1] :].tolist():
            spelt[r] = self.vocabulary.encode(uniques[codes[r] if self.dropout else r].decode("utf-8", "surrogatepass"), self.dropout, int(keys[r]))
            counts[r] = len(spelt[r])
        np.cumsum(counts, out=bounds[1:])
        flat = np.zeros(bounds[-1], np.uint32)
        for rows, place, first, width in groups:
            to = bounds[rows] + place
            flat[to] = self.store[first]
            for k in range(1, int(width.max())):
                more = width > k
                flat[to[more] + k] = self.store[first[more] + k]
        for r, own in spelt.items():
            flat[bounds[r] : bounds[r + 1]] = own
        if not self.dropout:
            n = counts[codes]
            out = np.concatenate(([0], np.cumsum(n)))
            return flat[np.repeat(bounds[codes] - out[:-1], n) + np.arange(out[-1])], out
        return flat, bounds

    def ids(self, texts: Sequence[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets per text); salts: 64 bits of each row's own."""
        parts, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            flat, n = self._chunk(texts[at:to], salts[at:to])
            parts.append(flat)
            counts.append(n)
            at = to
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.concatenate(counts), out=offsets[1:])
        return np.concatenate(parts), offsets

    def _chunk(self, texts: Sequence[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = [d for d, t in enumerate(texts) if MARK in t]
        marked = ["" if not t or MARK in t else MARK + t.replace(" ", MARK) for t in texts]
        joined = "".join(marked)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        is_mark = cps == ord(MARK)
        cuts = is_mark.copy()
        cuts[1:] &= ~is_mark[:-1]
        full = edges[:-1][np.diff(edges) > 0]
        cuts[full] = True
        starts = np.flatnonzero(cuts)
        first = np.searchsorted(starts, edges)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        place = np.arange(len(starts)) - first[doc]
        keys = mix(mix(salts.astype(np.uint64), self.seed)[doc] + place.astype(np.uint64))
        flat, out_at = self._encoded(joined.encode("utf-8", "surrogatepass"), cps, starts, keys)
        bounds = out_at[first]
        counts = np.diff(bounds)
        if odd:
            pieces, special = [], set(odd)
            for d, text in enumerate(texts):
                own = flat[bounds[d] : bounds[d + 1]]
                if d in special:
                    own = np.array(self._with_marks(text, int(salts[d])), np.uint32)
                    counts[d] = len(own)
                pieces.append(own)
            flat = np.concatenate(pieces)
        return flat, counts

    def _with_marks(self, text: str, salt: int) -> list[int]:
        """A text that holds the mark as a character: that character alone becomes bytes."""
        out: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += [self.vocabulary.bytes[b] for b in MARK.encode()]
            part = (MARK if k == 0 else "") + part.replace(" ", MARK)
            if part:
                raw = hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8, salt=(salt + k & _MASK).to_bytes(8, "big") + self.seed.to_bytes(8, "big")).digest()
                out += self.vocabulary.encode(part, self.dropout, int.from_bytes(raw, "big"))
        return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, key: str, text: str, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(key, ids, ids_crc32, lossless): the salt of a row is its key; lossless: the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, dropout, seed)
        raw = np.array(encoder.vocabulary.raw, object)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            flat, offsets = encoder.ids(texts, _salts(batch.column(0)))
            check, lossless = [], []
            for d, text in enumerate(texts):
                own = flat[offsets[d] : offsets[d + 1]]
                check.append(zlib.crc32(own.astype("<u4").tobytes()))
                lossless.append(b"".join(raw[own])[1:] == text.encode("utf-8"))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(check, pa.int64()), pa.array(lossless, pa.bool_())], ["key", "ids", "ids_crc32", "lossless"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids array<int>, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(key, text) from (key, ids); a null list of ids decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(path, 0.0).vocabulary
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = [vocabulary.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return encoded.select("key", "ids").mapInArrow(run, "key long, text string")


def _salts(keys: pa.Array) -> np.ndarray:
    return np.asarray(keys.fill_null(-(2**63))).astype(np.int64).view(np.uint64)


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids with dropout, their number and checksum, and whether they decode to the text."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", "ids_crc32", "lossless")

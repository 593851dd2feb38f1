"""Texts whose structure fools polynomial hashes are told apart everywhere."""

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import forest, pieces, quality, textvec
from lodestone.llm.tokens import ByteBPE


def thue_morse(n, pair):
    word = [pair[0]]
    while len(word) < n:
        word += [pair[1] if x == pair[0] else pair[0] for x in word]
    return word


PAIRS = [("".join(thue_morse(n, "ab")), "".join(thue_morse(n, "ba"))) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("one, two", PAIRS)
def test_words(one, two):
    raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    starts, ends, _ = textvec.words(raw, np.array([0, len(raw)]))
    h = textvec.span_hashes(raw, starts, ends, textvec.LOWER)
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("one, two", PAIRS)
def test_tokens(one, two):
    model = ByteBPE(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for own in ([one, two], [two, one]):
        flat, offsets = model.ids(own)
        for k, t in enumerate(own):
            assert flat[offsets[k] : offsets[k + 1]].tolist() == model.whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("one, two", PAIRS)
def test_pieces(one, two):
    encoder = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"), 0.0)
    flat, offsets = encoder.ids([one, two, one], np.zeros(3, np.uint64))
    assert [encoder.vocabulary.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])] == [one, two, one]


def test_sets_lines_and_texts(spark):
    words = [" ".join(thue_morse(1024, pair)) for pair in (("x", "y"), ("y", "x"))]
    own = [*PAIRS[0], *(f"{t} a b c d e f" for t in PAIRS[1]), *words, *("\n".join(t.split(" ")) for t in words)]
    docs = spark.createDataFrame([(k, t, "h") for k, t in enumerate(own)], "doc_id long, text string, source string")
    signed = forest.signatures(docs, "doc_id", "text").collect()
    assert len({(r["lo"], r["hi"]) for r in signed[:4]}) == 4
    stats = quality.statistics(docs, "doc_id", "text", "source").collect()
    assert len({(r["text_lo"], r["text_hi"]) for r in stats}) == len(own)
    assert len({line["line"] for r in stats[:6] for line in r["lines"]}) == 6
    found = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs.filter("doc_id < 4"), "doc_id", "text").collect()}
    assert found == {k: k for k in range(4)}


def test_names_differ_and_depend_on_bytes_alone():
    rnd = np.random.default_rng(2)
    words = {bytes(rnd.integers(33, 127, n, dtype=np.uint8)) for n in list(range(1, 70)) * 300} | {b"a" * n for n in range(1, 70)} | {b"\0" * n for n in range(1, 70)}
    words = sorted(words)
    spans = lambda own: (np.cumsum([0, *map(len, own)]), np.frombuffer(b"".join(own), np.uint8))
    one = dict(zip(words, textvec.names(spans(words)).tolist()))
    assert len(set(one.values())) == len(words)
    assert dict(zip(words[::-1], textvec.names(spans(words[::-1])).tolist())) == one
    assert dict(zip(words[:5], textvec.names(spans(words[:5])).tolist())) == {w: one[w] for w in words[:5]}
    assert len(textvec.names(spans([]))) == 0


def test_windows_of_crafted_words_are_told_apart(spark):
    """Words whose names make up for each other in sums: neither windows nor shingles may meet."""
    filler = " ".join(f"f{k}" for k in range(60))
    (row,) = quality.statistics(spark.createDataFrame([(1, f"red fox ran {filler} abd guw z`oxa<0", "h")], "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    assert row["n_repeat_words"] == 0
    two = ["one two six ten end", "aaa bbb acp dzb 5g84.[;"]
    docs = spark.createDataFrame(list(enumerate(two)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs, "doc_id", "text").collect()} == {0: 0, 1: 1}


def test_tuple_hashes_are_siphash():
    """Against a plain SipHash-1-3 with the same key."""
    key, mask = [int(x) for x in textvec._KEYS[:2]], 2**64 - 1
    turn = lambda x, b: (x << b | x >> (64 - b)) & mask

    def rounds(v, n):
        for _ in range(n):
            v[0] = (v[0] + v[1]) & mask
            v[1] = turn(v[1], 13) ^ v[0]
            v[0] = turn(v[0], 32)
            v[2] = (v[2] + v[3]) & mask
            v[3] = turn(v[3], 16) ^ v[2]
            v[0] = (v[0] + v[3]) & mask
            v[3] = turn(v[3], 21) ^ v[0]
            v[2] = (v[2] + v[1]) & mask
            v[1] = turn(v[1], 17) ^ v[2]
            v[2] = turn(v[2], 32)

    rnd = np.random.default_rng(3)
    for size in (1, 3, 5):
        columns = [rnd.integers(0, 2**63, 7).astype(np.uint64) * np.uint64(2) for _ in range(size)]
        got = textvec.tuple_hashes(columns).tolist()
        for at in range(7):
            v = [c ^ key[k % 2] for k, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))]
            for m in [*(int(c[at]) for c in columns), size * 8 << 56]:
                v[3] ^= m
                rounds(v, 1)
                v[0] ^= m
            v[2] ^= 0xFF
            rounds(v, 3)
            assert got[at] == v[0] ^ v[1] ^ v[2] ^ v[3]


def test_tuple_codes_are_exact():
    rnd = np.random.default_rng(4)
    columns = [rnd.integers(0, n, 2000) for n in (3, 5, 2, 4)]
    codes = textvec.tuple_codes(columns).tolist()
    whole = list(zip(*(c.tolist() for c in columns)))
    assert len(set(codes)) == len(set(whole)) == len(set(zip(codes, whole)))

"""Parts of the operators on their own."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import pieces, pii, textvec, vectors
from lodestone.llm.tokens import ByteBPE

ODD = ["'s", "'", "ll", "re", " ", "  ", "\n", "\n\n", "\t", "a", "b", "é", "1", "22", "!", " 's", "'d", "<|endoftext|>", " ", "日本", "\x1c", "😀", "٣", "don't", "▁", "the "]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_byte_bpe_equals_library():
    model = ByteBPE(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = texts(8000, 1)
    flat, offsets = model.ids(own)
    for k, t in enumerate(own):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == model.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_dropout_zero_equals_library_and_all_decode():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = texts(3000, 2)
    salts = np.arange(len(own), dtype=np.uint64)
    for rate in (0.0, 0.1, 0.5, 1.0):
        encoder = pieces.Encoder(path, rate)
        flat, offsets = encoder.ids(own, salts)
        for k, t in enumerate(own):
            ids = flat[offsets[k] : offsets[k + 1]].tolist()
            assert encoder.vocabulary.decode(ids) == t
            if rate == 0 and pieces.MARK not in t:
                assert ids == library.encode(t), repr(t)


def test_dropout_varies_by_seed_and_occurrence():
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "internationalisation " * 50
    one, two = (pieces.Encoder(path, 0.3, seed).ids([text], np.zeros(1, np.uint64))[0].tolist() for seed in (1, 2))
    again = pieces.Encoder(path, 0.3, 1).ids([text], np.zeros(1, np.uint64))[0].tolist()
    assert one == again and one != two
    plain = pieces.Encoder(path, 0.0).ids([text], np.zeros(1, np.uint64))[0]
    assert len(one) > len(plain)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_of_every_occurrence_is_its_own(rate):
    encoder = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"), rate)
    own = [" ".join(["the internationalisation"] * 200), "the internationalisation " * 3, "wordswithoutanyspacebetweenthem", *(t for t in texts(500, 3) if pieces.MARK not in t)]
    salts = np.arange(len(own), dtype=np.uint64)
    for _ in range(2):  # the second time from the cache
        flat, offsets = encoder.ids(own, salts)
        for k, t in enumerate(own):
            segments = re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁")) if t else []
            keys = textvec.mix(textvec.mix(salts[k : k + 1], encoder.seed) + np.arange(len(segments), dtype=np.uint64)).tolist()
            want = [encoder.vocabulary.encode(s, rate, key) for s, key in zip(segments, keys)]
            assert flat[offsets[k] : offsets[k + 1]].tolist() == [i for ids in want for i in ids]
            if k == 0 and rate == 0.1:
                assert len({tuple(ids) for ids in want[1::2]}) > 20
                # No more than the one or two merges of "the" have to be drawn for it to stay plain.
                plain = encoder.vocabulary.encode("▁the", 0.0, 0)
                assert 0.05 < sum(ids != plain for ids in want[::2]) / 200 < 0.5


@pytest.mark.parametrize("size", [1, 2, 7, 10, 1000])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(b"k", "t", size)
    out = [f.permute(x) for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [f.permute(y, True) for y in out] == list(range(size))


def test_pseudonyms_keep_format_link_and_invert():
    made = pii.Pseudonyms(b"key")
    text = "a.b-77@mail3.example.com 4111 1111 1111 1111 4111111111111111 123-45-6789 +1 (017) 555-7713 169.122.221.182 2024-02-29 1/2/2020 31.12.1999 GB82WEST12345698765432"
    new, spans = made.replace(text)
    assert [k for k, _, _ in spans] == ["mail", "card", "card", "ssn", "phone", "ip", "date", "date", "date", "iban"]
    assert len(spans) == 10 and made.replace(new, True)[0] == text
    parts = new.split(" ")
    assert "".join(parts[1:5]) == parts[5] and pii.luhn(parts[5]) and parts[5] != "4111111111111111"
    same = "no 999.1.1.1 or 4111111111111112 or 2024-13-01 or x123-45-6789 v1.2.3"
    assert made.replace(same) == (same, [])
    assert pii.Pseudonyms(b"other").replace(text)[0] != new


def test_pseudonyms_of_other_written_forms():
    made = pii.Pseudonyms(b"key")
    text = "12/31/1999, 03-25-2021, 3782 822463 10005, 3782-822463-10005, DE89 3704 0044 0532 0130 00 AND GB82-WEST-1234-5698-7654-32, LT20 4111 1111 1111 1111."
    new, spans = made.replace(text)
    assert [k for k, _, _ in spans] == ["date", "date", "card", "card", "iban", "iban", "card"]
    assert made.replace(new, True)[0] == text
    assert all(text[a:b] != new[a:b] for _, a, b in spans) and len(new) == len(text)
    assert [new[a:b] for a, b in (p.span() for p in re.finditer("[ ,-]", text))] == [p.group() for p in re.finditer("[ ,-]", text)]
    days = [f"{m:02d}/{d:02d}/2021" for m in range(1, 13) for d in range(13, 29)]
    out = [made.replace(x)[0] for x in days]
    assert len(set(out)) == len(days) and all(int(x[3:5]) > 12 for x in out) and [made.replace(x, True)[0] for x in out] == days
    same = "02/30/2021 13/13/2021 DE89 3704 0044 0532 0130 01 3782 822463 10006"
    assert made.replace(same) == (same, [])
    # An iban-like row of groups around a card never turns into an iban, so all come back.
    cards = [f"LT20 {x[:4]} {x[4:8]} {x[8:12]} {x[12:]}" for k in range(600) for x in [f"4{k:014d}" + pii._luhn_digit(f"4{k:014d}")]]
    assert all(made.replace(made.replace(x)[0], True)[0] == x for x in cards)


def test_word_hashes_depend_on_bytes_only():
    raw = np.frombuffer("aa bb aa\tcc  bb\x0baa".encode(), np.uint8)
    starts, ends, first = textvec.words(raw, np.array([0, 8, 8, len(raw)]))
    h = textvec.span_hashes(raw, starts, ends, textvec.LOWER)
    assert first.tolist() == [0, 3, 3, 6]
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_words_stop_at_texts():
    raw = np.frombuffer(b"abcdef", np.uint8)
    starts, ends, first = textvec.words(raw, np.array([0, 3, 6]))
    assert starts.tolist() == [0, 3] and ends.tolist() == [3, 6] and first.tolist() == [0, 1, 2]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    data = rng.standard_normal((3000, 96))
    codes = vectors.Codes(data, data.mean(axis=0), vectors.rotation(96))
    queries = rng.standard_normal((50, 96))
    value, error = codes.estimate(queries)
    exact = queries @ data.T
    assert abs((value - exact).mean()) < 0.1
    assert (np.abs(value - exact) <= error).mean() > 0.9

"""Binary pieces, vector codes and manifests against plain versions of what they mean."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import binary, exponion, merkle, registry

Q = registry.QUERIES


@pytest.fixture(params=["data", "docs_dir"])
def folder(request):
    return request.getfixturevalue(request.param)


def test_op11(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = Q["op11_power_of_two"](spark, folder).collect()
    want = Counter()
    for d, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            want[d, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    # Buckets follow each other by length, without gaps, and no piece shares its sequence.
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and all(r["offset"] == 0 for r in rows)


def test_op11_written_buckets_give_the_texts_back(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [f"text {k} " * k for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    binary.write_buckets(binary.decompose(docs, longest=64, with_ids=True), str(tmp_path / "out"))
    parts = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert len(r["ids"]) == r["length"] <= 64
        parts[r["doc_id"]].append((r["start"], r["ids"]))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, found in parts.items():
        ids = [x for _, p in sorted(found) for x in p]
        assert ids[-1] == 0 and whole.decode(ids[:-1], skip_special_tokens=False) == texts[d]
    assert len(parts) == 40
    with pytest.raises(ValueError):
        binary.decompose(docs, longest=48)


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """rows of (id, vector, label): [(id, code, error)] and codebooks, with Python's integers."""
    kept = [(i, v, g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted(((i, v, g) for i, v, g in kept if len(v) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-dim // parts)
    ints = [[exponion.whole(x) for x in v] + [0] * (width * parts - dim) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for k in range(rounds + 1):
        found = [[min((far(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]
        if k < rounds:
            for p in range(parts):
                held = defaultdict(list)
                for v, f in zip(cut, found):
                    held[f[p][1]].append(v[p])
                for e, xs in held.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    return [(i, "".join(f"{e:02x}" for _, e in f), min(sum(d for d, _ in f), 2**63 - 1), g) for (i, _, g), f in zip(kept, found)], books


def check_codes(coded, books, want):
    rows, plain = want
    assert books.astype(object).tolist() == plain
    code = lambda r: "".join(f"{x:02x}" for x in np.frombuffer(r["codes"], np.uint16))
    assert Counter((r["id"], code(r), r["error"], r["label"]) for r in coded.collect()) == Counter(rows)


def test_op12(spark, docs_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found, books = plain_codes(rows)
    total = defaultdict(int)
    for *_, error, label in found:
        total[label] += error
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    want = Counter((i, code, error, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, code, error, label in found)
    got = Q["op12_exponion_codes"](spark, docs_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("scale", [1.0, 2e4, 1e9, 1e37])
def test_op12_many_ties_and_any_size(spark, scale):
    """Few different values: entries and distances tie; large ones leave the doubles."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x) * np.float32(scale)) for x in rng.integers(-2, 3, 6)], int(i) % 3) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "k long, v array<float>, g int").repartition(3)
    coded, books = exponion.train_and_encode(df, "k", "v", "g", entries=20, rounds=3)
    check_codes(coded, books, plain_codes(rows, 20, 3))


def test_op12_rings_miss_no_entry():
    rng = np.random.default_rng(6)
    for entries, width in ((256, 2), (256, 16), (100, 5), (1, 3)):
        book = exponion.Book(rng.integers(-50, 50, (entries, width)).astype(float))
        x = rng.integers(-80, 80, (500, width)).astype(float)
        found, best = book.nearest(x, rng.integers(0, entries, 500))
        apart = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
        assert (best == apart.min(axis=1)).all() and (found == apart.argmin(axis=1)).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, fanout=16):
    """The last node's digest, and every first node's [(place, other digests)] level by level."""
    paths = [[] for _ in nodes]
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for place in range(len(run)):
                for k in below[at + place]:
                    paths[k].append((place, run[:place] + run[place + 1 :]))
            up.append(sha(*run))
            held.append([k for b in below[at : at + fanout] for k in b])
        nodes, below = up, held
    return nodes[0], paths


def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        leaf = sha(*map(field, r))
        changed = sha(*map(field, (*r[:4], r[4] and r[4].translate(lower))))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, changed if tampered else leaf, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    for s, top in zip(order, tops):
        for (*_, leaf, start, key), path in zip(sorted(groups[s]), trees[s][1]):
            fold = start
            for place, others in path + top:
                fold = sha(*others[:place], fold, *others[place:])
            yield key, leaf, trees[s][0], root, sha(*(x for _, others in path + top for x in others)), fold, fold == root


def test_op13(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.COLUMNS).collect()]
    got = Q["op13_merkle_manifest"](spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("sizes", [[1], [16], [17], [300, 1, 16], [1] * 40, [5000, 2, 257]])
def test_op13_tree_shapes(spark, sizes, tmp_path):
    rows = [(k, s and f"src {s}", None, k % 3 or None, f"Text {k}") for s, n in enumerate(sizes) for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select(*merkle.COLUMNS).collect()]
    got = Q["op13_merkle_manifest"](spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert any(not r["verified"] for r in got) == any(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows)


def test_op13_rows_may_have_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 7, "x")], "id long, source string, extra int, t string")
    rows = df.select("id", "source", "extra", F.col("id").alias("ord"), merkle.leaf([F.col("t")]).alias("leaf"))
    found, root = merkle.manifest(rows)
    row = found.first()
    assert row["leaf"] == row["subroot"] == root == sha("1:x") and row["up"] == [] and row["extra"] == 7

"""The pipeline's stages, each against brute force on what the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline

from test_queries import components, line_verdicts, normal_line, shingle_set, spans


@pytest.fixture(scope="module", params=["data", "docs_dir"])
def stages(request, spark, tmp_path_factory):
    """[(name, rows before, rows after)] of every stage, written and read between."""
    folder = request.getfixturevalue(request.param)
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [r.asDict() for r in docs.select(*pipeline.COLUMNS).collect()]
        stage(spark, docs, folder).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == list(pipeline.COLUMNS)
        out.append((name, before, [r.asDict() for r in docs.collect()]))
    return out


def test_language_rejects_what_has_no_letter(stages):
    _, before, after = stages[0]
    kept = Counter((r["doc_id"], r["text"]) for r in after)
    for r in before:
        letters = any(c.isalpha() for c in r["text"] or "")
        if not letters:
            assert (r["doc_id"], r["text"]) not in kept
    assert sum(kept.values()) >= 0.9 * sum(any(c.isalpha() for c in r["text"] or "") for r in before)


def test_quality_keeps_and_strips(stages):
    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before]
    verdict = line_verdicts(rows)
    holders = {}
    for _, t, _, host in rows:
        for line in {normal_line(x) for x in (t or "").split("\n")} - {()}:
            holders.setdefault((host, line), set()).add(t or "")
    texts = {}
    for _, t, _, host in rows:
        texts.setdefault(host, set()).add(t or "")

    def clean(t, host):
        common = lambda line: bool(line) and len(holders[host, line]) > 10 and len(holders[host, line]) > 0.05 * len(texts[host])
        return "\n".join(x for x in t.split("\n") if not common(normal_line(x)))

    want = Counter((d, clean(t or "", h)) for d, t, _, h in rows if verdict[h, t or ""][1])
    assert Counter((r["doc_id"], r["text"]) for r in after) == want


def test_near_duplicates_keep_one(stages):
    _, before, after = stages[2]
    want = components({r["doc_id"]: shingle_set(r["text"]) for r in before if r["doc_id"] is not None})
    ids = [r["doc_id"] for r in after if r["doc_id"] is not None]
    assert sorted(ids) == sorted({c for d, c in want.items() if c == d})
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)


def test_secrets_are_gone_and_documents_stay(stages):
    _, before, after = stages[3]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    old = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        if r["doc_id"] is not None:
            assert not spans(r["text"])
            assert bool(spans(old[r["doc_id"]])) <= (r["text"] != old[r["doc_id"]])
            if not spans(old[r["doc_id"]]) and "-----BEGIN" not in old[r["doc_id"]]:
                assert r["text"] == old[r["doc_id"]]


def test_packing_covers_all(stages):
    _, before, after = stages[4]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        assert sum(n for _, n in held) <= 2048
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n


def test_run_equals_stages(spark, data, stages, request):
    if "data" not in request.node.callspec.params.values():
        pytest.skip("one table is enough")
    rows = pipeline.run(spark, data).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(map(key, rows)) == Counter(map(key, stages[4][2]))

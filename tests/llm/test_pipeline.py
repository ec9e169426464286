"""The pipeline's stages on the smallest tables: each one against brute force over its own input."""

import os
import re

import pytest

import corpus_pipeline
from tarn.llm import decontaminate
from tarn.llm._shared import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], FOLDER), name.replace(" ", "-")))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay_until_the_last_stage(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_quality_stage_drops_what_fails_the_base(steps):
    before, after = texts(steps[0]), texts(steps[1])
    for i, t in before.items():
        w = W.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {g for g in grams if grams.count(g) > 1} if len(w) < 2000 else set()
        covered = {k + z for k, g in enumerate(grams) if g in again for z in range(3)}
        if len(w) < 50 or 100 * len(covered) > 50 * len(w):
            assert i not in after
    assert 0.5 * len(before) < len(after) < len(before)


def test_line_stage(steps):
    seen, expected = set(), {}
    for i, t in sorted(texts(steps[1]).items()):
        lines = t.split("\n")
        worded = [k for k, line in enumerate(lines) if W.search(line)]
        gone = set()
        for n in (1, 2, 3):
            for k in range(len(worded) - n + 1):
                key = tuple(lines[j] for j in worded[k : k + n])
                if n == 3 or sum(len(W.findall(x)) for x in key) >= 50:
                    gone |= set(worded[k : k + n]) if key in seen else set()
                    seen.add(key)
        if not gone or len(gone) < len(worded):
            expected[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert texts(steps[2]) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_near_stage(steps):
    rows = sorted(texts(steps[2]).items())
    own = {}
    for i, t in rows:
        w = W.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        own[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}
    root = {i: i for i in own}
    for _ in range(len(own)):
        pairs = [(a, b) for a in own for b in own if root[a] < root[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
        if not pairs:
            break
        for a, b in pairs:
            low = min(root[a], root[b])
            root = {i: low if r in (root[a], root[b]) else r for i, r in root.items()}
    assert texts(steps[3]) == {i: t for i, t in rows if root[i] == i}


def test_benchmark_stage(spark, steps):
    items = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    runs = {tuple(i) for i in items}
    sizes = {len(i) for i in items}
    clean = {}
    for i, t in texts(steps[3]).items():
        w = decontaminate.words(t)
        if not any(tuple(w[k : k + n]) in runs for n in sizes for k in range(len(w) - n + 1)):
            clean[i] = t
    assert texts(steps[4]) == clean


def test_packing_stage_covers_all(steps):
    packed = steps[5].collect()
    assert {r["doc_id"] for r in packed} == set(texts(steps[4]))
    for i in {r["doc_id"] for r in packed}:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))


def test_empty_corpus(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []

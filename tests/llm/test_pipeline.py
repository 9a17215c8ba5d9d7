"""The pipeline's stages, each against a plain Python version on what it was given, and run() against the stages."""

from collections import Counter

import pytest

import corpus_pipeline
from narrata.llm import quality, secrets
from narrata.llm.common import stage
from tests.llm.test_operators import components, encoded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(stage(f(spark, out[-1], SF), name.replace(" ", "-")))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns(steps):
    assert all(c == steps[1][0] for c in steps[1][:-1])


def test_quality_stage(spark, steps):
    scored = quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in steps[0][1]) == sorted(r.doc_id for r in scored.collect() if r._score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0][1]}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_near_duplicate_stage(steps):
    label, _ = components([(r.doc_id, r.text) for r in steps[0][1]], 5)
    assert sorted(r.doc_id for r in steps[0][2]) == sorted(i for i, first in label.items() if i == first)


def test_secret_stage(steps):
    before = {r.doc_id: r for r in steps[0][2]}
    assert len(steps[0][3]) == len(before)
    for r in steps[0][3]:
        assert r.text == secrets.redacted(before[r.doc_id].text) and r.n_chars == len(r.text) and r.source == before[r.doc_id].source
        assert secrets.base_spans(r.text, r.text.lower()) == []


def test_mixing_stage(steps):
    sizes = {r.doc_id: len(r.text.split()) for r in steps[0][3]}
    source = {r.doc_id: r.source for r in steps[0][3]}
    taken = Counter(r.doc_id for r in steps[0][4])
    assert set(taken) <= set(sizes) and max(taken.values()) <= 3
    names = sorted(set(source.values()))
    size = Counter()
    for i, n in sizes.items():
        size[source[i]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        got = sum(n * taken[i] for i, n in sizes.items() if source[i] == s)
        goal = 3 * size[s] if s in full else level * weight[s]
        assert abs(got - goal) <= max(n for i, n in sizes.items() if source[i] == s)


def test_encoding_stage(spark, steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert sorted(map(tuple, steps[0][5])) == sorted((r.doc_id, *encoded(tk, r.text)) for r in steps[0][4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[0][5]))

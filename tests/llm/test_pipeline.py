"""The pipeline at a small size, stage by stage against plain versions."""

from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from leafpress.llm import byte_bpe, quality
from tests.llm.test_native import fill, plain_classes
from tests.llm.test_near import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    known = [r.doc_id for r in stages[0] if r.doc_id in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) / len(known) > 0.97
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    x = np.array([quality.features(r.text.encode()) for r in stages[0]])
    assert kept == {r.doc_id for r, s in zip(stages[0], model.score(x)) if s >= 0.5}


def test_exact(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    assert sorted(r.doc_id for r in stages[2]) == sorted(c[0] for c in plain_classes(rows) if c[3])


def test_near(stages):
    """By the rule for stages on word shingles: five words, similarity of at least 0.8."""
    assert sorted(r.doc_id for r in stages[3]) == plain_kept([(r.doc_id, r.text) for r in stages[2]])


def test_mix_and_tokens(stages):
    sizes = Counter()
    for r in stages[3]:
        sizes[r.source] += len(r.text.encode().split())
    want, got = fill(dict(sizes)), Counter()
    for r in stages[4]:
        got[r.source] += len(r.text.encode().split())
    longest = max(len(r.text.encode().split()) for r in stages[3])
    assert all(abs(got[s] - want[s]) <= longest / 2 for s in want)
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    texts, c = {r.doc_id: r.text for r in stages[4]}, byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"))
    assert all(c.decode(r.ids, r.offsets).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) == len(r.offsets) for r in stages[5])


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0

"""Quality classifier: held-out accuracy, and odd inputs."""

import math
import string
import zlib

import numpy as np

from leafpress.llm import quality, queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    out = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(out) > 50
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)


def plain_features(text):
    """The features once more, one character and word at a time."""
    n, words = max(1, len(text)), text.split()
    m = max(1, len(words))
    share = lambda ok: sum(map(ok, text)) / n
    chars = [share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), share(lambda c: c == 32), share(lambda c: c == 10), share(lambda c: c >= 128), share(lambda c: c < 9)]
    marks = [text.count(c.encode()) / m for c in string.punctuation]
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    once, lines = len(set(words)), [x for x in text.split(b"\n") if x]
    windows = [words[i : i + 50] for i in range(0, len(words), 50)]
    shares = [len(set(w)) / len(w) for w in windows] or [1.0]
    caps = sum(w.isupper() and len(w) > 1 for w in words) / m
    odd = sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in words) / m
    rest = [math.log1p(len(words)), math.log1p(len(text)), once / m, once / math.sqrt(m), sum(a == b for a, b in zip(words, words[1:])) / m, mean / 10, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)) / 10, max(sizes) / 100,
            len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines))), min(shares), sum(shares) / len(shares), caps, odd, sum(marks), len(set(text)) / 100]
    return chars + marks + rest + [math.sqrt(x) for x in chars + marks]


def plain_fit(x, y):
    """The same loss by plain gradient descent, and the cut by trying every one near the quantile."""
    mean = [sum(c) / len(c) for c in zip(*x)]
    scale = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) + 1e-9 for c, m in zip(zip(*x), mean)]
    z = [[min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(r, mean, scale)] for r in x]
    good, bad = ([i for i, v in enumerate(y) if v == k] for k in (1, 0))
    rng = np.random.default_rng(7)
    pairs = list(zip(rng.choice(good, quality.PAIRS).tolist(), rng.choice(bad, quality.PAIRS).tolist()))
    d = np.array([[a - b for a, b in zip(z[i], z[j])] for i, j in pairs])
    w = np.zeros(d.shape[1])
    rate = 1 / (np.linalg.norm(d, 2) ** 2 / len(d) / 4 + 2 * quality.RIDGE)
    ahead = w
    for k in range(6000):  # accelerated descent
        slope = -(d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -500, 500))))) / len(d) + 2 * quality.RIDGE * ahead
        w, before = ahead - rate * slope, w
        ahead = w + k / (k + 3) * (w - before)
    return [sum(a * b for a, b in zip(r, w)) for r in z], w


def test_equals_plain_version(spark):
    """Features, weights and scores of a small table against plain ones."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    known = sorted((r.doc_id, r.text or "") for r in rows if labels.get(r.doc_id) in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), only=lambda i: ~quality.held_out(i))
    for r in rows[:40]:
        assert np.allclose(quality.features((r.text or "").encode()), plain_features((r.text or "").encode()))
    # the model draws its pairs from documents in the order of their ids' hashes
    key = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i, _ in known], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) & -2 AS k").collect()}
    known.sort(key=lambda r: key[r[0]] | labels[r[0]])
    s, w = plain_fit([plain_features(t.encode()) for _, t in known], [labels[i] for i, _ in known])
    assert np.allclose(model.weights, w, atol=2e-3)
    order = sorted(s)
    share, cut = sum(labels[i] == 0 for i, _ in known), model.threshold
    assert order[max(0, share - 2 - len(order) // 50)] - 0.05 <= cut <= order[min(len(order) - 1, share + 1 + len(order) // 50)] + 0.05
    got = {r.id: r.score for r in quality.score(docs, model).collect()}
    for (i, _), x in zip(known, s):
        assert abs(got[i] - 1 / (1 + math.exp(-model.sharpness * (x - cut)))) < 0.02


def test_learns_order_from_pairs():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 5))
    y = (x @ [2, -1, 0, 0.5, 0] > -1).astype(int)
    m = quality.bradley_terry(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.97


def test_one_label_and_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b"), (3, "x" * 300_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (7, 0), (2, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    kept = quality.accepted(docs, quality.fit(docs, labels))
    assert kept.count() == 5 and kept.columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0

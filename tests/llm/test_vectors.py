"""Nearest neighbours against brute force."""

import numpy as np

from leafpress.llm import vectors


def brute(qs, cs, k):
    out = []
    for i, q in qs:
        s = sorted(((float(vectors.cosine(np.array([q]), np.array([c]))[0]), -j) for j, c in cs if j != i), reverse=True)[:k]
        out += [(i, r + 1, -j, x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "CANDIDATES", 40)
    monkeypatch.setattr(vectors, "TILE", 16)
    base = rng.normal(size=(120, 24)).astype(np.float32).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # one very common vector
    rows += [(300 + i, [x * 2.0 for x in rows[i][1]]) for i in range(20)]  # ties by scale
    good = list(rows)
    rows += [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, [None] + [1.0] * 23), (404, [float("inf")] + [1.0] * 23), (405, []), (None, [1.0] * 24), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS block")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in vectors.search(df.filter("vec_id % 5 = 0"), df).collect())
    assert got == brute([x for x in good if x[0] % 5 == 0], good, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.id) for r in vectors.search(df, df).orderBy("query_id").collect()] == [(0, 1, 50), (50, 1, 0)]
    assert vectors.search(df.limit(0), df).count() == 0
    assert vectors.search(df, df.limit(0)).count() == 0


def test_strips_hot_ids_and_lengths(spark, monkeypatch):
    """Several strips and blocks by components; one id that most rows share; vectors of another length; near-equal vectors."""
    rng = np.random.default_rng(7)
    for name, value in {"QUERIES": 8, "CANDIDATES": 16, "TILE": 8, "STRIP": 2, "COMPONENTS": 100}.items():
        monkeypatch.setattr(vectors, name, value)
    near = rng.normal(size=12)
    good = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(60)]
    good += [(100 + i, [float(x) for x in near + rng.normal(size=12) * 1e-9]) for i in range(40)]  # within the bounds' error
    good += [(1000, [float(x) for x in near])]
    other = [(2000 + i, [float(x) for x in rng.normal(size=5)]) for i in range(9)]
    df = spark.createDataFrame(good + [good[-1]] * 300 + other, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in vectors.search(df.filter("vec_id % 4 = 0"), df, k=3).collect())
    ask = lambda x: [v for v in x if v[0] % 4 == 0]
    assert got == sorted(brute(ask(good), good, 3) + brute(ask(other), other, 3))

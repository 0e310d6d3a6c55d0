"""Exact dedup and mixing: odd inputs, and against plain versions."""

import hashlib
import random

import pytest

from leafpress.llm import common, exact_dedup, mixing


def plain_classes(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        g = min(groups[norm(t)])
        out.append((i, rows[g[3]][0], len(groups[norm(t)]), g[3] == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def copies(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "a b", "ab", "a\tb ", " ", "é😀 x", "x" * 200_000, "x" * 199_999 + "y"] + ["".join(rng.choices("ab \n", k=rng.randrange(5))) for _ in range(60)]
    rows = [(rng.choice([None, rng.randrange(40)]), t) for t in texts]
    return rows + rows[:12]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("digests", [True, False])
def test_exact_classes(spark, monkeypatch, broadcast, digests):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(common, "BROADCAST_TAGS", -1)
    rows = copies(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS len", "3 AS keep_id").coalesce(1)
    got = exact_dedup.classes(exact_dedup.tagged(df), all_digests=digests).collect()
    assert len(got) == len(rows)
    want = plain_classes(rows)
    cut = 5 if digests else 4
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest)[:cut] for r in got), key=key) == sorted((w[:cut] for w in want), key=key)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == sum(w[3] for w in want)


def test_exact_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.classes(exact_dedup.tagged(df)).count() == 0 and exact_dedup.deduplicate(df).count() == 0


def fill(sizes, cap=3):
    """Targets by resharing the excess, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        level = {s: cap * sizes[s] if s in full else weight[s] * rest / open_ for s in order}
        over = {s for s in order if s not in full and level[s] > cap * sizes[s]}
        if not over:
            return level
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "b", "a", "Z", "é", "😀", "￿", "hot"]
    rows = [(i, " w" * rng.choice([0, 1, 5, 50]) + rng.choice(["", " "]), "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(400)]
    rows += [(7, None, "nowords"), (None, "x y", "a"), (None, "x y", "a"), (3, "q r", "a"), (3, "q r", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS __x")
    out = mixing.mix(df).collect()
    assert sorted((str(r.id), r.size, str(r.source)) for r in out) == sorted((str(i), len((t or "").split()), str(s)) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken == r.size * r.copies and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 25
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, ((r.id, r.taken) for r in again))) == sorted(map(str, ((r.id, r.taken) for r in out)))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


def test_mix_weights(spark):
    rows = [(i, "w w w", "big") for i in range(3000)] + [(9000 + i, "w", "tiny") for i in range(2)] + [(8000 + i, "w w", "mid") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    out = mixing.mix(df, weight=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(F.when(F.col("doc_id") % 5 == 0, None).otherwise(1.0))).filter("source = 'big'").collect()
    rate = lambda f: sum(r.copies for r in out if f(r.id)) / sum(1 for r in out if f(r.id))
    assert rate(lambda i: i % 2 == 0) > 1.5 * rate(lambda i: i % 2 and i % 5) > 1.5 * rate(lambda i: i % 2 and i % 5 == 0)


@pytest.mark.parametrize("weight", [1.0, 0.05, 1e-12, None, "mixed"])
def test_no_step_is_large(spark, weight):
    """The rows of one step are sorted by one task, so they must be few whatever the weights are."""
    from pyspark.sql import functions as F

    w = F.expr("power(10D, cast(doc_id % 9 as int) - 8)") if weight == "mixed" else F.lit(weight).cast("double")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"))
    keyed = mixing._keyed(docs, "doc_id", "text", "source", w, "mix")
    assert keyed.groupBy("__step").count().agg(F.max("count")).first()[0] < 40
    again = [r[0] for r in keyed.orderBy("__key").select("__step").collect()]
    assert again == sorted(again)


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix(df).collect()] == [(0, 0, 0.0)] * 2


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\n", " ", "\x1c", "a\x0bb\x0cc\rd\te", None, "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(common.word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]

"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from leafpress.llm import common, simhash
from leafpress.llm.components import components


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, most=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    tables = simhash.golay_tables()
    p = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * 2 + 1
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, i % 3, replace=False):
            q[i] ^= np.uint64(1 << int(b))
    a, ai = simhash.golay_keys(p, tables)
    b, bi = simhash.golay_keys(q, tables)
    left = [set() for _ in p]
    for k, i in zip(a, ai):
        left[i].add(int(k))
    met = {int(i) for k, i in zip(b, bi) if int(k) in left[i]}
    assert met == set(range(len(p)))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("group", "most"), [(64, 2), (3, 2), (0, 2), (64, 1), (3, 1), (0, 1), (64, 0)])
def test_links_are_all_found_in_crowds(spark, monkeypatch, group, most):
    """group 3 sends keys on to the third segment, group 0 all pairs and more to the values between them."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(common, "BROADCAST_ROWS", group)  # both ways of joining
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(200):  # a crowd around one value
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    for _ in range(150):  # and a denser one, in few bits
        prints.add(~centre % (1 << 64) ^ sum(1 << b for b in rng.sample(range(0, 64, 7), rng.randrange(6))))
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = simhash.links(df, most)
    if most == 1:
        assert all((r.a ^ r.b).bit_count() == 1 for r in found.collect())
    roots = {r.node: r.root for r in components(found).collect()}
    want = plain_components(prints, most)
    got = [roots.get(signed(p), signed(p)) for p in prints]
    assert {tuple(i for i, x in enumerate(want) if x == w) for w in set(want)} == {tuple(i for i, x in enumerate(got) if x == w) for w in set(got)}


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(40)]
    texts = base + [b + " tail" for b in base[:20]] + base[:5] + [None, "", "  \t", "Word", "word", "one two", "x " * 50000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", __import__("pyspark").sql.functions.lit(1))
    got = {r.id: (r.print % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    for k, (i, _) in enumerate(rows):
        assert got[i] == (prints[k], min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[k]))
    kept = simhash.deduplicate(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})
    assert kept.columns == df.columns


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (None, "z")], "doc_id long, text string")
    assert sorted((r.id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]

"""Near-dedup of texts against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from leafpress.llm import common, near


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Ids that stay of (id, text) by all pairs."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a or b else 1) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def changed(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").select("doc_id").collect()) == plain_kept(rows)


def test_maps_never_hide_similar_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 3, 30, 400, 5000):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for drop in (0, 1, size // 20, size // 11, size // 9, size // 5):
            y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1), dtype=np.uint64)])
            if len(y):
                x_, y_ = np.unique(x), np.unique(y)
                rows.append(({"size": len(x_), "bits": {f"b{i}": int(v) for i, v in enumerate(near.bit_map(x_))}}, {"size": len(y_), "bits": {f"b{i}": int(v) for i, v in enumerate(near.bit_map(y_))}}, near.jaccard(x_, y_)))
    kind = "struct<size:long,bits:struct<" + ",".join(f"b{i}:long" for i in range(near.LONGS)) + ">>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}, j double").select(near._may("a", "b").alias("may"), "j").collect()
    assert all(r.may for r in got if r.j >= near.LEAST) and not all(r.may for r in got)


@pytest.mark.parametrize("rows", [200_000, -1])
def test_changed_words_and_crowds(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)  # both ways of joining
    monkeypatch.setattr(common, "BROADCAST_TAGS", rows)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(60)]
    texts += [changed(rng, t, s) for t in texts for s in (0.01, 0.03)]
    for size in (260, 40):  # groups beyond CROWD
        centre = " ".join(rng.choices(words, k=200))
        texts += [changed(rng, centre, 0.01) for _ in range(size)]
    base = rng.choices(words, k=120)
    for _ in range(150):  # a crowd in which many are unlike its centre
        gone = set(rng.sample(range(len(base)), rng.randrange(6)))
        texts.append(" ".join(w for i, w in enumerate(base) if i not in gone))
    texts += ["", " \t", None, "One two", "one  TWO", "one two three"]
    rows = [(i * 7 % 2003, t) for i, t in enumerate(texts)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = near.deduplicate(spark.read.parquet(path))
    assert got.columns == ["doc_id", "text"] and sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


@pytest.mark.parametrize("rows", [200_000, 120])
def test_pairs_below_the_limit_do_not_become_rows(spark, tmp_path, monkeypatch, rows):
    """A group of texts that are about 0.6 similar meets in most codewords; its pairs are left out by their maps before they
    are rows, also where only the maps of those that meet most others may be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rng, made, real = random.Random(8), {}, near.written
    words = [f"w{i}" for i in range(5000)]
    base = " ".join(rng.choices(words, k=300))
    texts = [changed(rng, base, 0.05) for _ in range(90)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(50, 300))) for _ in range(150)]
    texts += [changed(rng, t, 0.01) for t in texts[80:100]]

    def counted(df, label):
        made[label] = (out := real(df, label)).count()
        return out

    monkeypatch.setattr(near, "written", counted)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = sorted(r.doc_id for r in near.deduplicate(spark.read.parquet(path)).collect())
    assert got == plain_kept(list(enumerate(texts)))
    assert 20 <= made["near-met"] <= 120
    assert ("near-met-most" in made) == (rows == 120) and 90 <= made.get("near-met-most", 120) <= 120


def test_short_hashes_never_hide_similar_texts():
    rng = np.random.default_rng(6)
    for size, bits in ((4, 64), (300, 64), (5000, 64), (300, 18), (3000, 40)):  # few bits: many equal short hashes
        for drop in (0, 1, size // 12, size // 9, size // 5):
            x = rng.integers(0, 1 << 62, size, np.uint64) << np.uint64(64 - bits)
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 62, drop + 1, np.uint64)]))
            x = np.unique(x)
            likely = near.jaccard(*(np.unique(near.numbered(near.shortened(v))) for v in (x, y)))
            assert all(len(np.unique(near.numbered(near.shortened(v)))) == len(v) for v in (x, y))
            assert near.jaccard(x, y) <= likely <= (1 if bits < 64 else near.jaccard(x, y) + 0.15)


@pytest.mark.parametrize("rows", [200_000, 100, -1])
def test_groups_cost_their_number(spark, tmp_path, monkeypatch, rows):
    """Texts of a group that are similar to each other are compared about once each, not by pairs, and how many a text meets
    is counted without a row for each of its cells."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rng, compared, plans, real, write = random.Random(9), [], {}, near._similar, near.written
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(2):
        base = " ".join(rng.choices(words, k=300))
        texts += [changed(rng, base, 0.01) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=200)) for _ in range(40)]

    def similar(pairs, sets, short=False):
        compared.append(0 if short else pairs.count())
        return real(pairs, sets, short) if short else real(pairs, sets)

    def planned(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(near, "_similar", similar)
    monkeypatch.setattr(near, "written", planned)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = sorted(r.doc_id for r in near.deduplicate(spark.read.parquet(path)).collect())
    assert got == plain_kept(list(enumerate(texts))) and len(got) == 42
    assert 118 <= sum(compared) <= 240
    assert ("near-meetings" in plans) == (rows < 160) and not any(x in plans.get("near-meetings", "") for x in ("Join", "Generate"))


def test_empty_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (6, "a b c d")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    assert near.deduplicate(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near.deduplicate(docs).collect()) == [0, 0, 5]


def test_golay_words_propose(spark, tmp_path):
    """Keys are the nearest codewords of the SimHash's segments, and propose what is similar."""
    generator, codewords = 0b101011100011, [0]
    for i in range(12):  # of the Golay code, by its generator
        codewords += [c ^ generator << i for c in codewords]
    codewords, rng = np.array(sorted(codewords)), np.random.default_rng(4)
    for size in (4, 7, 10, 30, 300):
        for _ in range(20):
            union = rng.integers(0, 1 << 64, size + size // 8 + 1, np.uint64)
            x, y = np.unique(union[:size]), np.unique(union[size // 8 + (size > 4) :])
            bits = near.fingerprint(x)
            if size % 2:  # no ties: just over half
                mixed = (x[:, None] ^ near.XORS) * near.ODDS
                mixed = (mixed ^ mixed >> np.uint64(32)) * near.MORE
                mixed = mixed ^ mixed >> np.uint64(32)
                assert all(bits[w * 64 + b] == ((mixed[:, w] >> np.uint64(b) & np.uint64(1)).sum() * 2 > size) for w in (0, 9) for b in range(64))
            words = near.golay_words(bits)
            for i in (0, 1, 41, near.SEGMENTS - 1):
                segment = sum(int(bits[23 * i + j]) << j for j in range(23))
                nearest = codewords[np.bitwise_count(codewords ^ segment).argmin()]
                assert words[i] == (i << 12 | nearest >> 11)
            if near.jaccard(x, y) >= near.LEAST:
                other = near.fingerprint(y)
                assert (near.golay_words(other) == words).any() and (other[:128] != bits[:128]).sum() <= near.FAR
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string").write.parquet(path)
    got = {r.id: r for r in near.sketches(common.tagged(spark.read.parquet(path))).collect()}
    assert got[1]["keys"] == near.golay_words(near.fingerprint(near.shingles(b"a b c d e f g h"))).tolist()
    assert got[2]["keys"] == got[3]["keys"] == []

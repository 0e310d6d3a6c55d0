"""Substring deduplication against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from leafpress.llm import common, exact_dedup, mixing, substrings


def brute(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, 1 << 63), i if i is not None else (1 << 63) - 1)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < (i if i is not None else (1 << 63) - 1):
                gone.update(range(s, s + 50))
        out.append((i if i is not None else -1, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(500)
    passage = [[word() for _ in range(rng.choice([49, 50, 51, 74, 75, 76, 120, 200]))] for _ in range(12)]
    docs = []
    for _ in range(70):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [word() for _ in range(rng.randrange(0, 60))]
            if rng.random() < 0.7:
                p = list(rng.choice(passage))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed%d" % rng.randrange(3)
                w += p[rng.randrange(3) :]
        docs.append(w)
    docs += [list(d) for d in docs[:15]]
    for d in docs[20:35]:  # near copies
        d = list(d)
        d[rng.randrange(len(d))] = "x"
        docs.append(d)
    docs += [["same"] * n for n in (49, 50, 60, 300)] + [["a", "b"] * 100, ["b", "a"] * 60]
    ids = rng.sample(range(10_000), len(docs))
    out = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n\t"]).join(d)) for i, d in zip(ids, docs)]
    return out + [out[3], (out[4][0], out[5][1]), (None, out[6][1]), (None, out[6][1]), (5, None), (7, ""), (8, " ")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "HELD", 500)
    if seed == 2:
        monkeypatch.setattr(substrings, "CHUNK", 300)
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS id", "3 AS ats")
    got = sorted((r.id if r.id is not None else -1, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(df).collect())
    assert got == brute(data)


def test_pack():
    rng = np.random.default_rng(1)
    row = np.sort(rng.integers(0, 9, 400))
    at = np.concatenate([np.sort(rng.integers(0, 1_000_000, (row == r).sum())) for r in range(9)])
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    tags = np.array([(7 * r, r) for r in row.tolist()], substrings.ROW_KIND)
    a, b, c, d = substrings.unpack(substrings.pack(tags, row * 5, at, h))
    assert (a == tags).all() and (b == row * 5).all() and (c == at).all() and (d == h & np.uint64((1 << 48) - 1)).all()


def test_probes_and_windows_are_made_in_small_pieces(spark, monkeypatch):
    """No more than about PIECE words are hashed at once, so a task's memory doesn't grow with CHUNK; the result is the same."""
    rng, most, real = random.Random(6), [], substrings.Hashed.__init__
    texts = [" ".join("w%d" % rng.randrange(90) for _ in range(rng.randrange(40, 400))) for _ in range(300)]
    texts += [" ".join(t.split()[20:]) for t in texts[:100]]
    data = list(enumerate(texts))

    def counted(self, texts, *more):
        real(self, texts, *more)
        most.append(int(self.begin[-1]))

    monkeypatch.setattr(substrings.Hashed, "__init__", counted)
    monkeypatch.setattr(substrings, "PIECE", 1000)
    batch = pa.RecordBatch.from_arrays([substrings.tags_of(np.zeros(400, substrings.ROW_KIND)), pa.array(range(400), pa.int64()), pa.array([t.encode() for t in texts]), pa.array([list(range(0, len(t.split()) - 49, 25)) for t in texts], pa.list_(pa.int32()))], ["row", "id", "text", "ats"])

    class Plan:
        def mapInArrow(self, run, schema):
            return sum(b.num_rows for b in run(iter([batch])))

    assert substrings.probes(Plan(), 64) and substrings.contexts(Plan()) and substrings.windows(Plan())
    assert max(most) < 2000 < 60_000 < sum(most) / 3
    monkeypatch.undo()
    got = sorted((r.id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute(data)


def test_same_result_if_later_scans_are_split_otherwise(spark, monkeypatch, tmp_path):
    """As when the cluster's core count changes between two scans."""
    data = rows(4)
    path = str(tmp_path / "docs")
    for part in (data[::2], data[1::2]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").option("parquet.block.size", 4096).parquet(path)
    real, n = common.written, iter(range(10**6))

    def written(df, label):
        out = real(df, label)
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["1g", "700"][next(n) % 2])
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return out

    for m in (substrings, exact_dedup, mixing):
        monkeypatch.setattr(m, "written", written)
    try:
        docs = spark.read.parquet(path)
        got = sorted((r.id if r.id is not None else -1, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(docs).collect())
        assert got == brute(data)
        assert exact_dedup.deduplicate(docs).count() == len({"".join((t or "").split()) for _, t in data})
        docs = docs.withColumn("source", (docs.doc_id % 2).cast("string"))
        assert mixing.mixed(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(df).count() == 0

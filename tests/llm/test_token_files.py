"""Token files: exact round trips, and ids equal to those of encoding whole texts."""

import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leafpress.llm import token_files as tf

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 9, 1023, 1024):
        for top in (1, 2, 300, 49_408, 1 << 32):
            x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert (tf.unpack_block(b"zz" + tf.pack_block(x), 2) == x).all()
    x = np.full(1000, 7, np.uint32)
    x[5] = 4_000_000_000
    assert len(tf.pack_block(x)) < 40 and (tf.unpack_block(tf.pack_block(x)) == x).all()


def test_file_index():
    rng = np.random.default_rng(1)
    docs = [(None if i == 0 else i, rng.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([3, 0, 5000, 1, 1024, 2047])]
    every = np.concatenate([x for _, x in docs])
    f = tf.TokenFile(tf.pack(np.array([[tf.NULL_ID if i is None else i, len(x)] for i, x in docs]), every))
    for a, b in ((0, 0), (0, 3), (1000, 1100), (1024, 2048), (5000, len(every))):
        assert (f.ids(a, b) == every[a:b]).all()
    assert f.documents()[:, 1].tolist() == [len(x) for _, x in docs]
    assert tf.TokenFile(tf.pack(np.zeros((0, 2), np.int64), np.zeros(0, np.uint32))).ids(0, 0).size == 0


def texts():
    rng = random.Random(9)
    bits = ["don't", "IT'S", "Été", "é", "Σ", "ΣΑΣ", "İ", "ß", "中文", "12", ".", "!!", "<|startoftext|>", "<|endoftext|>", "a<|endoftext|>b", " ", "  ", "\n", "\x0b", "\x1c", "\x85", " ", "　", "́", "x", "'s", "'", "\x00"]
    return [None, "", " ", "word " * 40_000] + ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(1500)]


@pytest.mark.parametrize("most", [300_000, 40])
def test_words_equal_whole_texts(most):
    t, w = Tokenizer.from_file(PATH), tf.Words(PATH)
    w.pool.most = most
    assert w.by_words
    every = [x or "" for x in texts()]
    for at in range(0, len(every), 100):
        ids, n = w.encode(pa.array(every[at : at + 100]))
        ends = np.cumsum(n)
        for x, a, b in zip(every[at : at + 100], ends - n, ends):
            assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)


def test_other_files_encode_whole_texts(tmp_path):
    """A file whose normalizer or pre-tokenizer is another is never cut into words."""
    other = json.loads(Tokenizer.from_file(PATH).to_str())
    other["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(other, f)
    for path in (path, P.path("byte_bpe_50k.json")):
        t, w = Tokenizer.from_file(path), tf.Words(path, 7)
        assert not w.by_words
        ids, n = w.encode(pa.array(["a  b", "", "Don't  stop é"]))
        assert ids.tolist() == sum(([*t.encode(x, add_special_tokens=False).ids, 7] for x in ("a  b", "", "Don't  stop é")), [])
        assert n.sum() == len(ids)


def test_round_trip_rows(spark, monkeypatch):
    monkeypatch.setattr(tf, "PARTS", 2)
    t = Tokenizer.from_file(PATH)
    rows = [((i * 37) % 1511, x) for i, x in enumerate(texts()[:300])] + [(None, "null id"), (5000, "again"), (5000, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS part")
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in tf.round_trip(df, PATH).collect())
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tf.round_trip(df.limit(0), PATH).count() == 0

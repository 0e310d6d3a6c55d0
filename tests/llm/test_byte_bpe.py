"""Byte-level BPE against tiktoken."""

import base64
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken

from leafpress.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(4)
    bits = ["'s", "'re", "'ll", "'", "''", "t", "re", "ab", "Z", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "...", "é", "ß", "中", "😀", " ", " ", "٣", "²", "́", "\x00", "\x1c", "don't", "I'VE", "<|endoftext|>"]
    yield from ["", " ", "\n", "'s", "a 's", "it's", "!'s", " 're", "x" * 1000, "ab" * 700 + "c", "\x00", "a\x00", " \x00 "]
    for _ in range(1500):
        yield "".join(rng.choices(bits, k=rng.randrange(1, 30)))


def test_pieces_equal_the_pattern():
    texts = list(samples())
    want = [[m.encode() for m in regex.findall(P.PATTERN, t)] for t in texts]
    assert byte_bpe.pieces(texts) == want


def test_pieces_across_scans(monkeypatch):
    texts = list(samples())
    want = byte_bpe.pieces(texts)
    for n in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(byte_bpe, "SCAN", n)
        some = texts if n > 50 else texts[:150]
        assert byte_bpe.pieces(some) == want[: len(some)]


def test_ids_equal_tiktoken(enc):
    texts = list(samples())
    c = byte_bpe.Codec(PATH)
    got = c.encode(texts)
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert [c.decode(x, c.offsets(x)).decode() for x in got] == texts
    for x in got:  # a run of tokens by its offsets
        o, half = c.offsets(x), len(x) // 2
        assert c.decode(x[half:], o[half:]) == b"".join(map(enc.decode_single_token_bytes, x[half:]))


def test_classes_equal_tiktoken():
    """By an encoding whose merges show whether two characters are in one piece."""
    single = {bytes([b]): b for b in range(256)}
    kinds = byte_bpe.classes()
    for kind, first in ((byte_bpe.LETTER, b"a"), (byte_bpe.NUMBER, b"1")):
        ranks = single | {first + bytes([b]): 256 + i for i, b in enumerate(range(0x80, 0x100))}
        e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        bad = [c for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000)) if (e.encode_ordinary(first.decode() + chr(c))[0] >= 256) != (kinds[c] == kind)]
        assert not bad, (kind, len(bad), [hex(c) for c in bad[:20]])


def test_encode_and_decode_rows(spark, enc):
    rows = [(1, None), (2, ""), (3, "it's so  good\n"), (3, "it's so  good\n"), (None, "x"), (4, "long " * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    out = byte_bpe.encode(df, PATH)
    got = sorted(((r.id or -1, r.n_tokens, r.ids) for r in out.collect()), key=str)
    want = sorted(((i or -1, len(x), x) for i, t in rows for x in [enc.encode_ordinary(t or "")]), key=str)
    assert got == want
    assert [o for r in out.collect() if r.id == 3 for o in r.offsets][:4] == [0, 2, 4, 7]
    assert sorted((r.id or -1, r.text) for r in byte_bpe.decode(out, PATH).collect()) == sorted((i or -1, t or "") for i, t in rows)
    import hashlib

    assert {r.decoded_sha256 for r in out.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert byte_bpe.encode(df.limit(0), PATH).count() == 0

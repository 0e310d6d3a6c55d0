"""Context-tree weighting and unigram scores against plain recursive versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from leafpress.llm import lm


def kt(a, b):
    g = math.lgamma
    return g(a + 0.5) + g(b + 0.5) - g(a + b + 1) - math.log(math.pi)


class Plain:
    """Counts in a dictionary by (bits so far, context of any depth, newest byte first)."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for prefix, bit, context in self.steps(t):
                for d in range(lm.DEPTH + 1):
                    self.n[prefix, context[:d]][bit] += 1
                    if d:
                        self.children[prefix, context[: d - 1]].add(context[:d])
        self.memo = {}

    @staticmethod
    def steps(t):
        past = b"\0" * lm.DEPTH + t
        for i, x in enumerate(t):
            context = past[i : i + lm.DEPTH][::-1]
            for k in range(8):
                yield (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1, context

    def pw(self, prefix, context):
        key = prefix, context
        if key not in self.n:
            return 0.0
        if key not in self.memo:
            own = kt(*self.n[key])
            if len(context) < lm.DEPTH:
                own = math.log(0.5) + np.logaddexp(own, self.below(prefix, context))
            self.memo[key] = own
        return self.memo[key]

    def below(self, prefix, context):
        return sum(self.pw(prefix, c) for c in self.children[prefix, context])

    def one(self, prefix, context, d):
        a, b = self.n.get((prefix, context[:d]), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == lm.DEPTH:
            return own
        r = math.exp((kt(a, b) if a + b else 0.0) - (self.below(prefix, context[:d]) if a + b else 0.0))
        return (r * own + self.one(prefix, context, d + 1)) / (r + 1)

    def log10(self, t):
        return sum(math.log10(p if bit else 1 - p) for prefix, bit, c in self.steps(t) for p in [self.one(prefix, c, 0)])


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 3.25, 7.9, 8, 100.5, 1e6])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-9)


def test_scores_equal_plain_versions(spark, monkeypatch):
    rng = random.Random(11)
    words = ["the", "The", "cat", "Dog", "été", "a", "x" * 80, "b\x0bc", "z9"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(40)] + [None, "", "  ", "unseen q", "\x00\x00\x00\x00\x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n", "3 AS score")
    learn = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    tokens = [[w for w in (t or "").encode().lower().split()] for _, t in rows]
    count = Counter(w for x, k in zip(tokens, learn) if k for w in [*x, "end"])
    total, kinds = sum(count.values()), len(count)
    plain = Plain([(t or "").encode() for (_, t), k in zip(rows, learn) if k])
    want = []
    for (i, t), x, k in zip(rows, tokens, learn):
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in [*x, "end"])
        want.append((i if i is not None else -1, not k, len(x) + 1, sum(count[w] > 0 for w in [*x, "end"]), total, round(base, 6), round(plain.log10((t or "").encode()), 6)))
    for hot in (1 << 18, 3, 0):  # all broadcast, some joined, all joined
        monkeypatch.setattr(lm, "HOT_WORDS", hot)
        monkeypatch.setattr(lm, "HOT_GRAMS", 20 * hot)
        got = lm.score(df, lm.learns).collect()
        got = [(r.id if r.id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0, round(r.score, 6) + 0.0) for r in got]
        assert sorted(got) == sorted(want)


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in lm.score(df, lambda i: F.lit(False)).collect()}
    assert abs(got[1].score - 16 * math.log10(0.5)) < 1e-9 and got[2].score == 0 and got[1].n_known == 0 and got[1].bits_per_byte == 8
    assert lm.score(df.limit(0), lm.learns).count() == 0

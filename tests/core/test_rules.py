"""Ordered rules, similarity bounds and smoothed rates against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafpress.functions import lines as L
from leafpress.functions import text as T
from leafpress.operators import progress


def plain_correct(text, rules):
    """Occurrences from left to right; a short source needs boundaries or the text's ends at both sides."""
    n = 0
    for source, target in rules:
        core = source.replace("\n", "").strip()
        everywhere = len(core) > 3 or (core and all("一" <= c <= "鿿" for c in core))
        out, at = "", 0
        while (hit := text.find(source, at)) >= 0:
            before, after = text[hit - 1 : hit], text[hit + len(source) : hit + len(source) + 1]
            free = everywhere or ((hit == 0 or before in T.BOUNDARIES) and (after == "" or after in T.BOUNDARIES))
            out, n, at = out + text[at:hit] + (target if free else source), n + free, hit + len(source)
        text = out + text[at:]
    return text, n


@pytest.mark.parametrize("rules", [[("1.1", "Z")], [("a", "b"), ("b", "c")], [("..", "x")], [(".", "-.")], [("a a", "$1\\")], [("ab", "")], list(T.CLASSICAL_SAFE + T.CLASSICAL_AGGRESSIVE)])
def test_guarded_rules(spark, rules):
    rng = random.Random(3)
    texts = ["x1.1.1", "1.1", "1.1.1.1", "", "a a a a"] + ["".join(rng.choices(["a", "b", ".", "1", " ", "\n", "x", "ab", "1.1"], k=rng.randrange(12))) for _ in range(300)]
    texts += [s + t for s, _ in T.CLASSICAL_SAFE for t in ("", "x")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.correct(F.col("t"), rules).alias("x")).collect()
    assert [(r.x.text, r.x["count"]) for r in got] == [plain_correct(t, rules) for t in texts]


def test_bounds_never_change_similarity():
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcde가나다라 中文字1.", k=rng.randrange(0, 30))) for _ in range(200)]
    pool += [p[:i] + rng.choice("abz가") + p[i + 1 :] for p in pool for i in [len(p) // 2]]
    for _ in range(6000):
        a, b = L.Line(rng.choice(pool)), L.Line(rng.choice(pool))
        for of in ("text", "key"):
            x, y = getattr(a, of), getattr(b, of)
            assert L.alike(a, b, of, 0.8) == (SequenceMatcher(None, x, y).ratio() >= 0.8)


def test_patterns_equal_the_classes():
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x30000))):
        assert (L.NO_ALNUM.sub("", c) != "") == (L.is_cjk(c) or c.isalnum()), hex(ord(c))
        assert bool(L.CJK.match(c)) == L.is_cjk(c) and bool(L.LATIN.match(c)) == L.is_latin(c), hex(ord(c))
        assert L.visible(c) == (not c.isspace())
    assert not any(c.isalnum() and c.isspace() for c in map(chr, range(0x30000)))


def test_one_pass_equals_two():
    rng = random.Random(6)
    for _ in range(300):
        texts = ["".join(rng.choices("ab", k=8)) + rng.choice(["", " tail of the line", " other end"]) for _ in range(rng.randrange(1, 90))]
        rows = list(map(L.Line, texts))
        seen = L.Seen()
        assert L.kept_and_repeats(rows) == (L.clean(texts), sum(not seen.add(x) for x in rows if not x.noise))


def test_smoothed_rates(spark):
    rng = random.Random(7)
    events = [(k, float(i) / 4, None if rng.random() < 0.1 else float(rng.randrange(40))) for k in range(3) for i in range(60)] + [(1, 3.0, 50.0), (1, 3.0, 60.0)]
    df = spark.createDataFrame(events, "k int, seconds double, counter double")
    want = []
    for k in range(3):
        at = most = rate = None
        for _, s, c in sorted((e for e in events if e[0] == k), key=lambda e: (e[1], e[2] is not None, e[2] or 0)):
            if most is None:
                at, most = s, c
            elif c is not None and c > most:
                if s - at >= progress.LEAST_SECONDS:
                    x = (c - most) / (s - at)
                    rate = x if rate is None else progress.ALPHA * x + (1 - progress.ALPHA) * rate
                at, most = s, c
            want.append((k, s, c, rate))
    got = [(r.k, r.seconds, r.counter, r.rate) for r in progress.ewma(df, ["k"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_json_lines_are_ascii(spark):
    assert spark.range(1).select(progress.event_line(F.lit(3), F.lit("é夢\"\\"), True)).first()[0] == '{"percent":3,"stage":"\\u00e9\\u5922\\"\\\\"}'

"""Personal data against the plain patterns."""

import random
import re

from leafpress.llm import pii


def plain(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) for d in [re.sub("[^0-9]", "", m[0])] if 13 <= len(d) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@@", "x-y", ".", "..", "1", "22", "255", "256", "0", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "+1 (555) 123-4567", "(", ")", "é", "😀", "me@ex.org", "10.0.0.1", "%", "\n", "IBAN", "tel"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        got = [(s.kind, s.start, s.end) for s in pii.spans(t) if s.kind in pii.BASE]
        assert got == plain(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 400_000 + "!@", "1" * 300_000, "1 " * 300_000 + ".", "+1" * 200_000, "a@" * 200_000, "1." * 200_000):
        pii.spans(t)
    for n in (5_000, 500_000):  # runs of digits longer than int() takes
        for t, ips in (("0" * n + ".1.1.1", 1), ("1" * n + ".1.1.1", 0), ("1.1.1." + "0" * n, 1), ("0" * n + "255.1.1.1", 1), ("1." * n + "1.1.1", (n + 3) // 4), ("GB82" + "1" * n, 0)):
            assert sum(s.kind == "ip" for s in pii.spans(t)) == ips, (t[:12], n)


def test_added_spans():
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.spans(t)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("Account GB82 WEST 1234 5698 7654 32.")
    assert not [k for k, _ in kinds("GB83WEST12345698765432") if k == "iban"]
    assert kinds("SSN 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789") == []
    assert kinds("call (555) 123-4567 now") == [("local_phone", "(555) 123-4567")]
    assert pii.spans(None) == pii.spans("") == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd"), (None, None), (1, "mail a@b.cd")], "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = sorted((r.id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find(df).collect())
    assert got == [(0, []), (1, [("email", 5, 11)]), (1, [("email", 5, 11)])]
    assert pii.find(df.limit(0)).count() == 0

"""Quality classifier by Bradley-Terry pairwise ranking: a document's score is learned from preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import crc_mod

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: At most so many labelled documents of each label are read to fit the model; the smallest by a hash of the id.
MOST_LABELS = 10_000
#: Preference pairs drawn from them (seeded), and the weight of the squared weights in the loss.
PAIRS, RIDGE = 20_000, 1e-3
WINDOW = 50


def features(text: bytes) -> np.ndarray:
    """Features of a whole text (UTF-8): shares of characters, and of words, lines and windows of words. No metadata."""
    n = max(1, len(text))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    words = text.split()
    m = max(1, len(words))
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    chars = [upper / n, lower / n, digit / n, hist[32] / n, hist[10] / n, hist[128:].sum() / n, hist[:9].sum() / n]
    marks = hist[[ord(c) for c in PUNCTUATION]] / m
    size = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    once = len(set(words))
    lines = [x for x in text.split(b"\n") if x]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    # the worst window: junk may fill only a part of a text
    shares = [len(set(words[i : i + WINDOW])) / len(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [1.0]
    caps = np.fromiter((w.isupper() and len(w) > 1 for w in words), float, len(words)).mean() if words else 0.0
    odd = np.fromiter((not w[-1:].isalnum() and w[-1] < 128 for w in words), float, len(words)).mean() if words else 0.0
    more = [np.log1p(len(words)), np.log1p(n), once / m, once / np.sqrt(m), same / m, size.mean() / 10, size.std() / 10, size.max(initial=0) / 100,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), min(shares), float(np.mean(shares)), caps, odd, marks.sum(), float((hist > 0).sum()) / 100]
    x = np.array([*chars, *marks, *more])
    return np.concatenate([x, np.sqrt(np.abs(x[: len(chars) + len(PUNCTUATION)]))])


@dataclass(frozen=True)
class Model:
    """score = logistic(sharpness * (weights . standardised features - threshold)); rate: the score where nothing was learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    sharpness: float
    rate: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.sharpness * (self.raw(x) - self.threshold), -500, 500)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Learns from pairs (document of label 1, document of label 0) by the logistic loss on feature differences (Newton's
    method), then cuts the scores at the quantile that is label 0's share. With one label only, every score is its rate."""
    mean, scale = x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-9 if len(x) else np.ones(x.shape[1])
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    blank = Model(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0, 0.5 if not len(x) else float(len(good) > 0))
    if not len(good) or not len(bad):
        return blank
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ w)).mean() + ridge * (w @ w))

    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(d.T @ p) / pairs + 2 * ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + 2 * ridge * np.eye(len(w))
        step, t = np.linalg.solve(curve, gradient), 1.0
        while loss(w - t * step) > loss(w) and t > 1e-4:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    s = z @ w
    # cuts within 2 % of the quantile at label 0's share; of those with the fewest errors (each label weighing the same), the middle one
    order = np.sort(s)
    k = len(bad)
    near = slice(max(0, k - 1 - len(order) // 50), k + 1 + len(order) // 50)
    cuts = (order[near][:-1] + order[near][1:]) / 2 if len(order[near]) > 1 else np.array([order[k - 1]])
    wrong = [np.mean(s[good] < c) + np.mean(s[bad] >= c) for c in cuts]
    least = [c for c, v in zip(cuts, wrong, strict=True) if v <= min(wrong) + 1e-12]
    cut = float(least[len(least) // 2])
    spread = np.median(np.abs(s - cut)) + 1e-9
    return Model(mean, scale, w, cut, float(3 / spread))


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): features of each row of docs; a null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return rows.mapInArrow(run, "id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS, only=None) -> Model:
    """The model of at most `most` labelled documents of each label (0 or 1; other labels and null ids are left out).

    only: a condition on the id, to hold documents out. Of an id with several labels the least counts; repeated documents
    count once each. The ids, at most twice `most`, are broadcast, so no texts are shuffled; their features are
    collected (under 1 KB each).
    """
    of = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("label_id").isNotNull() & F.col("y").isin(0, 1))
    if only is not None:
        of = of.filter(only(F.col("label_id")))
    of = of.groupBy("label_id").agg(F.min("y").alias("y"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = [of.filter(F.col("y") == v).orderBy(*order).limit(most) for v in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("label_id"))
    # the hash, for an order that is the same in every run; its lowest bit is the label
    keys = texts.select(F.xxhash64("label_id").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("y").cast("long")).alias("key"), "text")
    rows = measure(keys, "key", "text").orderBy("id").collect()
    size = len(features(b""))
    return bradley_terry(np.array([r.x for r in rows]).reshape(-1, size), np.array([r.id & 1 for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of docs: 0 to 1, 0.5 and more means label 1. Empty and null texts are scored like others."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(x) if len(x) else [], pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least 0.5, with all their columns. One pass, no shuffle."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(text_col)]
            if x:
                yield b.filter(pa.array(model.score(np.array(x)) >= 0.5))

    return docs.mapInArrow(run, schema)


def held_out(ids):
    """crc32 of the id as text, modulo 3, is 1 (null ids: false)."""
    return F.coalesce(crc_mod(ids, 3) == 1, F.lit(False))

"""Language-model scoring: context-tree weighting over bytes, beside add-one unigram scores of words.

Each byte is eight binary decisions. For each of the 255 prefixes of a byte's bits there is a context tree over the
bytes before it, the newest first, to DEPTH. A node holds how often a 0 and a 1 followed in the training texts. Its
Krichevsky-Trofimov estimate Pe and the product of its children's Pw are mixed half and half into its Pw; the ratio of
the two is the weight with which a prediction mixes the node's own estimate with that of the deeper context. So every
depth takes part in every prediction, and a context that was never seen predicts 1/2 and changes nothing above it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import crc_mod, written

DEPTH = 4
#: Bytes of text that a task counts together; counted entries that it holds at most before it sends them on.
CHUNK, HELD = 4_000_000, 1_000_000
#: Entries of the two tables that are broadcast: the most frequent ones, at most so many. All others are joined.
HOT_WORDS, HOT_WORD_BYTES, HOT_GRAMS = 1 << 18, 64, 1 << 20
LN2 = np.log(2.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series above 8, the recurrence below."""
    x = x.astype(float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def grams(texts: list[bytes]) -> np.ndarray:
    """The gram of every byte, text after text: the DEPTH (4) bytes before it, the newest highest, then the byte; zeros stand before a text."""
    data = np.frombuffer(b"".join(b"\0" * DEPTH + t for t in texts) or b"\0" * DEPTH, np.uint8)
    wide = data.astype(np.uint32)
    low = wide[4:] | wide[:-4] << np.uint32(8) | wide[1:-3] << np.uint32(16) | wide[2:-2] << np.uint32(24)
    gram = low.astype(np.int64)
    gram |= data[3:-1].astype(np.int64) << 32
    size = np.array([len(t) for t in texts], np.int64)
    keep = np.ones(len(gram), bool)
    gaps = np.cumsum(size + DEPTH)[:-1] - DEPTH  # where the zeros before each later text are
    for j in range(DEPTH):
        keep[gaps + j] = False
    return gram[keep]


class Level:
    """Nodes of one depth: their key, counts and ln Pw, and where each finer node belongs."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        self.keys, self.inverse = np.unique(keys, return_inverse=True)
        add = lambda v: np.bincount(self.inverse, v, len(self.keys))
        self.zeros, self.ones = add(zeros), add(ones)
        self.kt = log_kt(self.zeros, self.ones)
        # leaves have no children: Pw is Pe
        self.below = self.kt if below is None else add(below)
        self.pw = self.kt if below is None else np.logaddexp(self.kt, self.below) - LN2 * (self.zeros + self.ones > 0)
        # a node without counts has Pe = Pw = 1; the half and half mixture of 1 and 1 is 1
        self.pw = np.where(self.zeros + self.ones > 0, self.pw, 0.0)


def blend(kt_one: np.ndarray, log_ratio: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """A node's own estimate and the deeper one, weighted Pe to the product of the children's Pw."""
    weight = 1 / (1 + np.exp(-np.clip(log_ratio, -700, 700)))
    return weight * kt_one + (1 - weight) * deeper


def subtree(gram: np.ndarray, n: np.ndarray, bit: int, top: int) -> list[Level]:
    """Levels DEPTH to top for one bit of the byte."""
    byte = gram & 0xFF
    prefix = (1 << bit) | (byte >> (8 - bit))
    one = (byte >> (7 - bit)) & 1
    levels = [Level((gram >> 8 << 8) | prefix, n * (1 - one), n * one)]
    for d in range(DEPTH - 1, top - 1, -1):
        last = levels[-1]
        cut = 8 * (DEPTH - d)  # contexts of depth d are the d newest bytes
        levels.append(Level((last.keys >> (8 + cut) << (8 + cut)) | (last.keys & 0xFF), last.zeros, last.ones, last.pw))
    return levels


def by_shard(batches: Iterator[pa.RecordBatch], least: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, training count, all) of whole shards (the two newest context bytes), from batches sorted by gram."""
    held: list[np.ndarray] = []
    for b in batches:
        x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n", "every")]) if b.num_rows else np.zeros((3, 0), np.int64)
        held.append(x)
        if sum(h.shape[1] for h in held) >= least:
            x = np.concatenate(held, 1)
            shard = x[0] >> (8 * (DEPTH - 1))
            at = int(np.searchsorted(shard, shard[-1]))
            if at:
                yield tuple(x[:, :at])
            held = [x[:, at:]]
    if held and (x := np.concatenate(held, 1)).shape[1]:
        yield tuple(x)


def counted(docs: DataFrame, train) -> DataFrame:
    """(word, gram, n, every): partial counts, by task. Words (gram is null) of training texts only; grams of all texts,
    n of them in training texts. docs: row, id, text (binary)."""
    rows = docs.select("text", train.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send_words() -> pa.RecordBatch:
            k = pa.array(list(words), pa.binary())
            n = pa.array(list(words.values()), pa.int64())
            words.clear()
            return pa.RecordBatch.from_arrays([k, pa.nulls(len(k), pa.int64()), n, n], ["word", "gram", "n", "every"])

        def send_grams() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n, every = (np.bincount(inverse, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n), pa.array(every)], ["word", "gram", "n", "every"])

        for b in batches:
            texts, train = b.column("text").to_pylist(), b.column("train").to_pylist()
            for part in chunks(texts):
                for i in part:
                    if train[i]:
                        words.update(lowered(texts[i]))
                for learn in (True, False):
                    place, keys = pd.factorize(grams([texts[i] for i in part if train[i] == learn]))
                    every = np.bincount(place, minlength=len(keys))
                    held.append((keys, every if learn else np.zeros_like(every), every))
                if len(words) >= HELD:
                    yield send_words()
                if sum(len(h[0]) for h in held) >= HELD:
                    yield send_grams()
        if words:
            yield send_words()
        if held:
            yield send_grams()

    return rows.mapInArrow(run, "word binary, gram long, n long, every long")


def lowered(text: bytes) -> list[bytes]:
    return text.lower().split()


def chunks(texts: list[bytes]) -> Iterator[range]:
    """Ranges of texts of about CHUNK bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield range(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of table (written; with a count every) that occur often: the largest set of at most `most` rows that a
    bound on the count gives. The bound comes from a histogram of the counts' logarithms, of a few hundred rows."""
    step = F.floor(F.log2("every") * 8).cast("int")
    hist = sorted(((r[0], r[1]) for r in table.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in hist:
        total += n
        if total > most:
            break
        least = s
    return table.filter(F.lit(False) if least is None else step >= least)


def tree_tops(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For depths 0 and 1: the estimate of a 1 and ln of Pe over the children's Pw, by (bits so far) and (newest byte, bits so far).

    The nodes of depth 2 come from sorted shards; depth 1 and 0 have at most 256 * 255 and 255 nodes, whatever the input.
    """
    sharded = table.repartition(F.shiftright("gram", 8 * (DEPTH - 1))).sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, _ in by_shard(batches):
            for bit in range(8):
                x = subtree(gram, n, bit, 2)[-1]
                node = (x.keys >> (8 * DEPTH) << 8) | (x.keys & 0xFF)
                sums = [np.bincount(inv, v, len(keys)) for keys, inv in [np.unique(node, return_inverse=True)] for v in (x.zeros, x.ones, x.pw)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(node)), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])

    nodes = sharded.mapInArrow(run, "node long, zeros double, ones double, below double")
    got = nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect()
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for r in got:
        zeros[r.node >> 8, r.node & 255], ones[r.node >> 8, r.node & 255], below[r.node >> 8, r.node & 255] = r.zeros, r.ones, r.below
    one = lambda z, o: (o + 0.5) / (z + o + 1.0)
    kt = log_kt(zeros, ones)
    pw = np.where(zeros + ones > 0, np.logaddexp(kt, below) - LN2, 0.0)
    z0, o0 = zeros.sum(0), ones.sum(0)
    return one(z0, o0), log_kt(z0, o0) - pw.sum(0), one(zeros, ones), kt - below


def gram_logs(table: DataFrame, tops: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, every, log10): the model's log10 probability of each gram's byte after its context."""
    sharded = table.repartition(F.shiftright("gram", 8 * (DEPTH - 1))).sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one0, ratio0, one1, ratio1 = tops
        for gram, n, every in by_shard(batches):
            total = np.zeros(len(gram))
            for bit in range(8):
                levels = subtree(gram, n, bit, 2)
                # each leaf carries its own mixture up to the root
                leaf = levels[0]
                p = (leaf.ones + 0.5) / (leaf.zeros + leaf.ones + 1.0)
                at = np.arange(len(leaf.keys))
                for x in levels[1:]:
                    at = x.inverse[at]
                    p = blend(((x.ones + 0.5) / (x.zeros + x.ones + 1.0))[at], (x.kt - x.below)[at], p)
                newest, prefix = leaf.keys >> (8 * DEPTH), leaf.keys & 0xFF
                p = blend(one1[newest, prefix], ratio1[newest, prefix], p)
                p = blend(one0[prefix], ratio0[prefix], p)
                bits = ((gram & 0xFF) >> (7 - bit)) & 1
                mine = p[leaf.inverse]
                total += np.log10(np.where(bits == 1, mine, 1 - mine))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(every), pa.array(total)], ["gram", "every", "log10"])

    return sharded.mapInArrow(run, "gram long, every long, log10 double")


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    train: gives a condition on the id (null counts as true); the model learns from those rows, all of them.
    base_score: the sum over the words (A-Z lower-cased) and one end of log10((c + 1) / (N + V + 1)), by training counts.
    score: log10 of the text's probability by context-tree weighting; bits_per_byte its code length (null for empty
    texts, whose score is 0). Null texts are empty. With no training rows all counts are 0 and every bit has
    probability 1/2. Repeated rows count and are scored once each. docs must be a table scan.

    Counts are combined in each task, then shuffled. The most frequent words and grams, of bounded number and size,
    are broadcast for scoring; of the others each text sends its own rows to be joined, so nothing is left out.
    """
    spark = docs.sparkSession
    is_train = F.coalesce(train(F.col("id")), F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counts = written(counted(rows, is_train).groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "lm-counts")
    words = counts.filter(F.col("word").isNotNull()).select("word", "n", "every")
    table = counts.filter(F.col("gram").isNotNull()).select("gram", "n", "every")
    ends = rows.select("id").agg(F.count_if(is_train)).first()[0]
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = seen[0] + ends, seen[1] + (ends > 0)
    logs = written(gram_logs(table, tree_tops(table)), "lm-grams")

    common = frequent(words.filter(F.length("word") <= HOT_WORD_BYTES), HOT_WORDS).select("word", "n").toArrow()
    often = frequent(logs, HOT_GRAMS).select("gram", "log10").toArrow().sort_by("gram")
    share = spark.sparkContext.broadcast((common.column("word").to_pylist(), common.column("n").to_numpy(), often.column("gram").to_numpy(), often.column("log10").to_numpy()))
    norm = np.log10(float(total + kinds + 1))
    kind = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64())])

    def batch(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kind], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_n, hot_grams, hot_logs = share.value
        of = dict(zip(hot_words, hot_n.astype(float).tolist(), strict=True))
        end_log = float(np.log10(ends + 1.0) - norm)
        for b in batches:
            texts, tags, ids = (b.column(c).to_pylist() for c in ("text", "row", "id"))
            for part in chunks(texts):
                mine = [texts[i] for i in part]
                size = np.array([len(t) for t in mine], np.int64)
                gram = grams(mine)
                place, keys = pd.factorize(gram)
                at = np.minimum(np.searchsorted(hot_grams, keys), max(0, len(hot_grams) - 1))
                hit = hot_grams[at] == keys if len(hot_grams) else np.zeros(len(keys), bool)
                value = np.where(hit, hot_logs[at], 0.0) if len(hot_grams) else np.zeros(len(keys))
                sums = np.zeros(len(mine))
                if len(gram):
                    sums[size > 0] = np.add.reduceat(value[place], (np.cumsum(size) - size)[size > 0])
                tag = np.array(tags[part.start : part.stop], np.int64)
                tokens, known, base, rare, rare_n, rare_of = [], [], [], [], [], []
                for t in mine:
                    found = lowered(t)
                    n = np.array(list(map(of.get, found, repeat(-1.0))))
                    c = n[n >= 0]
                    more = Counter(compress(found, (n < 0).tolist())) if len(c) < len(n) else {}
                    rare += more
                    rare_n += more.values()
                    rare_of.append(len(more))
                    tokens.append(len(found) + 1)
                    known.append(int((c > 0).sum()) + (ends > 0))
                    base.append(float((np.log10(c + 1.0) - norm).sum()) + end_log)
                columns = {"row": tag, "id": ids[part.start : part.stop], "n": tokens, "known": known, "base": base, "score": sums, "bytes": size}
                yield batch(len(mine), columns)
                if rare:
                    yield batch(len(rare), {"row": np.repeat(tag, rare_of), "word": rare, "n": rare_n})
                cold = np.nonzero(~hit[place])[0] if not hit.all() else ()
                if len(cold):
                    owner = np.searchsorted(np.cumsum(size), cold, "right")
                    pairs, n = np.unique(np.stack([owner, gram[cold]]), axis=1, return_counts=True)
                    yield batch(len(n), {"row": tag[pairs[0]], "gram": pairs[1], "n": n.astype(np.int64)})

    out = written(rows.mapInArrow(run, "row long, id long, word binary, gram long, n long, known long, base double, score double, bytes long"), "lm-parts")
    whole = out.filter(F.col("bytes").isNotNull())
    cold_words = out.filter(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("m")).join(words.select("word", "n"), "word", "left")
    cold_words = cold_words.select("row", F.when(F.col("n") > 0, F.col("m")).otherwise(0).alias("known"), (F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - float(norm))).alias("base"), F.lit(0.0).alias("score"))
    cold_grams = out.filter(F.col("gram").isNotNull()).select("row", "gram", F.col("n").alias("m")).join(logs.select("gram", "log10"), "gram")
    cold_grams = cold_grams.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("m") * F.col("log10")).alias("score"))
    more = cold_words.unionByName(cold_grams).groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = whole.join(more, "row", "left")
    total_score = F.col("score") + zero("s")
    return joined.select("id", (~is_train).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), total_score.alias("score"), F.when(F.col("bytes") > 0, -total_score / float(np.log10(2.0)) / F.col("bytes")).alias("bits_per_byte"))


def learns(ids):
    """crc32 of the id as text, modulo 7, is not 2."""
    return crc_mod(ids, 7) != 2

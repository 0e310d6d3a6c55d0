"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits. If two differ in at most two bits, then for some
segment (in cyclic order) the two agree, and in the segment after it they differ in at most one bit: of the error counts
(e0, e1, e2) with sum at most 2, one is 0 and followed by 0 or 1. So a key is an exact segment and, for the next one,
the index of a codeword of the perfect Golay code [23, 12, 7] near it. A segment within distance 2 of its codeword has
that one key; at distance 3 it also takes the five codewords at distance 4. Two segments at distance 1 (even 2) then share
a codeword. Fingerprints that share a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafpress.llm.common import small, written
from leafpress.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Fixed value.
CHUNK = 1 << 16
#: Fingerprints of a key that are compared with one another; keys with more are dealt anew.
GROUP = 64


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome, up to 6 error patterns that lead to near codewords (-1: none)."""
    low = np.array([_remainder(v) for v in range(1 << 12)], np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int64)
    errors: dict[int, int] = {}
    for n in range(4):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    near = np.full((1 << 11, 6), -1, np.int64)
    for s, e in errors.items():
        near[s, 0] = e
        if e.bit_count() == 3:
            others = {errors[_remainder(e ^ 1 << b)] ^ 1 << b for b in range(23) if not e >> b & 1}
            near[s, 1:] = sorted(others)
    return low, high, near


def golay_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of their fingerprint) of fingerprints (uint64)."""
    low, high, near = tables
    cut = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, owners = [], []
    for i in range(3):
        exact, fuzzy = cut[i], cut[(i + 1) % 3]
        errors = near[low[fuzzy & 0xFFF] ^ high[fuzzy >> 12]]
        index = (fuzzy[:, None] ^ errors) >> 11
        key = (i << 34) | (exact[:, None] << 12) | index
        ok = errors >= 0
        keys.append(key[ok])
        owners.append(np.nonzero(ok)[0])
    return np.concatenate(keys), np.concatenate(owners)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text (UTF-8): A-Z lower-cased, shingles of so many words (repeats included), XXH64 with seed 42."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    hashes = map(xxh64_intdigest, shingles, repeat(42))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(islice(hashes, min(CHUNK, n - at)), np.uint64, min(CHUNK, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, print): a row for each row of docs. Null and blank texts have the fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prints.view(np.int64))], ["id", "print"])

    return rows.mapInArrow(run, "id long, print long")


def _fine(keys: np.ndarray, prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codeword, index of the row) of keys' third segments."""
    low, high, near = tables
    third = np.zeros(len(keys), np.int64)
    for i in range(3):
        at, n = SEGMENTS[(i + 2) % 3]
        of = keys >> 34 == i
        third[of] = ((prints[of] >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
    errors = near[low[third & 0xFFF] ^ high[third >> 12]]
    ok = errors >= 0
    return ((third[:, None] ^ errors) >> 11)[ok], np.nonzero(ok)[0]


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _split(rows: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded) of rows (key, print): the verified pairs of keys with up to GROUP fingerprints, and the keys that have more.

    Keys are counted first (map-side combined), so that no larger group is ever gathered.
    """
    met = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).filter(F.col("n") > 1)
    met = written(met, "simhash-met")
    pairs = met.filter((F.col("n") == 2) & (_differ(F.col("a"), F.col("b")) <= most)).select("a", "b")
    few = small(written(met.filter((F.col("n") > 2) & (F.col("n") <= GROUP)).select(*key), "simhash-few"))
    groups = rows.join(few, key, "left_semi").groupBy(*key).agg(F.collect_list("print").alias("all")).select("all", F.explode("all").alias("a"))
    close = F.filter("all", lambda x: (x > F.col("a")) & (_differ(x, F.col("a")) <= most))  # only verified pairs leave the group
    pairs = pairs.union(groups.select("a", F.explode(close).alias("b")))
    return pairs, written(met.filter(F.col("n") > GROUP).select(*key), "simhash-crowded")


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column print) differing in at most `most` (at most 2) bits.

    The fingerprints of a key are compared with one another if they are at most GROUP. Those of fuller keys are dealt
    anew by a codeword of the third segment too, and compared likewise. What is still crowded then are fingerprints of
    which many lie within a few bits of each other: these meet at the values between them (see _middles), so that they cost
    their number and never its square.
    """
    if not 0 <= most <= 2:
        raise ValueError("Golay keys find differences of at most two bits")
    if not most:  # distinct fingerprints always differ
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            p = b.column("print").to_numpy(zero_copy_only=False)
            keys, owners = golay_keys(p.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p[owners])], ["key", "print"])

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            k, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "print"))
            word, owners = _fine(k, p.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(k[owners]), pa.array(word), pa.array(p[owners])], ["key", "word", "print"])

    keys = prints.mapInArrow(coarse, "key long, print long")
    pairs, crowded = _split(keys, ["key"], most)
    if not crowded.isEmpty():
        keys = written(keys.join(small(crowded), "key", "left_semi").mapInArrow(fine, "key long, word long, print long"), "simhash-fine")
        more, crowded = _split(keys, ["key", "word"], most)
        pairs = pairs.union(more)
        if not crowded.isEmpty():
            rest = keys.join(small(crowded), ["key", "word"], "left_semi").select("print").distinct()
            pairs = pairs.union(_middles(rest, most))
    return pairs.distinct()


def _middles(prints: DataFrame, most: int) -> DataFrame:
    """(a, b): links that connect fingerprints differing in at most `most` (1 or 2) bits, for dense ones.

    Each is dealt to the 65 values within one bit of it. Those that meet at a value differ in at most two bits, any two
    such meet at one, and at most 65 can, so a star of the value's fingerprints is enough.
    """
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if most == 2:
        around = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), one)))
        around = prints.select("print", around.alias("bit")).select("print", F.col("print").bitwiseXOR(F.col("bit")).alias("middle"))
    else:  # at most one bit: meet at the value with that bit cleared
        around = F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("i"), one(i).alias("bit"))))
        around = prints.select("print", around.alias("x")).select("print", F.struct(F.col("x.i"), F.col("print").bitwiseAND(F.bitwise_not(F.col("x.bit")))).alias("middle"))
    stars = around.groupBy("middle").agg(F.sort_array(F.collect_list("print")).alias("all")).filter(F.size("all") > 1)
    return stars.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """One row for each row of docs: id, print, component_id (smallest id reachable over links, itself included).

    Equal fingerprints are one node, so groups of copies cost nothing; empty texts all have the fingerprint 0 and are
    linked like any other. Null ids belong to a component but never name it (null if it has no other id). Repeated rows
    give repeated rows. Empty input gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    nodes = written(rows.groupBy("print").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("print"), most))
    named = nodes.join(small(written(roots, "simhash-roots")), F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    named = written(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    whole = written(named.select("print", "root").join(least, "root").select("print", "component_id"), "simhash-classes")
    return rows.join(small(whole), "print")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """The rows of docs of which one of each component stays: that with its smallest id (all rows
    that repeat this id, so exact dedup should come first). Rows with a null id stay."""
    out = near_duplicates(docs, id_col, text_col, words, most)
    gone = written(out.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone")).distinct(), "simhash-gone")
    return docs.join(small(gone, tags=True), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")

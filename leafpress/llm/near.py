"""Near-dedup of whole texts by the Jaccard similarity of their five-word shingles: SimHash with Golay-code fuzzy hashing
proposes, exact similarity decides.

64 bits don't tell texts of similarity 0.8, whose fingerprints differ in up to 17 of them (README), so the SimHash of a text's
distinct shingles is taken as wide as SEGMENTS segments of 23 bits. Each segment goes to the nearest codeword of the perfect
Golay code [23, 12, 7] (see simhash); texts that share a segment's codeword meet, and of those the ones whose first 128 bits
differ in at most FAR bits are candidates. At similarity 0.8 bits differ with probability 0.15 and codewords agree with
0.12, so texts miss each other with probability (1 - 0.12)^80, below 1 in 10,000.

Of the candidates, only pairs that may be similar are compared: each text has a map of BITS bits, one set for each
shingle, and a bit that one text has and the other has not is a shingle that they don't share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafpress.llm import common
from leafpress.llm.common import ROW, ROW_TYPE, small, tagged, written
from leafpress.llm.components import components
from leafpress.llm.simhash import golay_tables

WORDS, LEAST = 5, 0.8
#: Segments of a fingerprint and the 64-bit words that hold them; hashes that are summed at once, in lanes of a byte.
SEGMENTS, SEGMENT = 80, 23
PRINT, LANE = -(-SEGMENTS * SEGMENT // 64), 255
#: The most of a candidate's first 128 bits that differ: at similarity 0.8 it is 19, give or take 4.
FAR = 44
#: Bits of a text's map of shingles, in longs.
BITS, LONGS = 1024, 16
#: Texts of a codeword beyond which they are first compared with a centre; parts that a centre's pairs are dealt to.
CROWD, PARTS = 100, 64
#: The most times that each node is compared with one other only, before all pairs that are left are compared.
ROUNDS = 3
_rng = np.random.default_rng(42)
XORS, ODDS, MORE = (_rng.integers(0, 1 << 64, PRINT, np.uint64) for _ in range(3))
ODDS |= np.uint64(1)
MORE |= np.uint64(1)
tables = cache(golay_tables)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles (A-Z lower-cased), sorted. A text of fewer words is one shingle, a blank one has none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(islice(w, i, None) for i in range(WORDS)), strict=False)) if len(w) >= WORDS else iter([b" ".join(w)])
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64, max(1, len(w) - WORDS + 1)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits (PRINT * 64) of the SimHash of a set of hashes, sorted and not empty: 1 if set in over half of them.

    Where just half have it, a word's 64 bits go by its least hash, which similar sets share.
    """
    counts, least = np.zeros((8, PRINT * 8), np.int64), np.full(PRINT, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), LANE):
        x = (hashes[at : at + LANE, None] ^ XORS) * ODDS
        x ^= x >> np.uint64(32)
        x *= MORE
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(0), out=least)
        for bit in range(8):
            counts[bit] += ((x >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(0).view(np.uint8)
    least *= ODDS
    least ^= least >> np.uint64(32)
    return counts.T.reshape(-1) * 2 + np.unpackbits(least.view(np.uint8), bitorder="little") > len(hashes)


def golay_words(bits: np.ndarray) -> np.ndarray:
    """For each segment of a fingerprint, its number and the index of the nearest codeword."""
    low, high, near = tables()
    cut = bits[: SEGMENTS * SEGMENT].reshape(SEGMENTS, SEGMENT) @ (1 << np.arange(SEGMENT))
    word = (cut ^ near[low[cut & 0xFFF] ^ high[cut >> 12], 0]) >> 11
    return (np.arange(SEGMENTS) << 12 | word).astype(np.int32)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[hashes % np.uint64(BITS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def shortened(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each hash, sorted, repeats included."""
    return np.sort(hashes.astype(np.uint16))


def numbered(short: np.ndarray) -> np.ndarray:
    """Short hashes made distinct by numbering those that are equal. Each hash that two sets share is at least one number
    that they share, so the similarity of these is never below that of the hashes."""
    return short.astype(np.uint64) << np.uint64(32) | (np.arange(len(short)) - np.searchsorted(short, short)).astype(np.uint64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(ROW, F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row tag, id, node, keys, size, print, bits): texts with the same shingles are the same node. Sets of fewer than four
    shingles have no keys: no other set is LEAST similar to them."""
    names = [f"b{i}" for i in range(LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int32), np.zeros(2, np.int64)
        for b in batches:
            nodes, keys, sizes, prints, maps = [], [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                key, first = none
                if len(s) >= LEAST / (1 - LEAST) - 1e-6:
                    own = fingerprint(s)
                    key, first = golay_words(own), np.packbits(own[:128], bitorder="little").view(np.int64)
                nodes.append(xxh64_intdigest(s.tobytes(), 1))
                keys.append(key)
                sizes.append(len(s))
                prints.append(first)
                maps.append(bit_map(s))
            struct = lambda rows, named: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m)) for m in np.array(rows, np.int64).reshape(-1, len(named)).T], named)
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), struct(prints, ["p0", "p1"]), struct(maps, names)]
            yield pa.RecordBatch.from_arrays([b.column(ROW), b.column("id"), *columns], [ROW, "id", "node", "keys", "size", "print", "bits"])

    kind = ",".join(f"{n}:long" for n in names)
    return _texts(docs, id_col, text_col).mapInArrow(run, f"{ROW} {ROW_TYPE}, id long, node long, keys array<int>, size long, print struct<p0:long,p1:long>, bits struct<{kind}>")


def _close(a: str, b: str) -> Column:
    """Whether texts (tables a and b: size, p0, p1) are candidates: neither too unlike in size nor in the first 128 bits."""
    least, most = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (least >= most * LEAST - 1e-6) & (sum(F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in ("p0", "p1")) <= FAR)


def _may(a: str, b: str) -> Column:
    """Whether texts (tables a and b: size, bits) may be at least LEAST similar: never false for texts that are.

    The bits that only one has bound what it shares with the other from above, and that bounds the similarity.
    """
    bits = lambda x, y: sum(F.bit_count(F.col(f"{x}.bits.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.bits.b{i}")))) for i in range(LONGS))
    both = F.least(F.col(f"{a}.size") - bits(a, b), F.col(f"{b}.size") - bits(b, a))
    return both * (1 + LEAST) + 1e-6 >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * LEAST


def _similar(pairs: DataFrame, sets: DataFrame, short: bool = False) -> DataFrame:
    """The pairs (a, b, part; a written table) that are at least LEAST similar; if short, that may be by their short hashes, a
    quarter of the bytes. Where pairs are few, they are broadcast to the sets, so that only a set for each pair and for each
    (a, part) is shuffled. A centre's pairs lie in parts, so none is a hot key."""
    column = F.col("short" if short else "hashes")
    few = F.broadcast if pairs.count() <= common.BROADCAST_ROWS else (lambda df: df)
    parts = pairs.select(F.col("a").alias("node"), "part").distinct()
    left = sets.join(few(parts), "node").select(F.col("node").alias("a"), "part", column.alias("x"))
    right = sets.join(few(pairs.withColumnRenamed("b", "node")), "node").select("a", "part", F.col("node").alias("b"), column.alias("y"))
    both = left.join(right, ["a", "part"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sides = ([numbered(np.frombuffer(v.as_py(), np.uint16)) if short else np.frombuffer(v.as_py(), np.uint64) for v in t.column(c)] for c in ("x", "y"))
            ok = [jaccard(x, y) >= LEAST for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _connecting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of pairs (a, b; a < b, written) that are at least LEAST similar, enough to connect all that these connect.

    Pairs that may be similar by their short hashes, as few others may, are compared by the whole ones. While such pairs are
    more than their nodes, each node is compared with one only, of those that it is paired with the one that has most
    pairs. Pairs that this connects aren't compared any more; all that are left are.
    """
    pairs = written(_similar(pairs.withColumn("part", F.lit(0)), sets, short=True), "near-likely")
    found = None
    for _ in range(ROUNDS):
        ends = pairs.select("a").union(pairs.select("b"))
        degrees = written(ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")), "near-degrees")
        if pairs.count() <= degrees.count():
            break
        of = lambda end: small(degrees).select(F.col("node").alias(end), F.struct("n", "node").alias(f"{end}_"))
        ranked = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_", "b_").alias("top"), F.least("a_", "b_")["node"].alias("b"))
        tops = ranked.groupBy("b").agg(F.max("top").alias("top"))
        tops = written(tops.select("top.node", "b", F.pmod(F.hash("b"), F.ceil(F.col("top.n") / CROWD).cast("int")).alias("part")).withColumnRenamed("node", "a"), "near-tops")
        links = written(_similar(tops, sets), "near-links")
        found = links if found is None else found.union(links)
        roots = small(written(components(found), "near-joined"))
        root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_"))
        apart = F.coalesce("a_", "a") != F.coalesce("b_", "b")
        done = small(tops).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.join(done, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left").filter(apart)
        pairs = written(pairs.select("a", "b"), "near-apart")
    rest = _similar(pairs.withColumn("part", F.lit(0)), sets)
    return rest if found is None else found.union(rest)


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes, short) of the nodes of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [shingles(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array([f(s).tobytes() for s in all_], pa.binary()) for f in (np.asarray, shortened))], ["node", "hashes", "short"])

    rows = written(_of(nodes, pairs).select(F.col("first_row").alias(ROW), "node"), "near-places")
    texts = _texts(docs, id_col, text_col).join(small(rows, tags=True), ROW)
    return written(texts.select("node", "text").mapInArrow(run, "node long, hashes binary, short binary"), "near-sets")


def _of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that pairs (a, b) have."""
    ids = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ids")
    return nodes.join(small(ids), "node", "left_semi")


def _meetings(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes (node, keys, bits) with a score, the sum of their codewords' counts, looked up by row: cells aren't made for it."""
    met, kind = np.zeros(SEGMENTS << 12, np.int64), nodes.schema["bits"].dataType.simpleString()
    of = counts.toArrow()  # at most SEGMENTS * 4096
    met[of.column("key").to_numpy()] = of.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            ends = np.concatenate([[0], np.cumsum(met[keys.flatten().to_numpy()])])
            at = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("bits"), pa.array(ends[at[1:]] - ends[at[:-1]])], ["node", "bits", "score"])

    return nodes.select("node", "keys", "bits").mapInArrow(run, f"node long, bits {kind}, score long")


def _mapped(cells: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """cells (boss: null if it is the node), dealt by key, with the maps (bits) of as many nodes as may be broadcast, so that pairs of these which can't be
    similar never become rows. If there are more nodes, those have maps that meet most others; the rest's are null."""
    n, most = nodes.count(), max(0, common.BROADCAST_ROWS)
    if n > most:
        scores = written(_meetings(nodes, counts), "near-meetings")
        cut = scores.approxQuantile("score", [1 - 0.9 * most / n], 0.1 * most / n) if most else []
        nodes = written(scores.filter(F.col("score") > F.lit(cut[0] if cut else None)).select("node", "bits"), "near-met-most")
    cells = cells.repartition("key").withColumn("boss", F.coalesce("boss", "node"))
    return cells.join(F.broadcast(nodes.select("node", "bits")), "node", "left")


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links between nodes that meet and whose similarity is at least LEAST, enough to connect all that such pairs connect.

    Where more than CROWD nodes share a codeword, all are first compared with a centre: the node that meets most others
    over all such codewords, as a text does whose edited copies are the group. Nodes similar to the same centre are
    connected, so pairs of them aren't compared. Every other pair that meets and may be similar (see _may) is, unless its nodes
    are already connected (see _connecting).
    """
    cells = nodes.select("node", "size", "print.p0", "print.p1", F.explode("keys").alias("key"))
    counts = written(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-counts")
    crowds = counts.filter(F.col("n") > CROWD)
    named = nodes.withColumn("boss", F.col("node"))
    same = nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    if not crowds.isEmpty():
        crowd = written(cells.join(small(crowds), "key"), "near-crowd")
        scores = written(crowd.groupBy("node").agg(F.sum("n").alias("score")), "near-scores")
        crowd = crowd.join(small(scores), "node")
        centres = written(crowd.groupBy("key").agg(F.max(F.struct("score", "node", "size", "p0", "p1")).alias("x")).select("key", "x.node", "x.size", "x.p0", "x.p1"), "near-centres")
        stars = crowd.alias("l").join(small(centres).alias("m"), F.col("l.key") == F.col("m.key")).filter((F.col("l.node") != F.col("m.node")) & _close("l", "m"))
        stars = written(stars.select(F.col("m.node").alias("a"), F.col("l.node").alias("b")).distinct().withColumn("part", F.pmod(F.hash("b"), F.lit(PARTS))), "near-stars")
        same = written(_similar(stars, _sets(docs, nodes, stars, id_col, text_col)), "near-links")
        best = same.join(scores.select(F.col("node").alias("a"), "score"), "a").groupBy("b").agg(F.max(F.struct("score", "a"))["a"].alias("boss"))
        best = small(written(best, "near-bosses"))
        named = nodes.join(best, F.col("node") == F.col("b"), "left").withColumn("boss", F.coalesce("boss", "node"))
    cells = written(named.select("node", "boss", "size", "print", "keys"), "near-cells").select("node", F.nullif("boss", "node").alias("boss"), "size", "print.p0", "print.p1", F.explode("keys").alias("key"))
    cells = _mapped(cells, nodes, counts)
    met = (F.col("l.boss") != F.col("m.boss")) & _close("l", "m") & (F.col("l.bits").isNull() | F.col("m.bits").isNull() | _may("l", "m"))
    pairs = cells.alias("l").join(cells.alias("m"), F.col("l.key") == F.col("m.key")).filter(F.col("l.node") < F.col("m.node")).filter(met)
    pairs = written(pairs.select(F.col("l.node").alias("a"), F.col("m.node").alias("b")).distinct(), "near-met")
    maps = small(written(_of(nodes, pairs).select("node", F.struct("size", "bits").alias("map")), "near-maps"))
    pairs = pairs.join(maps.select(F.col("node").alias("a"), F.col("map").alias("l")), "a").join(maps.select(F.col("node").alias("b"), F.col("map").alias("m")), "b")
    pairs = written(pairs.filter(_may("l", "m")).select("a", "b"), "near-pairs")
    return same.union(_connecting(pairs, _sets(docs, nodes, pairs, id_col, text_col)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each component of similar texts stays: that with its smallest id. Rows with a null
    id stay, and blank texts are all alike."""
    docs = docs if ROW in docs.columns else tagged(docs)
    rows = written(sketches(docs, id_col, text_col), "near-rows")
    nodes = rows.groupBy(F.col("node").alias("hash")).agg(F.min("id").alias("first"), F.min(F.struct(ROW, "size", "print", "bits")).alias("x"), F.any_value("keys").alias("keys"))
    # nodes are numbered: numbers take less room than hashes in each of a node's cells
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "hash", "first", "keys", F.col(f"x.{ROW}").alias("first_row"), "x.size", "x.print", "x.bits"), "near-nodes")
    roots = written(components(links(docs, nodes, id_col, text_col)), "near-roots")
    named = nodes.join(small(roots), "node", "left").select("hash", "first", F.coalesce("root", "node").alias("root"))
    named = written(named, "near-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = written(named.join(least, "root").select(F.col("hash").alias("node"), "component_id"), "near-classes")
    out = rows.select("id", "node").join(small(whole), "node")
    gone = written(out.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone")).distinct(), "near-gone")
    return docs.join(small(gone, tags=True), F.col(id_col).cast("long") == F.col("__gone"), "left_anti").drop(ROW)

"""Substring deduplication by fixed-block anchors.

A window of WINDOW words always holds a whole block of BLOCK words that is aligned in its own document (starts at a
multiple of BLOCK), as BLOCK <= (WINDOW + 1) / 2. So the index has each document's aligned blocks, every rolling block of
every document probes it, and a window that repeats a smaller document's window holds a hit. A hit is extended by hashes
of what stands around it: all windows through it lie in its context, BLOCK words to the left and to the right. If an
equal context stands in a smaller document, all of them repeat; if not (the context differs near the end of the repeat),
its windows are compared one by one. Together these extensions are the maximal repeats.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from leafpress.llm.common import ROW, ROW_TYPE, tagged, written

WINDOW = 50
BLOCK = 25
#: Words whose probes a task packs together, words meant for one bucket of the index, and probes of a bucket held in memory.
CHUNK, BUCKET_WORDS, HELD = 1_000_000, 1_000_000, 4_000_000
#: Words hashed together: a piece takes some 300 bytes a word while it is hashed, and 16 a probe of it stay until they are packed.
PIECE = 100_000
#: Odd, so powers have inverses. Blocks are told apart by the first hash, contexts and windows by both (128 bits).
MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
NO_ID = (1 << 63) - 1
ROW_KIND = np.dtype([("f", "<i8"), ("i", "<i8")])
#: Columns of a run of probes, those of the first three as steps from the run before.
RUN = [("f", "<i8"), ("i", "<i8"), ("id", "<i8"), ("at", "<u4"), ("n", "<u4")]


def rows_of(column: pa.StructArray) -> np.ndarray:
    """Row tags as a structured array."""
    out = np.empty(len(column), ROW_KIND)
    for k in ROW_KIND.names:
        out[k] = column.field(k).to_numpy()
    return out


def tags_of(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in ROW_KIND.names], ROW_KIND.names)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """The words of texts (bytes), one after another, with hashes of any range in constant time: one for each multiplier."""

    def __init__(self, texts: list[bytes], multipliers: list[np.uint64] = MULTIPLIERS):
        words = [t.split() for t in texts]
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        n = int(self.begin[-1])
        h = np.empty(n, np.uint64)
        for w, at in zip(words, self.begin.tolist(), strict=False):
            h[at : at + len(w)] = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
        powers = lambda m: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m)]))
        self.parts = []
        for m in multipliers:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(m)[:n], dtype=np.uint64)])
            self.parts.append((sums, powers(np.uint64(pow(int(m), -1, 1 << 64)))))

    def ranges(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        return [mixed((sums[high] - sums[low]) * inverse[low]) for sums, inverse in self.parts]

    def starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of every start of so many words within one text."""
        n = np.maximum(self.size - length + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        first = np.repeat(np.cumsum(n) - n, n)
        return np.arange(len(owner)) - first + self.begin[owner], owner


def groups(texts: pa.Array, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many words (six bytes each)."""
    begin, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= 6 * words:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(begin, end, texts) of groups of about PIECE words."""
    for lo, hi in groups(texts, PIECE):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def rolling(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of every rolling block of texts with a window, hashed a piece at a time."""
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64))]
    for lo, _, piece in pieces(texts):
        x = Hashed(piece, MULTIPLIERS[:1])
        place, owner = x.starts(BLOCK)
        keep = x.size[owner] >= WINDOW
        place, owner = place[keep], owner[keep]
        found.append(((lo + owner).astype(np.int32), (place - x.begin[owner]).astype(np.int32), x.ranges(place, place + BLOCK)[0]))
    owner, at, h = (np.concatenate(column) for column in zip(*found, strict=True))
    return owner, at, h


def planes(a: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: high bytes are mostly zero, so that shuffles compress them."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(-1)


def pack(row: np.ndarray, ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> bytes:
    """Probes in order of their place as bytes: runs of one document (its row, id, first place, number), then for each probe
    the low 48 bits of its hash and the step from the place before it. Numbers that follow one another are near, so of
    runs' tags and ids the differences are kept, by planes of bytes."""
    step = np.diff(at, prepend=at[:1])
    new = np.concatenate([[True], row[1:] != row[:-1]]) | (step > 0xFFFF) | (step < 0)
    first = np.nonzero(new)[0]
    change = lambda x: np.diff(x[first], prepend=np.int64(0))  # noqa: E731  wraps around, and back in unpack
    runs = [change(row["f"]), change(row["i"]), change(ids), at[first], np.diff(np.concatenate([first, [len(row)]]))]
    step = np.where(new, 0, step)
    out = [planes(x.astype(kind)) for x, (_, kind) in zip(runs, RUN, strict=True)]
    return b"".join([len(first).to_bytes(4, "little"), *out, h.astype("<u4").tobytes(), (h >> np.uint64(32)).astype("<u2").tobytes(), planes(step.astype("<u2"))])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, at, runs = int.from_bytes(data[:4], "little"), 4, {}
    for name, kind in RUN:
        runs[name] = unplanes(data, kind, n, at)
        at += n * np.dtype(kind).itemsize
    m = int(runs["n"].sum())
    rows = np.empty(n, ROW_KIND)
    rows["f"], rows["i"], ids = (np.cumsum(runs[k]) for k in ("f", "i", "id"))
    h = np.frombuffer(data, "<u4", m, at).astype(np.uint64) | np.frombuffer(data, "<u2", m, at + 4 * m).astype(np.uint64) << np.uint64(32)
    step = np.cumsum(unplanes(data, "<u2", m, at + 6 * m), dtype=np.int64)
    first = np.repeat(np.cumsum(runs["n"], dtype=np.int64) - runs["n"], runs["n"])
    place = np.repeat(runs["at"].astype(np.int64), runs["n"]) + step - step[first]
    return np.repeat(rows, runs["n"]), np.repeat(ids, runs["n"]), place, h


def probes(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, probes): every rolling block of texts with a window, dealt by hash; those at multiples of BLOCK are the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows, ids = b.column("text"), rows_of(b.column("row")), b.column("id").to_numpy()
            for lo, hi in groups(texts, CHUNK):
                owner, at, h = rolling(texts.slice(lo, hi - lo))
                if not len(at):
                    continue
                bucket = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32) if buckets <= 1 << 16 else (h >> np.uint64(16)).astype(np.int64) % buckets
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                bucket, owner, at, h = bucket[order], owner[order], at[order], h[order]
                cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
                out = [pack(rows[lo + owner[s]], ids[lo + owner[s]], at[s], h[s]) for s in map(slice, cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "probes"])

    return docs.mapInArrow(run, "bucket int, probes binary")


class Index:
    """For each block's hash: the smallest id of an aligned one, and the largest id of any. Bounded by the distinct hashes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> None:
        self.parts.append((h, np.where(at % BLOCK == 0, ids, NO_ID), ids))
        self.held += len(h)
        if self.held >= HELD:
            self.parts = [self.table()]
            self.held = len(self.parts[0][0]) // 2  # so that merging stays in proportion to what was added

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, least, most = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        return h[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def hits(packed: DataFrame) -> DataFrame:
    """(row, id, at): the rolling blocks of hashes that stand aligned in one document and anywhere in one with a larger id,
    without those in documents smaller than the first aligned one.

    A task reads one bucket after another. The probes of one go to a spooled file (memory, then the task's own temporary
    file, removed at once) and are read twice, so a very frequent block takes time in proportion, but not memory.
    """
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")

    def found(spool, index: Index) -> Iterator[pa.RecordBatch]:
        h, least, most = index.table()
        shared = least < most
        h, least = h[shared], least[shared]
        spool.seek(0)
        while len(h) and (size := spool.read(8)):
            row, ids, at, mine = unpack(spool.read(int.from_bytes(size, "little")))
            place = np.minimum(np.searchsorted(h, mine), len(h) - 1)
            ok = (h[place] == mine) & (ids >= least[place])
            if ok.any():
                yield pa.RecordBatch.from_arrays([tags_of(row[ok]), pa.array(ids[ok]), pa.array(at[ok].astype(np.int32))], ["row", "id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spool, index = None, None, None
        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("probes"), strict=True):
                if bucket != now:
                    if spool is not None:
                        yield from found(spool, index)
                        spool.close()
                    now, spool, index = bucket, tempfile.SpooledTemporaryFile(max_size=1 << 26), Index()
                data = data.as_py()
                spool.write(len(data).to_bytes(8, "little"))
                spool.write(data)
                _, ids, at, h = unpack(data)
                index.add(ids, at, h)
        if spool is not None:
            yield from found(spool, index)
            spool.close()

    return dealt.mapInArrow(run, f"row {ROW_TYPE}, id long, at int")


def with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined by row with lists (row, ats: array; written). They are joined by shuffle at every size: the lists grow with the texts."""
    return docs.join(lists.hint("shuffle_merge"), "row", how)


def contexts(docs: DataFrame) -> DataFrame:
    """(row, id, at, context, more) of docs with their hits (ats): two hashes of the BLOCK words before, in and after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, ats = rows_of(b.column("row")), b.column("id").to_numpy(), b.column("ats")
            for lo, hi, piece in pieces(b.column("text")):
                x = Hashed(piece)
                part = ats.slice(lo, hi - lo)
                at = part.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                left, right = np.minimum(at, BLOCK), np.minimum(x.size[owner] - at, 2 * BLOCK)
                place = x.begin[owner] + at
                ends = left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64)
                c = [pa.array(mixed(h + ends).view(np.int64)) for h in x.ranges(place - left, place + right)]
                yield pa.RecordBatch.from_arrays([tags_of(rows[lo + owner]), pa.array(ids[lo + owner]), pa.array(at.astype(np.int32)), *c], ["row", "id", "at", "context", "more"])

    return docs.mapInArrow(run, f"row {ROW_TYPE}, id long, at int, context long, more long")


def windows(docs: DataFrame) -> DataFrame:
    """(window, more, row, id, at) of docs with hits (ats): two hashes of every window through a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, ats = rows_of(b.column("row")), b.column("id").to_numpy(), b.column("ats")
            for lo, hi, piece in pieces(b.column("text")):
                x = Hashed(piece)
                part = ats.slice(lo, hi - lo)
                at = part.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                every = (at[:, None] - np.arange(WINDOW - BLOCK + 1)).reshape(-1)
                owner = np.repeat(owner, WINDOW - BLOCK + 1)
                ok = (every >= 0) & (every + WINDOW <= x.size[owner])
                place = np.unique(x.begin[owner[ok]] + every[ok])
                owner = np.searchsorted(x.begin, place, "right") - 1
                h = [pa.array(h.view(np.int64)) for h in x.ranges(place, place + WINDOW)]
                yield pa.RecordBatch.from_arrays([*h, tags_of(rows[lo + owner]), pa.array(ids[lo + owner]), pa.array((place - x.begin[owner]).astype(np.int32))], ["window", "more", "row", "id", "at"])

    return docs.mapInArrow(run, f"window long, more long, row {ROW_TYPE}, id long, at int")


def repeats(docs: DataFrame) -> DataFrame:
    """(row, ats): for each row of docs (row, id, text as bytes), the words to remove, as packed ranges begin * 2**32 + end
    (which may overlap, and end beyond the text)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = hits(probes(docs, max(64, size // (6 * BUCKET_WORDS))))
    listed = lambda df: df.groupBy("row").agg(F.collect_list("at").alias("ats"))  # noqa: E731  at most a document's words
    hit_lists = written(listed(found), "sub-hits")
    seen = written(contexts(with_texts(docs, hit_lists, "inner")), "sub-contexts")
    # written, so that the join's sides are plain exchanges and Spark can split the partition of a frequent context
    least = written(seen.groupBy("context", "more").agg(F.min("id").alias("least")), "sub-least")
    seen = written(seen.join(least, ["context", "more"]).select("row", "at", (F.col("least") < F.col("id")).alias("whole")), "sub-classes")
    rest = written(listed(seen.filter(~F.col("whole"))), "sub-rest")
    single = written(windows(with_texts(docs, rest, "inner")), "sub-windows")
    least = single.groupBy("window", "more").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") < F.col("most"))
    least = written(least.select("window", "more", "least"), "sub-least-windows")
    single = single.join(least, ["window", "more"]).filter(F.col("least") < F.col("id")).select("row", F.col("at").alias("b"), (F.col("at") + WINDOW).alias("e"))
    whole = seen.filter("whole").select("row", F.greatest(F.col("at") - BLOCK, F.lit(0)).alias("b"), (F.col("at") + 2 * BLOCK).alias("e"))
    ranges = whole.union(single).select("row", (F.shiftleft(F.col("b").cast("long"), 32) + F.col("e")).alias("at"))
    return ranges.groupBy("row").agg(F.collect_list("at").alias("ats"))


def kept_words(words: list[bytes], ranges: list[int] | None) -> list[bytes]:
    out, done = [], 0
    for r in sorted(ranges or ()):
        begin, end = r >> 32, min(r & 0xFFFFFFFF, len(words))
        if begin > done:
            out += words[done:begin]
        done = max(done, end)
    return out + words[done:] if done else words


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space), or with digests
    its SHA-256 instead.

    A word is removed if a window of WINDOW words over it also starts in a document with a smaller id; windows are judged
    on the input. Rows with one id are one document here: they remove nothing from each other. Null ids are larger than all
    others and equal to one another. Null texts have no words; shorter texts than a window lose none. Rows are told apart
    by their tags.
    """
    base = tagged(docs).select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("real"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("id", F.coalesce("real", F.lit(NO_ID).cast("long")))
    lists = written(repeats(base.select("row", "id", "text")), "sub-ranges")
    rows = with_texts(base.select("row", F.col("real").alias("id"), "text"), lists, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, ranges in zip(b.column("text"), b.column("ats"), strict=True):
                words = t.as_py().split()
                stay = kept_words(words, ranges.as_py())
                n.append(len(words))
                gone.append(len(words) - len(stay))
                text = b" ".join(stay)
                kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "ats").mapInArrow(run, "id long, n_words long, n_removed long, kept string")

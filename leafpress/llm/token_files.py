"""Token ids in binary files: blocks in patched frames of reference.

File format (little-endian). Header: magic "LPTOK1\0\0", then int64 counts of documents, ids and blocks. Then for each
document its id (int64, the smallest value for null) and its number of ids (int64); for each block the place of its
bytes (int64, from the first block's). A block holds up to BLOCK ids: their minimum (uint32), their number (uint16), the
width in bits (uint8), the number of exceptions (uint16); the differences from the minimum, their low bits packed at
that width; the exceptions' places (uint16), then their full differences (uint32).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.common import TwoGenerations, shared_path, written

MAGIC = b"LPTOK1\0\0"
BLOCK = 1024
#: The packed width holds this percentile of a block's differences; the rest are exceptions.
PERCENTILE = 90
NULL_ID = -(1 << 63)
HEAD = struct.Struct("<IHBH")


def pack_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    d = (ids - least).astype(np.uint32)
    width = int(np.partition(d, (len(d) - 1) * PERCENTILE // 100)[(len(d) - 1) * PERCENTILE // 100]).bit_length()
    high = np.nonzero(d >> np.uint32(width))[0] if width < 32 else np.zeros(0, np.int64)
    size = 2 if int(d.max()) < 1 << 16 else 4  # bytes to unpack
    bits = np.unpackbits(d.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width]
    return HEAD.pack(least, len(d), width, len(high)) + np.packbits(bits, bitorder="little").tobytes() + high.astype("<u2").tobytes() + d[high].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    least, n, width, odd = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    full = 16 if width <= 16 else 32
    bits = np.zeros((n, full), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    d = np.packbits(bits, axis=1, bitorder="little").view(f"<u{full // 8}").reshape(-1).astype(np.uint32)
    d[np.frombuffer(data, "<u2", odd, at + size)] = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
    return d + np.uint32(least)


def pack(docs: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents (rows of id, NULL_ID for null, and number of token ids) whose ids stand one after another."""
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks[:-1])]).astype("<i8")[: len(blocks)]
    return MAGIC + np.array([len(docs), len(ids), len(blocks)], "<i8").tobytes() + docs.astype("<i8").tobytes() + starts.tobytes() + b"".join(blocks)


@dataclass(frozen=True)
class TokenFile:
    """Random access to a packed file: the index says which blocks hold a document."""

    data: bytes

    def _head(self) -> tuple[int, int, int]:
        if self.data[:8] != MAGIC:
            raise ValueError("not a token file")
        return tuple(np.frombuffer(self.data, "<i8", 3, 8).tolist())

    def documents(self) -> np.ndarray:
        return np.frombuffer(self.data, "<i8", 2 * self._head()[0], 32).reshape(-1, 2)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids at places begin to end (exclusive): only the blocks that hold them are unpacked."""
        docs, _, blocks = self._head()
        index = np.frombuffer(self.data, "<i8", blocks, 32 + 16 * docs)
        base = 32 + 16 * docs + 8 * blocks
        first = begin // BLOCK
        parts = [unpack_block(self.data, base + int(index[b])) for b in range(first, -(-end // BLOCK))]
        return np.concatenate([np.zeros(0, np.uint32), *parts])[begin - first * BLOCK : end - first * BLOCK]


#: The pattern of the tokenizer's pre-tokenizer. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The parts of a tokenizer file for which words may be encoded one by one, and plain words piece by piece. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of these characters need no normalising but lower-casing; * and / of Latin-1 (U+00D7, U+00F7) aren't letters.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: What PATTERN is for lower-cased words of such characters, and the line feed between words.
PIECE = re.compile(PATTERN.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9") + r"|\n")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pool:
    """Words and their places in one array of token ids. What is missing is encoded by encode(words), which gives the ids
    one after another and each word's number. A full pool becomes the old one, from which what is still used is taken over."""

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.old = self.place, self.ids, self.begin, self.size

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def places(self, words: list[str]) -> np.ndarray:
        """The places of distinct words. They hold until the next call."""
        if len(self.place) >= self.most:
            self.old = self.place, self.ids, self.begin, self.size
            self.place = {}
            self.ids, self.begin, self.size = self.ids[:0], self.begin[:0], self.size[:0]
        missing = [w for w in words if w not in self.place]
        old, ids, begin, size = self.old
        if known := [w for w in missing if w in old]:
            at = np.fromiter(map(old.__getitem__, known), np.int64, len(known))
            self.add(known, *gathered(ids, begin, size, at))
            missing = [w for w in missing if w not in old]
        if missing:
            self.add(missing, *self.encode(missing))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places, one after another, and each word's number of ids."""
        return gathered(self.ids, self.begin, self.size, places)


def gathered(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = size[places]
    at = np.repeat(begin[places] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return ids[at], n


class Words:
    """Encodes texts by a tokenizer file.

    If the file's normalizer and pre-tokenizer are those above, white space is dropped: each run without ASCII white space
    is encoded once and cached, which gives the same ids as encoding the whole text. Runs of plain characters are cut into
    pieces, and each distinct piece goes to the tokenizer's model; others, and added tokens, to the whole tokenizer. With
    any other file each whole text goes to the tokenizer.
    """

    def __init__(self, path: str, end: int = 1):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and not parts["model"].get("dropout")
        # a word that may hold one of these goes to the tokenizer whole
        added = [a for a in parts["added_tokens"] if a["content"]]
        self.by_words &= not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"]) for a in added)
        self.added = [a["content"] for a in added]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces = TwoGenerations(self.piece, 200_000)
        self.pool, self.end = Pool(self.words), end

    def piece(self, text: str) -> bytes:
        if text == "\n":
            return b""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and their numbers. Plain words are cut into pieces all at once."""
        ok = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words)) if words else np.zeros(0, bool)
        if any(a in "\n".join(words) for a in self.added):
            ok &= np.fromiter((not any(a in w for a in self.added) for w in words), bool, len(words))
        plain = [w for w, x in zip(words, ok, strict=True) if x]
        found = PIECE.findall("\n".join([*plain, ""]).lower())
        parts = list(map(self.pieces.__getitem__, found))
        sums = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        ends = np.nonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))[0]
        size = np.zeros(len(words), np.int64)
        size[ok] = np.diff(sums[ends], prepend=0)
        out = [b"".join(parts)]
        if len(plain) < len(words):  # the others are put between them
            others = [self.whole(w) for w, x in zip(words, ok, strict=True) if not x]
            size[~ok] = list(map(len, others))
            mine, cuts = iter(others), zip(np.concatenate([[0], sums[ends[:-1]]]).tolist(), sums[ends].tolist(), strict=True)
            out = [out[0][slice(*next(cuts))] if x else next(mine) for x in ok.tolist()]
        return np.frombuffer(b"".join(out), "<u4"), size // 4

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, each with the end id, one after another, and their numbers."""
        if not self.by_words:
            parts = [self.whole(t) + self.end.to_bytes(4, "little") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        words = pc.ascii_split_whitespace(texts)  # by the six separators; empty words have no ids
        flat = words.flatten().dictionary_encode()
        places = self.pool.places(flat.dictionary.to_pylist())
        ids, n = self.pool.gather(places[flat.indices.to_numpy()])
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(words.value_lengths().to_numpy())
        size = np.diff(sums[ends], prepend=0) + 1
        out = np.full(len(ids) + len(texts), self.end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(size) - 1] = False
        out[inner] = ids
        return out, size


def groups(texts: pa.StringArray, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_words: dict[tuple[str, int], Words] = {}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_files(docs: DataFrame, path: str, folder: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes token files under folder, in ascending id order over the files (nulls first), and returns a row for each:
    (part, path, documents, ids). The end id is appended to each document; null texts are empty ones.

    Texts are dealt by ranges of ids, so no file depends on another; a file is written under a name of its own attempt
    and then moved, so that a repeated task leaves one whole file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # repeated ids are dealt by their text's hash too, so that one id can't fill a task
    rows = rows.repartitionByRange(*([files] if files else []), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        if (path, end) not in _words:
            _words[path, end] = Words(path, end)
        w = _words[path, end]
        docs, ids, part, n, count = [], [], None, 0, 0
        attempt = uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            nonlocal docs, ids, n, count
            fs, root = file_system(folder)
            fs.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{count:04d}.lptok"
            table = np.concatenate(docs)
            with fs.open_output_stream(f"{root}/{name}.{attempt}") as f:
                f.write(pack(table, np.concatenate(ids)))
            fs.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"part": [part], "piece": [count], "path": [f"{folder}/{name}"], "documents": [len(table)], "ids": [n]}, pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))
            docs, ids, n, count = [], [], 0, count + 1
            return out

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            texts, keys = b.column("text"), b.column("id").fill_null(NULL_ID).to_numpy()
            for lo, hi in groups(texts):
                x, sizes = w.encode(texts.slice(lo, hi - lo))
                docs.append(np.stack([keys[lo:hi], sizes], axis=1))
                ids.append(x)
                n += len(x)
                if n >= MOST_IDS:
                    yield close()
        if docs:
            yield close()

    return rows.mapInArrow(run, "part int, piece int, path string, documents long, ids long")


#: Ids in one file at most (but for the texts encoded last): what a task holds of its output. Parts summed together.
MOST_IDS, PARTS = 8_000_000, 1024


def read_files(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in files (as write_files returns them, written): start is the
    number of ids in the documents before it, over all files."""
    # a prefix sum in three levels: over a part's pieces, over PARTS parts, and over the sums of these
    parts = files.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("many", F.floor(F.col("part") / PARTS))
    many = parts.groupBy("many").agg(F.sum("n").alias("m"))
    before = lambda c, order, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = many.select("many", before("m", "many").alias("m_before"))
    parts = parts.select("part", "many", before("n", "part", "many").alias("n_before")).join(many, "many")
    start = F.col("m_before") + F.col("n_before") + before("ids", "piece", "part")
    todo = files.join(parts, "part").select("path", start.alias("start")).repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_stream(name) as f:
                    t = TokenFile(f.read())
                docs = t.documents()
                at = np.concatenate([[0], np.cumsum(docs[:, 1])]).astype(np.int64)
                crc = []
                for lo in range(0, len(docs), 512):  # some documents at a time
                    hi = min(lo + 512, len(docs))
                    ids = t.ids(int(at[lo]), int(at[hi])).astype("<u4")
                    crc += [zlib.crc32(ids[at[k] - at[lo] : at[k + 1] - at[lo]].tobytes()) for k in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0], mask=docs[:, 0] == NULL_ID), pa.array(at[:-1] + start), pa.array(docs[:, 1].copy()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs, writes the files to the shared folder and reads them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_files(written(write_files(docs, path, folder, end, id_col, text_col), "token-files"))

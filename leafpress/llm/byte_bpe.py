"""Byte-level BPE encoding and decoding, with pre-tokenisation by array scans instead of a regular expression.

A text becomes an array of code-point classes. Each position's symbol (its class, and for white space and apostrophes
what follows) is a transition function over eight states; composing functions is associative, so blocks of positions are
reduced side by side, their functions are scanned, and a second pass over the blocks yields every position's state and
with it the starts of the pieces. Each distinct piece is merged once and cached.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import TwoGenerations

#: Code points in one scan, and in one block of it.
SCAN, BLOCK = 1 << 19, 128
OTHER, LETTER, NUMBER, SPACE, GAP, APOSTROPHE = range(6)
#: Symbols: GAP is white space that ends no gap, LAST_SPACE and LAST_GAP end one before other text; ONE and TWO are
#: apostrophes with a contraction's one or two letters after them; END comes after each document.
LAST_SPACE, LAST_GAP, ONE, TWO, END = SPACE, 5, 6, 7, 8
#: States: what the piece that the last position belongs to can still take.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)


def _joins(first: str, points: list[int]) -> list[int]:
    """Those of points (above 0x7F) that tiktoken's pattern engine puts into one piece with first: only then do the two merge."""
    ranks = {bytes([b]): b for b in range(256)} | {first.encode() + bytes([b]): 128 + b for b in range(0x80, 0x100)}
    e = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
    return [c for c in points if e.encode_ordinary(first + chr(c))[0] >= 256]


@cache
def classes() -> np.ndarray:
    """The class of each code point, by Unicode category and White_Space.

    Code points that Python's Unicode tables don't know yet are classed as tiktoken's engine does, whose tables are newer.
    """
    kind = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8).reshape(-1, 2)
    out = np.zeros(0x110000, np.uint8)
    out[kind[:, 0] == ord("L")] = LETTER
    out[kind[:, 0] == ord("N")] = NUMBER
    unknown = np.nonzero((kind == list(b"Cn")).all(1))[0]
    unknown = unknown[(unknown < 0x40000) & (unknown >= 0x80)].tolist()  # later planes hold no letters or numbers
    out[_joins("a", unknown)] = LETTER
    out[_joins("1", unknown)] = NUMBER
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = GAP
    out[ord(" ")], out[ord("'")] = SPACE, APOSTROPHE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """By symbol and state: the next state, and whether a piece starts here."""
    after, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    for symbol, own in ((OTHER, IN_OTHERS), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS)):
        after[symbol] = own
        start[symbol, [own, AFTER_SPACE]] = 0
    after[LETTER, [ONE_MORE, TWO_MORE]], start[LETTER, [ONE_MORE, TWO_MORE]] = (FRESH, ONE_MORE), 0
    after[GAP] = IN_GAP
    start[GAP, IN_GAP] = 0
    after[LAST_SPACE], after[LAST_GAP], after[END] = AFTER_SPACE, FRESH, FRESH
    for symbol, more in ((ONE, ONE_MORE), (TWO, TWO_MORE)):
        after[symbol] = more
        after[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        start[symbol, [IN_OTHERS, AFTER_SPACE]] = 0
    return after, start


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ends marks the places after documents. The last two get no look-ahead."""
    kind = classes()[points]
    blank = ((kind == SPACE) | (kind == GAP)) & ~ends
    out = np.where(kind == APOSTROPHE, OTHER, kind).astype(np.uint8)
    filled = np.zeros(len(points), bool)
    filled[:-1] = ~blank[1:] & ~ends[1:]
    out[blank & ~filled] = GAP
    out[blank & filled & (kind == GAP)] = LAST_GAP
    at = np.nonzero((kind == APOSTROPHE) & ~ends)[0]
    at = at[at < len(points) - 2]
    if len(at):
        a, b = points[at + 1], points[at + 2]
        a, b = np.where(ends[at + 1], 0, a), np.where(ends[at + 1] | ends[at + 2], 0, b)
        out[at[np.isin(a, [*map(ord, "stmd")])]] = ONE
        pair = a.astype(np.uint64) << np.uint64(32) | b
        out[at[np.isin(pair, np.array([ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")], np.uint64))]] = TWO
    out[ends] = END
    return out


def scan(syms: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(whether a piece starts at each symbol, the state at the end), from the state before the first one."""
    after, start = automaton()
    n = len(syms)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, END, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    flat = after.reshape(-1)
    for row in grid:  # each block's function
        whole = flat[(row[:, None].astype(np.intp) << 3) + whole]
    step = 1
    while step < blocks:  # inclusive scan of the functions
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    now = np.concatenate([[state], whole[:-1, state]]).astype(np.intp) if blocks else np.zeros(0, np.intp)
    marks = np.empty((BLOCK, blocks), np.uint8)
    begins = start.reshape(-1)
    last = state
    for i, row in enumerate(grid):
        at = (row.astype(np.intp) << 3) + now
        marks[i], now = begins[at], flat[at].astype(np.intp)
        if blocks and i == (n - 1) % BLOCK:
            last = int(now[-1])
    return marks.T.reshape(-1)[:n].astype(bool), last


def pieces(texts: list[str]) -> list[list[bytes]]:
    """The pieces of each text, as UTF-8. Texts are scanned together, SCAN code points at a time."""
    joined = "\0".join(texts) + "\0"
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    out: list[list[bytes]] = [[] for _ in texts]
    state, doc, open_piece = FRESH, 0, b""
    for at in range(0, len(joined), SCAN):
        points = np.frombuffer(joined[at : at + SCAN + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        here = min(SCAN, len(joined) - at)
        mine = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(points))] - at
        is_end = np.zeros(len(points), bool)
        is_end[mine] = True
        syms = symbols(points, is_end)
        starts, state = scan(syms[:here], state)
        points = points[:here]
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = joined[at : at + here].encode("utf-8", "surrogatepass")
        first = np.nonzero(starts)[0]
        cuts = offset[first].tolist()
        # what lies before the first start belongs to the piece that the scan before left open
        open_piece += data[: cuts[0] if cuts else len(data)]
        found = [open_piece, *(data[a:b] for a, b in zip(cuts, cuts[1:]))]
        if not cuts:
            continue
        open_piece = data[cuts[-1] :]
        stops = np.searchsorted(first, mine[mine < here]) + 1  # places of the END pieces in found; their starts are always set
        begin = 0
        for stop in stops.tolist():
            out[doc] += found[begin:stop] if begin or found[0] else found[1:stop]
            begin, doc = stop + 1, doc + 1
        if doc < len(out) and begin < len(found):
            out[doc] += found[begin:] if begin or found[0] else found[1:]
        if stops.size and stops[-1] == len(found):  # the END piece is the open one
            open_piece = b""
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of a piece: of all adjacent pairs the one of least rank, leftmost first, is merged until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) <= 64:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks)
        order = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while order and (least := min(order)) < none:
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(order):
                order[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)
    # long pieces: a heap of pairs over a linked list, n log n
    end = list(range(1, len(piece) + 1))
    before = list(range(-1, len(piece) - 1))
    heap = [(r, i, i + 2) for i in range(len(piece) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * len(piece)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else len(piece)
        if j >= len(piece) or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < len(piece):
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(len(piece)) if alive[i])


class Codec:
    """Encoder and decoder for a file of ranks (base64 token and rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.names = {i: str(i).encode() for i in self.tokens}
        # all tokens one after another, for decoding: where each begins, and its bytes
        self.size = np.zeros(max(self.tokens, default=-1) + 1, np.int64)
        self.size[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.begin = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)
        self.cache = TwoGenerations(lambda piece: merge(piece, self.ranks))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(map(self.cache.__getitem__, p))) for p in pieces(texts)]

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each token starts in the UTF-8 text."""
        n = self.size[np.asarray(ids, np.int64)]
        return np.cumsum(n) - n

    def decode(self, ids: list[int], offsets: np.ndarray) -> bytes:
        """The bytes of tokens, each put at its offset. Any run of a text's tokens with their offsets gives its bytes."""
        ids, offsets = np.asarray(ids, np.int64), np.asarray(offsets, np.int64)
        if not len(ids):
            return b""
        at = np.repeat(self.begin[ids] - offsets, self.size[ids])
        at += np.arange(offsets[0], offsets[0] + len(at))
        return self.table[at].tobytes()

    def name(self, ids: list[int]) -> bytes:
        """The ids as decimal text, joined by one space."""
        return b" ".join(map(self.names.__getitem__, ids))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def runs(texts: list[str], chars: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(position, texts) of runs of texts of about so many characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_tokens, ids with the byte offset of each token, and decoded_sha256, the SHA-256 of
    the bytes that decoding the ids by their offsets gives.

    digests: instead of ids and offsets, the SHA-256 of the ids (decimal, joined by one space). Null and empty texts have no tokens. Nothing is shuffled; a worker holds one Arrow batch and
    a cache of bounded size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for at, part in runs(texts):
                ids = c.encode(part)
                n = pa.array([len(x) for x in ids], pa.int64())
                offsets = list(map(c.offsets, ids))
                decoded = pa.array([hashlib.sha256(c.decode(x, o)).hexdigest() for x, o in zip(ids, offsets, strict=True)], pa.string())
                if digests:
                    more, names = [pa.array([hashlib.sha256(c.name(x)).hexdigest() for x in ids], pa.string()), decoded], ["ids_sha256", "decoded_sha256"]
                else:
                    more, names = [pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64())), decoded], ["ids", "offsets", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(part)), n, *more], ["id", "n_tokens", *names])

    return rows.mapInArrow(run, "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, offsets array<long>, decoded_sha256 string"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows with id, ids and offsets (of a whole text or a run of its tokens); bytes that are no UTF-8 become
    U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = zip(b.column("ids").to_pylist(), b.column("offsets").to_pylist(), strict=True)
            texts = [c.decode(x or [], o or []).decode("utf-8", "replace") for x, o in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return tokens.select("id", "ids", "offsets").mapInArrow(run, "id long, text string")

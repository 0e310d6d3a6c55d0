"""Nearest neighbours by a block matrix join: int8 product tiles bound the distances, survivors are recomputed in double.

Only int8 blocks and pairs of ids meet every block; the vectors themselves are joined to the pairs that survive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.common import written

#: Rows in a block of queries or candidates, and in one tile of the product.
QUERIES, CANDIDATES, TILE = 4096, 16384, 512
#: Blocks of candidates that one task compares with a block of queries, one after another.
STRIP = 64
#: The most components of a block, about: 16 MB of doubles while it is packed.
COMPONENTS = 1 << 21
#: Room for rounding in the bounds, far above that of float32 products of integers below 2**24 and of the norms.
SLACK = 1e-5
BLOCK_SCHEMA = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary())])
BLOCK_COLUMNS = "block int, dims int, ids binary, rows binary, scales binary, errors binary"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scale and the length of what rounding took away, of unit rows."""
    scale = np.abs(v).max(1, initial=0) / 127.0
    q = np.rint(v / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(v - q * scale[:, None], axis=1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double, each sum from left to right."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def distinct(ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of at most `most` rows of each distinct vector, those with the smallest ids: copies beyond can't be among the nearest."""
    order = np.argsort(ids, kind="stable")
    bits = np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
    _, group = np.unique(bits, return_inverse=True)
    by = np.argsort(group, kind="stable")
    g = group[by]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[by[rank < most]]


class Block:
    """Quantised rows of a block: ids, int8 rows, their scales and errors."""

    def __init__(self, dims: int, ids: bytes, rows: bytes, scales: bytes, errors: bytes):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int8).reshape(-1, dims)
        self.scales, self.errors = np.frombuffer(scales), np.frombuffer(errors)


def survivors(q: Block, c: Block, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of candidates, least cosine, largest cosine) of the pairs, tile by tile, that may be among
    the k nearest. floor holds the k largest least cosines of each query so far, and is brought up to date."""
    for at in range(0, len(c.ids), TILE):
        s = slice(at, at + TILE)
        about = np.zeros((len(q.ids), len(c.ids[s])))
        for d in range(0, q.rows.shape[1], 1024):  # integer products below 2**24 are exact in float32
            about += q.rows[:, d : d + 1024].astype(np.float32) @ c.rows[s, d : d + 1024].astype(np.float32).T
        about *= q.scales[:, None] * c.scales[s]
        about[q.ids[:, None] == c.ids[s]] = -np.inf
        error = q.errors[:, None] + c.errors[s] + q.errors[:, None] * c.errors[s] + SLACK
        floor[:] = np.partition(np.concatenate([floor, about - error], axis=1), -k, axis=1)[:, -k:]
        i, j = np.nonzero((about + error >= floor.min(1)[:, None]) & (about > -np.inf))
        yield i, j + at, (about - error)[i, j], (about + error)[i, j]


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dims, v): the vectors that take part: not null, empty or all zero, without null or non-finite components, with an
    id. Of rows of one id and length the first by components stays; they are combined before they are shuffled."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(ok, v).alias("v")).filter(F.col("v").isNotNull())
    return rows.groupBy("id", F.size("v").alias("dims")).agg(F.min("v").alias("v"))


def _blocks(df: DataFrame, rows: int, copies: int | None = None) -> tuple[DataFrame, int]:
    """Rows of df (clean, written) dealt to blocks of about so many (fewer of long vectors) by their id's hash, each quantised and packed into one row,
    with so many copies of a vector at most; the number of blocks."""
    count, size = df.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    n = max(1, -(-count // rows), -(-size // COMPONENTS))
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
        ids = table.column("id").to_numpy().astype(np.int64)
        v = v.reshape(len(ids), -1)
        order = np.argsort(ids) if copies is None else distinct(ids, v, copies)
        unit = v[order] / np.abs(v[order]).max(1)[:, None]  # lengths that neither overflow nor vanish
        q, scales, errors = quantised(unit / np.linalg.norm(unit, axis=1)[:, None])
        parts = [ids[order], q, scales, errors]
        return pa.table([[key[0].as_py()], [key[1].as_py()], *([np.ascontiguousarray(x).tobytes()] for x in parts)], schema=BLOCK_SCHEMA)

    return dealt.groupBy("block", "dims").applyInArrow(pack, BLOCK_COLUMNS), n


def _pairs(qb: DataFrame, n: int, cb: DataFrame, m: int, k: int) -> DataFrame:
    """(dims, query_id, id, least, largest): the pairs of every two blocks that survive the bounds known to their task."""
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    strips = -(-m // STRIP)
    left = qb.select(F.col("block").alias("q"), every(strips).alias("strip"), "dims", F.lit(-1).alias("c"), "ids", "rows", "scales", "errors")
    right = cb.select(every(n).alias("q"), F.floor(F.col("block") / STRIP).cast("int").alias("strip"), "dims", F.col("block").alias("c"), "ids", "rows", "scales", "errors")
    strip = ["q", "strip", "dims"]
    dealt = left.union(right).repartition(*strip).sortWithinPartitions(*strip, "c")  # a strip's queries come first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, floor = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                x = {name: b.column(name)[r].as_py() for name in b.schema.names}
                given = Block(x["dims"], x["ids"], x["rows"], x["scales"], x["errors"])
                if x["c"] < 0:
                    now, block, floor = (x["q"], x["strip"], x["dims"]), given, np.full((len(given.ids), k), -np.inf)
                elif now == (x["q"], x["strip"], x["dims"]):  # else no query has this length
                    for i, j, least, largest in survivors(block, given, floor, k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), x["dims"], np.int32)), pa.array(block.ids[i]), pa.array(given.ids[j]), pa.array(least), pa.array(largest)], ["dims", "query_id", "id", "least", "largest"])

    return dealt.mapInArrow(run, "dims int, query_id long, id long, least double, largest double")


def _bounded(pairs: DataFrame, k: int) -> DataFrame:
    """pairs (written) whose largest cosine reaches the k-th largest least cosine of their query."""
    own = W.partitionBy("query_id", "dims")
    top = pairs.withColumn("place", F.row_number().over(own.orderBy(F.desc("least")))).filter(F.col("place") <= k)
    floor = top.groupBy("query_id", "dims").agg(F.when(F.count("*") == k, F.min("least")).otherwise(float("-inf")).alias("floor"))
    return pairs.join(floor, ["query_id", "dims"]).filter(F.col("largest") >= F.col("floor")).select("query_id", "dims", "id")


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of pairs (query_id, id, qv, cv) with the cosine in double, a batch's k best of each query by heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qi, ci = b.column("query_id").to_numpy(), b.column("id").to_numpy()
            scores = np.empty(len(qi))
            vectors = lambda name, rows: b.column(name).take(pa.array(rows)).flatten().to_numpy()  # noqa: B023, E731
            sizes = b.column("qv").value_lengths().to_numpy()
            for dims in np.unique(sizes):
                rows = np.nonzero(sizes == dims)[0]
                scores[rows] = cosine(vectors("qv", rows).reshape(-1, dims), vectors("cv", rows).reshape(-1, dims))
            heaps: dict[int, list[tuple[float, int]]] = {}
            for i, score, j in zip(qi.tolist(), scores.tolist(), ci.tolist(), strict=True):
                h = heaps.setdefault(i, [])
                if len(h) < k:
                    heapq.heappush(h, (score, -j))
                elif (score, -j) > h[0]:
                    heapq.heapreplace(h, (score, -j))
            best = [(i, -j, score) for i, h in heaps.items() for score, j in h]
            cols = list(zip(*best, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "id", "score"])

    return pairs.select("query_id", "id", "qv", "cv").mapInArrow(run, "query_id long, id long, score double")


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k (at least 1) nearest candidates by cosine (double, on the vectors given), its
    own id left out; ties to the smaller id. Exact: the int8 bounds only drop pairs that can't be among the nearest.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another length
    than the query's. Rows that repeat an id (with vectors of one length) count as one, the first by components. An id with
    vectors of several lengths is a query, or a candidate, of each. A task meets one block of queries with a strip of blocks
    of candidates, and holds one of either; the k-th largest lower bound rises as it goes. Pairs below the k-th of all
    strips go, the rest are joined with the vectors by id.
    """
    qs = written(clean(queries, id_col, vec_col), "ann-queries")
    cs = written(clean(candidates, id_col, vec_col), "ann-candidates")
    qb, n = _blocks(qs, QUERIES)
    cb, m = _blocks(cs, CANDIDATES, k + 1)  # the query itself may be among the copies
    pairs = _pairs(written(qb, "ann-query-blocks"), n, written(cb, "ann-candidate-blocks"), m, k)
    pairs = _bounded(written(pairs, "ann-pairs"), k)
    pairs = pairs.join(cs.withColumnRenamed("v", "cv"), ["id", "dims"])
    pairs = pairs.join(qs.select(F.col("id").alias("query_id"), "dims", F.col("v").alias("qv")), ["query_id", "dims"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = _scored(pairs, k).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "id", "score")

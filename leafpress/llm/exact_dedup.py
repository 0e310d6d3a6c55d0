"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import ROW, small, tagged, without_spaces, written

def _semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows that have a key: broadcast if the keys are few; else a sort-merge join ended by a write, so that Spark can
    split the partition of a hot key (a group of copies may hold a third of all rows) and counts after it combine first."""
    keys = written(keys, "exact-keys")
    if (few := small(keys)) is not keys:
        return rows.join(few, on, "left_semi")
    return written(rows.join(keys, on, "left_semi"), "exact-level")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, all_digests: bool = False) -> DataFrame:
    """One row for each row of docs (see tagged): its tag, id, the id that stays, its group's size, kept, digest.

    Texts are equal when identical without the six separators; a null text counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id (null ids last), then the first row, so that one row of each group
    stays even where rows repeat. Empty texts are equal to one another.

    One scan takes lengths and prefix hashes. Rows that are alone with their length, then alone with length and prefix
    hash, are unique; only the rest go on to the full hash (SHA-256). all_digests: the caller wants the digest of every
    text, so that the first scan takes it and no second one is needed; else only survivors have one, others null.
    Only digests and ids are shuffled, no texts, unless the survivors are too many to broadcast their tags.
    """
    base = docs.select(ROW, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(ROW, "id", F.length("text").alias("chars"), without_spaces(F.col("text")).alias("norm"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    sketch = base.select(ROW, "id", "chars", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), (digest if all_digests else F.lit(None).cast("string")).alias("digest"))
    sketch = written(sketch, "exact-sketch")
    more = F.col("count") > 1
    same_length = _semi(sketch, sketch.groupBy("len").count().filter(more).select("len"), ["len"])
    survivors = _semi(sketch, same_length.groupBy("len", "prefix").count().filter(more).select("len", "prefix"), ["len", "prefix"])
    if not all_digests:
        tags = written(survivors.select(ROW), "exact-survivors")
        full = base.join(small(tags), ROW, "left_semi").select(ROW, digest.alias("digest"))
        sketch = written(sketch.drop("digest").join(full, ROW, "left"), "exact-digests")
        survivors = sketch.filter(F.col("digest").isNotNull())
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col(ROW).alias("row")))
    groups = survivors.groupBy("len", "prefix", "digest").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).filter(F.col("size") > 1)
    groups = written(groups.select("len", "prefix", "digest", "size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "exact-groups")
    on = ["len", "prefix", "digest"]
    joined = sketch.join(small(groups), on, "left")
    kept = F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(True))
    return joined.select(ROW, "id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = tagged(docs)
    gone = written(classes(docs, id_col, text_col).filter(~F.col("kept")).select(ROW), "exact-gone")
    return docs.join(small(gone, tags=True), ROW, "left_anti").drop(ROW)

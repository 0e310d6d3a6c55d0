"""Helpers shared by the training-data operators: written tables, checked broadcasts, text bytes."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words everywhere in this subpackage: space and U+0009 to U+000D. Fixed value.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]

#: The most rows of a narrow table (ids, hashes, counts; under 100 bytes a row) that may be broadcast; of tags of dropped rows.
BROADCAST_ROWS, BROADCAST_TAGS = 200_000, 2_000_000

#: Spark's setting by which an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (unset, as in tests) a local one.

    A local folder serves a local master only; on a cluster tables would be scattered over machines.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/leafpress/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, its lineage is cut, and it outlives lost executors.

    Spark removes the shuffle files of the write when it has ended; without that they stay until the driver's garbage is
    collected. Nothing reads them later: every execution of a plan makes its own.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: The column of tags, and its type: a file's hash and the row's place in it.
ROW, ROW_TYPE = "__row", "struct<f:long,i:long>"
#: Nodes of a plan over one Parquet scan that give each of its rows once at most.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def tagged(docs: DataFrame) -> DataFrame:
    """docs with a tag for each row (column ROW) that is the same in every scan, however the files are split: the Parquet
    file's path (hashed) and the row's place in it. What isn't a plain scan of Parquet files is written first."""
    plan, names = docs._jdf.queryExecution().analyzed(), []
    while True:
        names.append(plan.nodeName())
        if plan.children().size() != 1:
            break
        plan = plan.children().head()
    if ROW_BY_ROW.issuperset(names) and names[-1] == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
        try:
            return docs.withColumn(ROW, F.struct(F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("i")))
        except AnalysisException:  # files of another format
            pass
    return tagged(written(docs, "rows"))


def small(df: DataFrame, tags: bool = False) -> DataFrame:
    """df, marked for broadcast only if it was counted and has at most BROADCAST_ROWS (tags: BROADCAST_TAGS) narrow rows; Spark
    joins any other by shuffle. Pass written tables."""
    return F.broadcast(df) if df.count() <= (BROADCAST_TAGS if tags else BROADCAST_ROWS) else df


def without_spaces(text: Column) -> Column:
    """text without the six separators. Plain byte replacement: about twice as fast as a regular expression."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """The number of words; 0 for null, empty and blank texts."""
    ends = sum(F.when(c.isin(SPACES), 1).otherwise(0) for c in (F.substring(text, 1, 1), F.substring(text, -1, 1)))
    n = F.size(F.split(text, SPACE_CLASS + "+")) - ends
    return F.coalesce(F.when(text != "", F.greatest(n, F.lit(0))), F.lit(0)).cast("long")


def crc_mod(ids: Column, m: int) -> Column:
    """crc32 of the id as decimal text, modulo m."""
    return F.crc32(ids.cast("string").cast("binary")) % m


class TwoGenerations(dict):
    """A bounded cache of computed values: when the young half is full it becomes the old one, so what is still used stays.

    A lookup by cache[key] computes what is missing; values are never None.
    """

    def __init__(self, compute, most: int = 250_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.compute(key)
        self[key] = value
        return value

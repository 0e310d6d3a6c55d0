"""Page sources: a data source over files with a text adapter, and listings.

Reading PDF needs a library that may be absent. An adapter is a callable (bytes, first, last) -> list of page texts; the
default tries the optional libraries in turn and says which are missing. Everything after "pages exist" is plain Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Adapter = Callable[[bytes, int, int | None], list[str]]


class MissingDependency(RuntimeError):
    pass


def default_adapter(content: bytes, first: int, last: int | None) -> list[str]:
    """Layout text by pdfplumber; only if that fails, plain text by pdfminer."""
    import io

    try:
        import pdfplumber
    except ImportError:
        pdfplumber = None
    if pdfplumber is not None:
        try:
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return [p.extract_text(layout=True) or "" for p in pdf.pages[first - 1 : last]]
        except Exception as e:  # the second library may read what the first can't
            failed: Exception | None = e
    else:
        failed = None
    try:
        from pdfminer.high_level import extract_pages
        from pdfminer.layout import LTTextContainer
    except ImportError as e:
        raise failed or MissingDependency("Reading PDF needs `pdfplumber` or `pdfminer.six`.") from e
    pages = extract_pages(io.BytesIO(content), page_numbers=None if last is None else range(first - 1, last))
    return ["".join(x.get_text() for x in p if isinstance(x, LTTextContainer)) for p in pages]


def text_adapter(content: bytes, first: int, last: int | None) -> list[str]:
    """Plain text whose pages are separated by form feeds."""
    return content.decode("utf-8", "replace").split("\f")[first - 1 : last]


def listed(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, size, modified), by lower-cased name. Empty files are listed too: Spark's binaryFile source leaves them out,
    so the folder's listing, of names only, comes from its file system."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = glob.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(glob) or []
    rows = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if not s.isDirectory()]
    out = spark.createDataFrame(rows, "path string, size long, modified long")
    return out.orderBy(F.lower(F.substring_index("path", "/", -1)), "path")


def pages(spark: SparkSession, files: DataFrame, adapter: Adapter = default_adapter, max_pages: int | None = None, workers: int | None = None) -> DataFrame:
    """(doc_id, page_no, text, error) of files (path). A file that can't be read gives one row with its error; an empty
    document has page 1 with an empty text. One file is one task's work at a time; workers: so many tasks."""
    paths = [r.path for r in files.select("path").collect()]  # a listing: names, not contents
    schema = "doc_id string, page_no int, text string, error string"
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = adapter(bytes(content), 1, max_pages) or [""]
                    yield pd.DataFrame({"doc_id": path, "page_no": range(1, len(texts) + 1), "text": texts, "error": None})
                except Exception as e:
                    yield pd.DataFrame({"doc_id": [path], "page_no": [1], "text": [""], "error": [f"{type(e).__name__}: {e}"]})

    found = spark.read.format("binaryFile").load(paths)  # without empty files
    read = found.select("path", "content")
    read = (read.repartition(workers) if workers else read).mapInPandas(run, schema)
    missing = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("doc_id")).join(found.select(F.col("path").alias("doc_id")), "doc_id", "left_anti")
    return read.unionByName(missing.select("doc_id", F.lit(1).alias("page_no"), F.lit("").alias("text"), F.lit("ValueError: empty file").alias("error")))


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, content) of files (path)."""
    paths = [r.path for r in files.select("path").collect()]
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("doc_id"), "content")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.greatest(F.lit(1), F.max("page_no")).alias("page_count"))

"""The conversion as one plan: pages, layout pass, OCR, corrections, Markdown."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from leafpress.functions import text as T
from leafpress.operators import pages as P
from leafpress.plans.options import ConvertOptions

#: A pass over weak pages: (doc_id, page_no) in, (doc_id, page_no, text) out.
Pass = Callable[[DataFrame], DataFrame]


def convert_script(text, target: str):
    """The text in the other Chinese script by OpenCC; keep changes nothing."""
    if target == "keep":
        return text
    try:
        import opencc
    except ImportError as e:
        raise RuntimeError("Script conversion needs `opencc`.") from e
    config = {"hant": "s2t", "hans": "t2s"}[target]

    @F.pandas_udf(ST.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(opencc.OpenCC(config).convert)

    return run(text)


def converted(pages: DataFrame, options: ConvertOptions, layout: Pass | None = None, ocr: Pass | None = None) -> DataFrame:
    """(doc_id, page_no, text, route) of pages (doc_id, page_no, text). Only weak pages reach the passes.

    ocr_mode strict: an OCR pass is needed, and its errors end the job; auto: without a pass the native text stays.
    """
    if options.ocr_mode == "strict" and ocr is None:
        raise RuntimeError("OCR was asked for, but no engine is available.")
    out = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    if options.max_pages:
        out = out.filter(F.col("page_no") <= options.max_pages)
    weak = lambda df: df.filter(T.is_weak(F.col("text"))).select("doc_id", "page_no")
    if layout is not None:
        out = P.layout_merge(out, layout(weak(out))).drop("assisted")
    if options.ocr_mode != "off" and ocr is not None:
        out = P.ocr_merge(out, ocr(weak(out)), options.ocr_engine, options.ocr_layout, options.key_content_fallback)
    else:
        out = out.withColumn("route", F.lit("native"))
    if options.classical_zh_postprocess:
        fixed = P.postprocess(out, list(options.safe_rules), list(options.aggressive_rules))
        out = fixed.select("doc_id", "page_no", "text").join(out.select("doc_id", "page_no", "route"), ["doc_id", "page_no"])
    text = convert_script(T.normalize(F.col("text"), options.ocr_profile), options.zh_script)
    return out.select("doc_id", "page_no", text.alias("text"), "route")


def to_markdown(pages: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """(doc_id, start_page, end_page, markdown)."""
    return P.markdown(pages, options.every, options.restart_numbers)

"""Page-level operators over (doc_id, page_no, text): probes, routing between extraction stages, windows, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.functions import charclass as C
from leafpress.functions import lines as L
from leafpress.functions import text as T

#: Thresholds by engine and layout (the layout's win), the score below which a page is poor, the least
#: score of a page that gives key content, pages probed for text, pages from which a scan is long.
DEFAULTS = {"replacement_margin": 0.08, "noise_threshold": 0.20, "fallback_floor": 0.10}
BY_ENGINE = {"rapidocr": {"replacement_margin": 0.06, "fallback_floor": 0.08}}
BY_LAYOUT = {"vertical": {"replacement_margin": 0.05, "noise_threshold": 0.18}, "horizontal": {"replacement_margin": 0.09}}
LOW_SCORE, KEY_SCORE, PROBED, LONG_SCAN, SPLIT = 0.32, 0.25, 3, 120, 50


def thresholds(engine: str, layout: str, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Default, engine's, then layout's thresholds; overrides must be known keys with values from 0 to 1."""
    out = DEFAULTS | BY_ENGINE.get(engine, {}) | BY_LAYOUT.get(layout, {})
    for k, v in (overrides or {}).items():
        if k not in DEFAULTS or isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
            raise ValueError(f"bad threshold {k}: {v!r}")
        out[k] = float(v)
    return out


def threshold_column(key: str, engine: Column, layout: Column) -> Column:
    """The threshold for columns of engines and layouts."""
    out = F.lit(None).cast("double")
    for names, column in ((BY_LAYOUT, layout), (BY_ENGINE, engine)):
        for name, values in names.items():
            if key in values:
                out = F.coalesce(out, F.when(column == name, values[key]))
    return F.coalesce(out, F.lit(DEFAULTS[key]))


def key_score(layout: str) -> float:
    return max(0.10, min(0.50, KEY_SCORE - 0.02 * (layout == "vertical")))


def complete(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """pages, and an empty page 1 for each document (doc_id) without one."""
    none = documents.select("doc_id").distinct().join(pages.select("doc_id").distinct(), "doc_id", "left_anti")
    return pages.select("doc_id", "page_no", "text").unionByName(none.select("doc_id", F.lit(1).alias("page_no"), F.lit("").alias("text")))


def scan_like(pages: DataFrame, sample: int = PROBED) -> DataFrame:
    """(doc_id, has_text, pages_checked): whether any of the first pages has text."""
    some = C.strip(F.coalesce("text", F.lit(""))) != ""
    return pages.filter(F.col("page_no") <= sample).groupBy("doc_id").agg(F.bool_or(some).alias("has_text"), F.count(F.lit(1)).alias("pages_checked"))


def recommend(probe: DataFrame, page_counts: DataFrame, missing: bool = False) -> DataFrame:
    """(doc_id, strict_ocr, split_preset): OCR for documents without text in the sample, split if they are long."""
    strict = ~F.col("has_text") & F.lit(not missing)
    return probe.join(page_counts, "doc_id").select("doc_id", strict.alias("strict_ocr"), F.when(strict & (F.col("page_count") >= LONG_SCAN), SPLIT).alias("split_preset"))


def scored(pages: DataFrame, text: str = "text", profile: str = "none") -> DataFrame:
    """pages with norm, score, key_lines, weak and low (a page that is blank, weak or scores low)."""
    out = pages.withColumn("norm", T.normalize(F.coalesce(F.col(text), F.lit("")), profile))
    out = out.withColumn("judged", L.judge("norm")).withColumns({"score": F.col("judged.score"), "key_lines": F.col("judged.key_lines")}).drop("judged")
    weak = T.is_weak(F.col("norm"))
    return out.withColumn("weak", weak).withColumn("low", weak | (F.col("score") < LOW_SCORE))


def layout_merge(pages: DataFrame, assist: DataFrame) -> DataFrame:
    """Weak pages take the layout pass's text if that is neither blank nor weak; with assisted. assist: one row a page."""
    other = assist.select("doc_id", "page_no", F.col("text").alias("other"))
    take = T.is_weak(F.coalesce("text", F.lit(""))) & F.coalesce(~T.is_weak(F.col("other")), F.lit(False))
    joined = pages.join(other, ["doc_id", "page_no"], "left").withColumn("assisted", take)
    return joined.withColumn("text", F.when(F.col("assisted"), F.col("other")).otherwise(F.col("text"))).drop("other")


def ocr_merge(pages: DataFrame, ocr: DataFrame, engine: str = "tesseract", layout: str = "auto", key_content: bool = False) -> DataFrame:
    """(doc_id, page_no, text, route): each weak page with an OCR text is replaced (ocr), stood in for by its key lines
    (key_content), or kept.

    A blank page is replaced if the OCR text has a key line or reaches the floor; another if it scores better by the
    margin. Only weak pages are scored: the others pass by.
    """
    t = thresholds(engine, layout)
    base = pages.select("doc_id", "page_no", "text").withColumn("weak", T.is_weak(F.coalesce("text", F.lit(""))))
    pair = base.filter("weak").join(ocr.select("doc_id", "page_no", F.col("text").alias("other")), ["doc_id", "page_no"])
    old, new = scored(pair).select("doc_id", "page_no", "text", "other", F.struct("norm", "score", "low").alias("old")), None
    new = scored(old, "other").withColumn("some", F.size("key_lines") > 0)
    better = F.when(F.col("old.norm") == "", F.col("some") | (F.col("score") >= t["fallback_floor"])).otherwise(F.col("score") >= F.col("old.score") + t["replacement_margin"])
    keys = F.lit(key_content) & F.col("old.low") & (F.col("score") >= key_score(layout)) & F.col("some")
    route = F.when((F.col("norm") != "") & better, "ocr").when(keys, "key_content").otherwise("kept")
    chosen = new.withColumn("route", route).select("doc_id", "page_no", F.col("route").alias("r"), F.when(F.col("route") == "ocr", F.col("other")).when(F.col("route") == "key_content", T.key_content_page(F.col("page_no"), F.col("key_lines"))).alias("replaced"))
    out = base.join(chosen, ["doc_id", "page_no"], "left")
    return out.select("doc_id", "page_no", F.coalesce("replaced", "text").alias("text"), F.coalesce("r", F.lit("native")).alias("route"))


def routing_summary(before: DataFrame, assisted: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, weak_before, weak_after_assist, requested, applied) of each document."""
    weak = lambda: F.count_if(T.is_weak(F.coalesce("text", F.lit(""))))
    a = before.groupBy("doc_id").agg(weak().alias("weak_before"))
    b = assisted.groupBy("doc_id").agg(weak().alias("weak_after_assist"))
    c = merged.groupBy("doc_id").agg(F.count_if(F.col("route") != "native").alias("requested"), F.count_if(F.col("route").isin("ocr", "key_content")).alias("applied"))
    return a.join(b, "doc_id").join(c, "doc_id")


def postprocess(pages: DataFrame, safe: list[tuple[str, str]], aggressive: list[tuple[str, str]]) -> DataFrame:
    """pages with text corrected by the safe rules, and poor pages by the aggressive ones too, then normalised; with
    safe_count, aggressive_count and the first example of each."""
    out = pages.withColumn("s", T.correct(F.coalesce("text", F.lit("")), safe))
    out = scored(out.withColumn("t", F.col("s.text")), "t").withColumn("a", T.correct(F.col("t"), aggressive))
    text = F.when(F.col("low"), F.col("a.text")).otherwise(F.col("t"))
    return out.select("doc_id", "page_no", T.normalize(text).alias("text"), F.col("s.count").alias("safe_count"), F.when(F.col("low"), F.col("a.count")).otherwise(0).alias("aggressive_count"), F.get("s.examples", F.lit(0)).alias("safe_example"), F.when(F.col("low"), F.get("a.examples", F.lit(0))).alias("aggressive_example"))


def postprocess_summary(pages: DataFrame) -> DataFrame:
    """A row for each document: sums of the rules' replacements, and up to three examples pN:a->b in page order."""
    example = lambda c: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("page_no", c)))), lambda x: F.concat(F.lit("p"), x["page_no"].cast("string"), F.lit(":"), x[c])), 1, 3), "|")
    return pages.groupBy("doc_id").agg(F.sum("safe_count").alias("safe_replacements"), F.sum("aggressive_count").alias("aggressive_replacements"), F.count_if(F.col("aggressive_count") > 0).alias("aggressive_pages"), example("safe_example").alias("safe_examples"), example("aggressive_example").alias("aggressive_examples"))


def fixed_windows(page_counts: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, start_page, end_page): windows of size pages over each document's page_count."""
    starts = F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(size)))
    return page_counts.filter(F.col("page_count") > 0).select("doc_id", "page_count", starts.alias("start_page")).select("doc_id", "start_page", F.least(F.col("start_page") + size - 1, F.col("page_count")).alias("end_page"))


def selected_windows(pages: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, start_page, end_page): runs of neighbouring pages (repeats count once), each cut into windows of size pages."""
    once = pages.select("doc_id", "page_no").distinct().withColumn("run", F.col("page_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("page_no")))
    cut = once.withColumn("part", F.floor((F.row_number().over(W.partitionBy("doc_id", "run").orderBy("page_no")) - 1) / size))
    return cut.groupBy("doc_id", "run", "part").agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page")).select("doc_id", "start_page", "end_page")


def chunk_start(page_no: Column, every: int) -> Column:
    return (F.floor((page_no - 1) / every) * every + 1).cast("int")


def chunk_name(base: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_p%04d-%04d.md", base, start, end)


def chunk_base(output: Column) -> Column:
    return F.regexp_replace(output, "(?i)\\.md$", "")


def page_markdown(page_no: Column, text: Column) -> Column:
    body = C.rstrip(F.coalesce(text, F.lit("")))
    return F.concat(F.lit("# Page "), page_no.cast("string"), F.when(body == "", "").otherwise(F.concat(F.lit("\n\n"), body)))


def markdown(pages: DataFrame, every: int | None = None, restart: bool = False) -> DataFrame:
    """(doc_id, start_page, end_page, markdown): each document, or each chunk of so many pages, with its pages in order.

    restart: page numbers begin at 1 in every chunk; file names (chunk_name) keep the document's.
    """
    start = F.lit(1) if every is None else chunk_start(F.col("page_no"), every)
    rows = pages.select("doc_id", "page_no", start.alias("start_page"), "text")
    number = F.col("page_no") - F.col("start_page") + 1 if restart else F.col("page_no")
    parts = F.array_sort(F.collect_list(F.struct("page_no", page_markdown(number, F.col("text")).alias("md"))))
    out = rows.groupBy("doc_id", "start_page").agg(F.max("page_no").alias("end_page"), parts.alias("parts"))
    return out.select("doc_id", "start_page", "end_page", F.concat(F.array_join(F.transform("parts", lambda p: p.md), "\n\n"), F.lit("\n")).alias("markdown"))

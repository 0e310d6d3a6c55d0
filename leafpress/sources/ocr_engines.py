"""OCR engines as adapters: images of pages in, engine output out. What follows (operators.ocr) is plain Spark.

An engine is a callable (image bytes, language, mode) -> TSV text or None. Rasterising is a callable (PDF bytes, page,
dpi) -> image bytes. Both may be absent; then the error says what to install.
"""

from __future__ import annotations

import errno
import importlib.util
import re
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from leafpress.functions.text import TRANSIENT_HINTS
from leafpress.operators import ocr
from leafpress.sources.pdf import MissingDependency

#: Language and page-segmentation mode of each attempt, by layout; waits before another try after errors
#: that may pass, and their numbers; resolutions; the program's arguments.
VERTICAL = (("kor+eng", "5"), ("kor", "5"), ("eng", "5"))
HORIZONTAL = (("kor+eng", "4"), ("kor+eng", "6"), ("kor", "4"), ("eng", "4"))
WAITS, DPI = (0.2, 0.5), {"tesseract": 150, "rapidocr": 220}
PASSING = {errno.EAGAIN, errno.EBUSY, errno.ETIMEDOUT, errno.ECONNRESET, errno.ENOBUFS}
ARGUMENTS = ("--oem", "1", "-c", "preserve_interword_spaces=1", "tsv")

Engine = Callable[[bytes, str, str], str | None]
#: Line engines say (corner points, text, confidence of 0 to 1) of each line.
LineEngine = Callable[[bytes], list[tuple[list[tuple[float, float]], str, float]]]
Raster = Callable[[bytes, int, int], bytes]


def installed_languages() -> set[str]:
    """What the program lists, one name on a line; its heading has spaces."""
    try:
        out = subprocess.run(["tesseract", "--list-langs"], check=True, capture_output=True, text=True).stdout
    except FileNotFoundError as e:
        raise MissingDependency("OCR needs `tesseract-ocr` with `kor` language data.") from e
    return set(re.findall(r"^\S+$", out, re.MULTILINE))


def variants(layout: str, installed: set[str]) -> list[tuple[str, str]]:
    """The layout's attempts whose languages are all installed, in order."""
    return [(lang, psm) for lang, psm in (VERTICAL if layout == "vertical" else HORIZONTAL) if set(lang.split("+")) <= installed]


def tesseract(image: bytes, language: str, psm: str) -> str | None:
    """One call of the program; None if it fails or says nothing."""
    with tempfile.NamedTemporaryFile(suffix=".png") as f:
        f.write(image)
        f.flush()
        try:
            done = subprocess.run(["tesseract", f.name, "stdout", "-l", language, "--psm", psm, *ARGUMENTS], capture_output=True, text=True, encoding="utf-8")
        except FileNotFoundError as e:
            raise MissingDependency("OCR needs `tesseract-ocr` with `kor` language data.") from e
    return done.stdout if done.returncode == 0 and done.stdout.strip() else None


def poppler(content: bytes, page: int, dpi: int) -> bytes:
    try:
        from pdf2image import convert_from_bytes
    except ImportError as e:
        raise MissingDependency("Rasterising needs `pdf2image` and Poppler tools.") from e
    import io

    out = io.BytesIO()
    convert_from_bytes(content, dpi=dpi, first_page=page, last_page=page, grayscale=True, use_pdftocairo=True, timeout=120)[0].save(out, "PNG")
    return out.getvalue()


@cache
def _rapid():
    try:
        from rapidocr_onnxruntime import RapidOCR
    except ImportError as e:
        raise MissingDependency("OCR needs `pdf2image`, `rapidocr_onnxruntime`, and Poppler tools.") from e
    return RapidOCR()


def rapidocr(image: bytes) -> list[tuple[list[tuple[float, float]], str, float]]:
    found, _ = _rapid()(image)
    return [([(float(x), float(y)) for x, y in points], str(text), float(conf)) for points, text, conf in found or ()]


@dataclass
class Engines:
    """Engines by name; an unknown name is an error on the driver, before any task runs."""

    known: dict[str, Engine | LineEngine] = field(default_factory=lambda: {"tesseract": tesseract, "rapidocr": rapidocr})
    by_lines: set[str] = field(default_factory=lambda: {"rapidocr"})

    def register(self, name: str, engine: Engine | LineEngine, by_lines: bool = False) -> None:
        self.known[name] = engine
        (self.by_lines.add if by_lines else self.by_lines.discard)(name)

    def get(self, name: str) -> Engine:
        if name not in self.known:
            raise MissingDependency(f"Unknown OCR engine `{name}`; known: {', '.join(sorted(self.known))}")
        return self.known[name]


ENGINES = Engines()


def may_pass(error: BaseException) -> bool:
    """Whether another try may succeed: by the error's kind, its number or a hint in its message."""
    text = str(error).lower()
    return isinstance(error, TimeoutError) or getattr(error, "errno", None) in PASSING or any(map(text.__contains__, TRANSIENT_HINTS))


def patiently(call: Callable, *args, waits: Iterable[float] = WAITS, sleep: Callable[[float], None] = time.sleep):
    """The call's result. After an error that may pass it is tried again, as often as there are waits."""
    for wait in chain(waits, (None,)):
        try:
            return call(*args)
        except (RuntimeError, OSError) as e:
            if wait is None or not may_pass(e):
                raise
        sleep(wait)


@cache
def _languages() -> frozenset[str]:
    return frozenset(installed_languages())


def recognise(pages: DataFrame, engine: str = "tesseract", layout: str = "auto", raster: Raster = poppler, strict: bool = True, languages: set[str] | None = None) -> DataFrame:
    """(doc_id, page_no, attempt, language, psm, tsv, error) of pages (doc_id, page_no, content: the file's bytes): a row for
    each attempt that said something. strict: an engine's error ends the job; else it is a row with the error."""
    call, dpi = ENGINES.get(engine), DPI.get(engine, 220)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, page, content in zip(b["doc_id"], b["page_no"], b["content"], strict=True):
                try:
                    image = patiently(raster, bytes(content), int(page), dpi)
                    for k, (lang, psm) in enumerate(variants(layout, languages if languages is not None else set(_languages()))):
                        if (tsv := patiently(call, image, lang, psm)) is not None:
                            out.append((doc, page, k, lang, int(psm), tsv, None))
                except Exception as e:
                    if strict:
                        raise
                    out.append((doc, page, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "attempt", "language", "psm", "tsv", "error"]).astype({"psm": "Int32"})

    return pages.select("doc_id", "page_no", "content").mapInPandas(run, "doc_id string, page_no int, attempt int, language string, psm int, tsv string, error string")


def recognise_lines(pages: DataFrame, engine: str = "rapidocr", raster: Raster = poppler, strict: bool = True) -> DataFrame:
    """(doc_id, page_no, line_no, text, conf, points, error) of pages (doc_id, page_no, content) by a line engine."""
    call, dpi = ENGINES.get(engine), DPI.get(engine, 220)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, page, content in zip(b["doc_id"], b["page_no"], b["content"], strict=True):
                try:
                    found = patiently(call, patiently(raster, bytes(content), int(page), dpi))
                    out += [(doc, page, k, text, float(conf), [{"x": float(x), "y": float(y)} for x, y in points], None) for k, (points, text, conf) in enumerate(found)]
                except Exception as e:
                    if strict:
                        raise
                    out.append((doc, page, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "line_no", "text", "conf", "points", "error"])

    return pages.select("doc_id", "page_no", "content").mapInPandas(run, "doc_id string, page_no int, line_no int, text string, conf double, points array<struct<x:double,y:double>>, error string")


def missing(engine: str, raster: Raster = poppler) -> str | None:
    """What must be installed for an engine, or None."""
    needs = []
    if ENGINES.get(engine) is tesseract and not shutil.which("tesseract"):
        needs.append("`tesseract-ocr` with `kor` language data")
    if ENGINES.get(engine) is rapidocr and importlib.util.find_spec("rapidocr_onnxruntime") is None:
        needs.append("`rapidocr_onnxruntime`")
    if raster is poppler and (importlib.util.find_spec("pdf2image") is None or not shutil.which("pdftocairo")):
        needs.append("`pdf2image` and Poppler tools")
    return f"OCR needs {', '.join(needs)}." if needs else None


def ocr_pass(contents: DataFrame, engine: str = "tesseract", layout: str = "auto", raster: Raster = poppler, strict: bool = True, languages: set[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A pass for plans.engine.converted: weak pages (doc_id, page_no) to their OCR texts (doc_id, page_no, text). contents:
    (doc_id, content), the files. Errors end the job if strict; else such pages have no OCR text."""

    def run(weak: DataFrame) -> DataFrame:
        pages = weak.join(contents, "doc_id")
        if engine in ENGINES.by_lines:
            return ocr.read_lines(recognise_lines(pages, engine, raster, strict).filter("error IS NULL"), layout)
        return ocr.read_attempts(recognise(pages, engine, layout, raster, strict, languages).filter("error IS NULL"))

    return run

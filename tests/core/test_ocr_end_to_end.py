"""From images of pages by OCR engines to Markdown."""

import pytest

from leafpress import __main__ as cli
from leafpress.plans.engine import converted, to_markdown
from leafpress.plans.options import ConvertOptions
from leafpress.sources import ocr_engines as E
from leafpress.sources import pdf

HEAD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"


def tsv(lines, conf):
    out = [HEAD]
    for k, text in enumerate(lines):
        for i, w in enumerate(text.split()):
            out.append(f"5\t1\t1\t1\t{k + 1}\t{i + 1}\t{i * 120}\t{k * 30}\t{10 * len(w)}\t20\t{conf}\t{w}")
    return "\n".join(out)


LINES = ["Quarterly report of the northern branch", "Totals are given in thousands", "Signed by the director"]


def engine(image, lang, psm):
    """Reads what the image says; one attempt reads a line badly."""
    if image != b"scan":
        raise ValueError(f"unexpected image {image!r}")
    return tsv(LINES, 70) if lang == "eng" else tsv([LINES[0], "T#t@ls @re g!ven", LINES[2]], 50)


def line_engine(image):
    box = lambda k: [(0, 30 * k), (400, 30 * k), (400, 30 * k + 20), (0, 30 * k + 20)]
    return [(box(1), LINES[1], 0.9), (box(0), LINES[0], 0.95), (box(2), LINES[2], 0.9), (box(2), LINES[2], 0.8), (box(3), "noise", 0.05)]


def pick(content, page, dpi):
    return b"scan" if page == 2 else b"blank"


@pytest.mark.parametrize("name", ["fake-words", "fake-lines"])
def test_weak_pages_take_the_text_read(spark, name):
    E.ENGINES.register("fake-words", engine)
    E.ENGINES.register("fake-lines", line_engine, by_lines=True)
    native = "This page has a text layer of its own, so that nothing is read here."
    pages = spark.createDataFrame([("d", 1, native), ("d", 2, "")], "doc_id string, page_no int, text string")
    contents = spark.createDataFrame([("d", bytearray(b"file"))], "doc_id string, content binary")
    options = ConvertOptions(ocr_mode="strict")
    out = converted(pages, options, ocr=E.ocr_pass(contents, name, raster=pick, languages={"kor", "eng"}))
    assert sorted((r.page_no, r.route) for r in out.collect()) == [(1, "native"), (2, "ocr")]
    md = to_markdown(out, options).first().markdown
    flat = " ".join(md.split())
    assert flat == "# Page 1 " + native + " # Page 2 " + " ".join(LINES)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    E.ENGINES.register("tesseract", engine)
    monkeypatch.setattr(E, "_languages", lambda: frozenset({"eng"}))
    monkeypatch.setitem(cli.RASTERS, "text", pick)
    monkeypatch.setenv("LEAFPRESS_PROFILE", "fast")
    (tmp_path / "c.json").write_text('{"profiles": {"fast": {"workers": 2}}}')
    (tmp_path / "a.txt").write_text("A first page with enough words to be left alone.\f")
    args = ["convert", str(tmp_path / "a.txt"), "-o", str(tmp_path / "out" / "b.md"), "--path", str(tmp_path / "c.json")]
    try:
        assert cli.main([*args, "--ocr", "strict"]) == 0
        assert "Signed by the director" in (tmp_path / "out" / "b.md").read_text()
        assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.md"]
        assert cli.main([args[0], args[1], *args[1:]]) == 2
    finally:
        E.ENGINES.register("tesseract", E.tesseract)
    if E.missing("tesseract"):
        assert cli.main([*args, "--ocr", "strict", "--force"]) == 1 and "tesseract" in capsys.readouterr().err
        assert cli.main([*args, "--ocr", "auto", "--force"]) == 0 and "native text stays" in capsys.readouterr().err


def test_languages_are_listed(monkeypatch):
    class Done:
        stdout = "List of available languages in \"/x/\" (2):\neng\nscript/Latin\n"

    monkeypatch.setattr(E.subprocess, "run", lambda *a, **k: Done)
    assert E.installed_languages() == {"eng", "script/Latin"}


def test_empty_files_and_counts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\fy")
    (tmp_path / "b.txt").write_text("")
    files = pdf.listed(spark, str(tmp_path), "*.txt")
    out = pdf.pages(spark, files, pdf.text_adapter, workers=2)
    assert sorted((r.doc_id[-5:], r.page_no, r.error) for r in out.collect()) == [("a.txt", 1, None), ("a.txt", 2, None), ("b.txt", 1, "ValueError: empty file")]
    assert sorted(r.page_count for r in pdf.page_counts(out).collect()) == [1, 2]

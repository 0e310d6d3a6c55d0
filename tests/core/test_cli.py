"""Command line and OCR adapters."""

import json

import pytest

from leafpress.__main__ import main
from leafpress.sources import ocr_engines as E
from leafpress.sources.pdf import MissingDependency


def test_config_commands(tmp_path, capsys):
    path = str(tmp_path / "c.json")
    assert main(["init", "--path", path]) == 0 and main(["init", "--path", path]) == 1
    assert main(["profile", "set", "fast", "split_every", "7", "--path", path]) == 0
    assert main(["profile", "set", "fast", "workers", "0", "--path", path]) == 2
    assert main(["profile", "use", "fast", "--path", path]) == 0 and main(["profile", "use", "none", "--path", path]) == 2
    capsys.readouterr()
    assert main(["config", "show", "--path", path, "--split-preset", "10"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["split_preset"] == {"value": 10, "source": "cli"} and shown["split_every"]["value"] is None
    assert main(["config", "validate", "--path", path]) == 0
    assert main(["profile", "list", "--path", path]) == 0 and "fast" in capsys.readouterr().out


def test_convert(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("one\ftwo")
    args = ["convert", str(tmp_path / "a.txt"), "--output-dir", str(tmp_path / "out"), "--path", str(tmp_path / "none.json")]
    assert main(args) == 0
    assert (tmp_path / "out" / "a.txt.md").read_text() == "# Page 1\n\none\n\n# Page 2\n\ntwo\n"
    assert main(args) == 1 and main([*args, "--force"]) == 0


def test_engines(spark):
    assert E.variants("vertical", {"eng"}) == [("eng", "5")] and len(E.variants("auto", {"kor", "eng"})) == 4
    with pytest.raises(MissingDependency):
        E.ENGINES.get("nothing")
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("connection reset")
        return "ok"

    assert E.patiently(flaky, sleep=waits.append) == "ok" and waits == [0.2, 0.5]
    with pytest.raises(ValueError):
        E.patiently(lambda: (_ for _ in ()).throw(ValueError("x")))


def test_recognise(spark):
    def fake(image, lang, psm):
        if image == b"bad":
            raise RuntimeError("broken")
        return f"{lang} {psm}" if lang == "eng" else None

    E.ENGINES.register("fake", fake)
    pages = spark.createDataFrame([("d", 1, bytearray(b"x")), ("d", 2, bytearray(b"bad"))], "doc_id string, page_no int, content binary")
    out = E.recognise(pages, "fake", raster=lambda c, p, d: c, strict=False, languages={"eng", "kor"}).collect()
    assert sorted((r.page_no, r.attempt, r.tsv, r.error) for r in out) == [(1, 3, "eng 4", None), (2, 0, None, "RuntimeError: broken")]
    with pytest.raises(Exception, match="broken"):
        E.recognise(pages, "fake", raster=lambda c, p, d: c, languages={"eng"}).collect()

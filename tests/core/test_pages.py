"""Pages, routing, windows, Markdown, files, options, progress and streams."""

import json

import pytest
from pyspark.sql import functions as F

from leafpress.operators import pages as P
from leafpress.operators import progress
from leafpress.plans import engine, options
from leafpress.sources import pdf, sinks
from leafpress.streaming import monitor

GOOD = "The quick brown fox jumps over the lazy dog near the river bank today"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_no int, text string")


def test_markdown(spark):
    df = frame(spark, [("d", 3, "B"), ("d", 1, "A  "), ("d", 2, "")]).repartition(3)
    assert P.markdown(df).first().markdown == "# Page 1\n\nA\n\n# Page 2\n\n# Page 3\n\nB\n"
    two = {r.start_page: r.markdown for r in P.markdown(df, 2, restart=True).collect()}
    assert two == {1: "# Page 1\n\nA\n\n# Page 2\n", 3: "# Page 1\n\nB\n"}


def test_windows(spark):
    df = frame(spark, [("d", p + 1, "") for p in (0, 1, 2, 5, 6, 9, 9)])
    assert sorted((r.start_page, r.end_page) for r in P.selected_windows(df).collect()) == [(1, 2), (3, 3), (6, 7), (10, 10)]
    counts = spark.createDataFrame([("d", 5), ("e", 0)], "doc_id string, page_count int")
    assert sorted((r.start_page, r.end_page) for r in P.fixed_windows(counts).collect()) == [(1, 2), (3, 4), (5, 5)]


def test_routing(spark):
    native = frame(spark, [("d", 1, GOOD), ("d", 2, ""), ("d", 3, "x"), ("d", 4, ""), ("d", 5, "short")])
    ocr = frame(spark, [("d", 1, "other"), ("d", 2, GOOD), ("d", 3, GOOD), ("d", 4, " \n"), ("d", 5, "..")])
    got = {r.page_no: (r.text, r.route) for r in P.ocr_merge(native, ocr).collect()}
    assert got == {1: (GOOD, "native"), 2: (GOOD, "ocr"), 3: (GOOD, "ocr"), 4: ("", "kept"), 5: ("short", "kept")}
    assert P.thresholds("rapidocr", "vertical") == {"replacement_margin": 0.05, "noise_threshold": 0.18, "fallback_floor": 0.08}
    with pytest.raises(ValueError):
        P.thresholds("tesseract", "auto", {"replacement_margin": 2})
    assert P.scan_like(native.filter("page_no = 2")).first().has_text is False


def test_engine(spark):
    native = frame(spark, [("d", 1, GOOD), ("d", 2, None)])
    both = lambda weak: weak.withColumn("text", F.lit(GOOD))
    out = engine.converted(native, options.ConvertOptions(ocr_mode="auto"), ocr=both)
    assert [r.route for r in out.orderBy("page_no").collect()] == ["native", "ocr"]
    with pytest.raises(RuntimeError):
        engine.converted(native, options.ConvertOptions(ocr_mode="strict"))
    fixed = engine.converted(native, options.ConvertOptions(classical_zh_postprocess=True, safe_rules=(("quick", "slow"),)))
    assert "slow" in fixed.orderBy("page_no").first().text


def test_files(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"one\fcafe\xff")
    (tmp_path / "A.pdf").write_bytes(b"")
    (tmp_path / "x.txt").write_text("no")
    files = pdf.listed(spark, f"file://{tmp_path}")
    assert [r.path.rsplit("/")[-1] for r in files.collect()] == ["A.pdf", "b.PDF"]
    pages = pdf.pages(spark, files, pdf.text_adapter)
    got = {(r.doc_id.rsplit("/")[-1], r.page_no): (r.text, r.error is None) for r in pages.collect()}
    assert got == {("b.PDF", 1): ("one", True), ("b.PDF", 2): ("cafe�", True), ("A.pdf", 1): ("", False)}
    assert all("Missing" in r.error for r in pdf.pages(spark, files.filter("size > 0")).collect())
    chunks = sinks.named(engine.to_markdown(pages, options.ConvertOptions(split_every=1)), True)
    out = sinks.write_markdown(chunks, str(tmp_path / "out"))
    assert [p.rsplit("/")[-1] for p in out] == ["A_p0001-0001.md", "b_p0001-0001.md", "b_p0002-0002.md"]
    with pytest.raises(FileExistsError):
        sinks.write_markdown(chunks, str(tmp_path / "out"))
    assert sinks.write_markdown(chunks, str(tmp_path / "out"), force=True) == out
    assert sinks.bundle(out, str(tmp_path / "all.zip"))
    assert "pages_per_second: 2.000" in sinks.performance_report("native", "a.md", 4, {"native": 1.0, "total": 2.0})


def test_options(tmp_path):
    values, source = options.layered({"split_every": 5}, {}, {"split_preset": 10})
    assert (values["split_every"], source["split_every"], values["split_preset"], source["split_preset"]) == (5, "cli", None, "default")
    for bad in ({"split_every": 5, "split_preset": 10},):
        with pytest.raises(options.OptionError):
            options.layered(bad, {}, {})
    for key, value in (("split_preset", 15), ("workers", 0), ("workers", True), ("nothing", 1), ("ocr_mode", "x"), ("force", "maybe"), ("output", " ")):
        with pytest.raises(options.OptionError):
            options.checked(key, value)
    path = tmp_path / "c.json"
    assert options.read_config(path) == {}
    options.write_config(path, {"ocr_engine": "rapidocr", "profiles": {"a": {"workers": "3"}}, "profile": "a"})
    assert options.profile_values(options.read_config(path)) == {"ocr_engine": "rapidocr", "workers": 3}
    path.write_text("[]")
    with pytest.raises(options.OptionError):
        options.read_config(path)
    assert options.env_values(env={"LEAFPRESS_FORCE": "yes"}) == {"force": True}


def test_progress(spark):
    lines = ["Progress: 45% running ocr pages=3", '{"percent":"45%","stage":"x"}', '{"percent":true,"stage":"x"}', '{"percent":7.9,"stage":"y"}', "nothing", '{"percent":3}', "progress: 5 go"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = [r.p and tuple(r.p) for r in df.orderBy("i").select(progress.parse(F.col("x")).alias("p")).collect()]
    assert got == [(45, "running ocr pages=3"), (45, "x"), None, (7, "y"), None, None, (5, "go")]
    t = df.select(progress.stage_tokens(F.lit("ocr current=3 total=10, a=1 A=2")).alias("t"), progress.duration(F.lit(59)).alias("d"), progress.duration(F.lit(3661)).alias("e"), progress.event_line(F.lit(120), F.lit("s"), True).alias("j")).first()
    assert t.t.label == "ocr" and t.t.tokens == {"current": "3", "total": "10", "a": "2"} and (t.d, t.e) == ("00:59", "01:01:01")
    assert json.loads(t.j) == {"percent": 100, "stage": "s"}


def test_rates_batch_and_stream(spark, tmp_path):
    rows = [("r", 0.0, 1.0), ("r", 1.0, 3.0), ("r", 2.0, 4.0), ("r", 3.0, 4.0), ("s", 0.0, 1.0)]
    schema = "run string, seconds double, counter double"
    df = spark.createDataFrame(rows, schema)
    batch = sorted((r.run, r.seconds, r.rate and round(r.rate, 9)) for r in progress.ewma(df, ["run"]).collect())
    assert batch == [("r", 0.0, None), ("r", 1.0, 2.0), ("r", 2.0, 1.65), ("r", 3.0, 1.65), ("s", 0.0, None)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = monitor.rates(stream, ["run"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.run, r.seconds, r.rate if r.rate is None else round(r.rate, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x[:2] for x in got] == [x[:2] for x in batch] and [x[2] for x in got][1:4] == [2.0, 1.65, 1.65]


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    q = monitor.new_files(spark, str(tmp_path / "in")).select("path").writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(*) from files").first()[0] == 1

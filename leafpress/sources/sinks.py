"""Markdown sinks: one file per row, written by its task; reports and bundles."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators.pages import chunk_base, chunk_name


def named(chunks: DataFrame, split: bool, output: str | None = None) -> DataFrame:
    """chunks (doc_id, start_page, end_page, markdown) with name: the document's (or output), or the chunk's with its pages."""
    base = F.regexp_replace(F.substring_index(F.col("doc_id").cast("string"), "/", -1), "(?i)\\.pdf$", "") if output is None else chunk_base(F.lit(output))
    return chunks.withColumn("name", chunk_name(base, F.col("start_page"), F.col("end_page")) if split else F.concat(base, F.lit(".md")))


def write_markdown(chunks: DataFrame, folder: str, force: bool = False) -> list[str]:
    """Writes each row's markdown to folder/name and returns the paths, sorted. No file is replaced unless force. folder: a
    path or URI that all executors share."""
    store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    staging = f"{root}/.staging-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store.create_dir(staging, recursive=True)
        for b in batches:
            places = [f"{staging}/{uuid.uuid4().hex}" for _ in b["name"]]
            for place, text in zip(places, b["markdown"], strict=True):
                with store.open_output_stream(place) as f:
                    f.write(text.encode())
            yield pd.DataFrame({"name": b["name"], "place": places})

    store.create_dir(staging, recursive=True)
    try:
        done = {}  # the conversion runs once: what each task wrote is moved to its name when all is known to be in order
        for r in chunks.select("name", "markdown").mapInPandas(run, "name string, place string").toLocalIterator():
            if r.name in done:
                raise FileExistsError("Two documents have the same output name")
            done[r.name] = r.place
        taken = sorted(n for n in done if store.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound)
        if taken and not force:
            raise FileExistsError(f"Output exists (use force): {', '.join(taken[:3])}")
        for name, place in done.items():
            store.move(place, f"{root}/{name}")
    finally:
        store.delete_dir(staging)
    return sorted(f"{folder}/{name}" for name in done)


def default_output(path: str) -> tuple[str, str]:
    """The folder and name of a document's Markdown where none is given: downloads/NAME/NAME.md."""
    stem = Path(path).stem
    return f"downloads/{stem}", f"{stem}.md"


def bundle(paths: list[str], target: str) -> str:
    """A ZIP of the files, under their own names."""
    if not paths:
        raise ValueError("No chunk files to bundle")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(paths):
            z.write(p, Path(p).name)
    return target


def performance_report(flow: str, target: str, pages: int, stages: dict[str, float]) -> str:
    total = stages.get("total", 0.0)
    rate = pages / total if total > 0 and pages > 0 else 0.0
    rows = [f"- {k}_seconds: {v:.3f}" for k, v in stages.items()]
    return "\n".join([f"# Performance: {flow}", "", f"- target: {target}", f"- pages: {pages}", *rows, f"- pages_per_second: {rate:.3f}", ""])

"""Where results go: JSON lines, CSV, one Markdown file for each node."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each stage of a run."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


WRITTEN = "book_id string, file_name string, status string, error string"


def _put(folder: str, column: str, mode: str, value):
    """Writes one file for each row, beside its place and then moved there; a failure is a row, not an end."""

    def put(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pandas as pd

        for pdf in batches:
            out = []
            for book, name, content in zip(pdf["book_id"], pdf["file_name"], pdf[column]):
                try:
                    at = os.path.join(folder, book, name)
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    part = f"{at}.{uuid.uuid4().hex}"
                    with open(part, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
                        f.write(value(content))
                    os.replace(part, at)
                    out.append((book, name, "written", None))
                except OSError as e:
                    out.append((book, name, "failed", str(e)))
            yield pd.DataFrame(out, columns=["book_id", "file_name", "status", "error"])

    return put


def write_markdown(nodes: DataFrame, folder: str) -> DataFrame:
    """Writes (book_id, file_name, markdown) as files under ``folder`` on a shared file system; returns (book_id, file_name, status, error)."""
    return nodes.select("book_id", "file_name", "markdown").mapInPandas(_put(folder, "markdown", "w", lambda v: v), WRITTEN)


def write_report(report: DataFrame, folder: str, summary: dict[str, int]) -> None:
    """A batch's report: one CSV row and one JSON line for each book, and a JSON object of the totals."""
    write_csv(report, f"{folder}/report_csv")
    write_jsonl(report, f"{folder}/detail")
    report.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes (book_id, pdf_page, image) as PNG files named by page; returns (book_id, file_name, status, error)."""
    named = images.select("book_id", F.format_string("page_%05d.png", F.col("pdf_page").cast("int")).alias("file_name"), "image")
    return named.mapInPandas(_put(folder, "image", "wb", lambda v: bytes(v)), WRITTEN)


#: Fixed value: names of the flat files that an older layout left beside its manifest.
LEGACY_FILE = r"^\d{3}_L\d+_p\d+_.+\.md$"


def legacy_files(files: DataFrame) -> DataFrame:
    """Those of ``files`` (relative) that an older layout left at the top of an export's folder."""
    return files.where(F.substring_index("relative", "/", -1).rlike(LEGACY_FILE) | (F.substring_index("relative", "/", -1) == "manifest.json"))

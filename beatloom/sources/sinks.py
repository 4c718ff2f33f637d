"""Writers for artifacts, reports and ledger tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.functions import scalars as S


def artifact_names(df: DataFrame, suffix: str = ".chart.json") -> DataFrame:
    """Adds ``file_name``: base name, time stamp and the first characters of the workflow.

    ``df``: source_uri, workflow_id, created_at.
    """
    stem = F.regexp_replace(F.substring_index("source_uri", "/", -1), r"\.[^.]*$", "")
    name = F.concat(
        S.chart_base_name(stem), F.lit("--"), S.file_timestamp("created_at"), F.lit("--"),
        F.lower(F.substring(F.col("workflow_id").cast("string"), 1, 6)), F.lit(suffix),
    )
    return df.withColumn("file_name", name)


def write_artifacts(df: DataFrame, root: str, mode: str = "append") -> None:
    """JSON documents by category and workflow.

    ``df``: category, workflow_id, file_name and the document's columns; the name stays a column,
    so many documents share one file.
    """
    keys = ["category", "workflow_id"]
    body = F.to_json(F.struct(*[c for c in df.columns if c not in [*keys, "file_name"]]))
    df.select(*keys, "file_name", body.alias("document")).write.mode(mode).partitionBy(*keys).json(root)


def write_documents(df: DataFrame, root: str) -> int:
    """Every row (name, value) as a file of that name below a shared folder; returns how many.

    Tasks write the files themselves, under a passing name first, so a retried task replaces a file by
    the same content and readers never see half of one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "", 1))
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                passing = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(passing, compression=None) as out:
                    out.write((value or "").encode())
                system.move(passing, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = df.select(F.col("name").cast("string"), F.col("value").cast("string")).mapInArrow(write, "n long")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_report(lines: DataFrame, results: DataFrame, json_path: str, text_path: str) -> None:
    """Report as JSON rows and as ordered text.

    ``lines``: section, sort_key, line. The sort is a range sort, so the files of the text folder
    are in report order.
    """
    results.write.mode("overwrite").json(json_path)
    lines.orderBy("section", "sort_key").select(F.col("line").alias("value")).write.mode("overwrite").text(text_path)


def append_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Append ledger rows."""
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)

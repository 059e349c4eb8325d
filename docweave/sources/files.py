"""File sources and sinks: Markdown and PDF folders, uploads, converters, JSON lines, run records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem

Converter = Callable[[bytes], str]


def markdown_files(spark: SparkSession, folder: str, recursive: bool = False, limit: int | None = None) -> DataFrame:
    """path, stem, text of the Markdown files of a folder, in the order of their paths; `limit` keeps the first ones."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).text(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("stem", file_stem(F.col("path")))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def document_text(spark: SparkSession, path: str) -> str:
    """One file's text; a missing file raises."""
    return spark.read.option("wholetext", True).text(path).first().value


def registered_uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted: path, stem, text; rejected: path, error) of uploaded Markdown, which must be valid UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    base = raw.select("path", "content", valid.alias("valid"))
    good = base.where("valid").select("path", file_stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("text"))
    return good, base.where("not valid").select("path", F.lit("not valid UTF-8").alias("error"))


def _converted(batches: Iterator[pa.RecordBatch], convert: Converter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, errors, digests = [], [], []
        for content in batch.column("content").to_pylist():
            digests.append(hashlib.sha256(content).hexdigest())
            try:
                texts.append(convert(content))
                errors.append(None)
            except Exception as e:  # one bad file must not end the scan
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:500])
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(digests)], names=["path", "size_bytes", "text", "error", "sha256"])


def converted_files(spark: SparkSession, folder: str, pattern: str, convert: Converter, done: DataFrame | None = None) -> DataFrame:
    """path, size_bytes, text, error, sha256 of files converted to Markdown; those whose stem is in `done` are skipped.

    The converter is given, as its libraries are no part of this package; files that fail carry their error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    if done is not None:
        raw = raw.join(done.select("stem").distinct(), file_stem(F.col("path")) == F.col("stem"), "left_anti")
    return raw.select("path", "length", "content").mapInArrow(lambda it: _converted(it, convert), "path string, size_bytes long, text string, error string, sha256 string")


def paged_markdown(pages: DataFrame) -> DataFrame:
    """path, text of page texts (path, page, bands): each page under its marker, pages divided by rules.

    bands: array of struct(top, left, text); tables and text bands of a page stand in the order of (top, left).
    """
    body = F.array_join(F.transform(F.array_sort("bands"), lambda b: b["text"]), "\n\n")
    one = F.struct("page", F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n\n"), body).alias("text"))
    return pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), "\n\n---\n\n").alias("text"))


def table_markdown(cells) -> F.Column:
    """A table (array of rows of cells, nulls allowed) as Markdown; null unless two rows and columns and three cells hold text.

    Rows are padded, columns and rows without text dropped; the first row left is the header.
    """
    clean = F.transform(cells, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>"))))
    rows = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.aggregate(rows, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    columns = F.filter(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.exists(rows, lambda r: F.coalesce(F.get(r, k), F.lit("")) != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda k: F.coalesce(F.get(r, k), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda k: F.lit(" --- ")), "|"), F.lit("|"))
    filled = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: c != "")))
    whole = F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")
    return F.when((F.size(rows) >= 2) & (F.size(columns) >= 2) & (filled >= 3), whole)


def write_jsonl(rows: DataFrame, folder: str) -> int:
    """JSON lines of the rows; the number written."""
    rows.write.mode("overwrite").json(folder)
    return rows.sparkSession.read.text(folder).count()


def run_records(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run records of JSON files with the file's name and its kind, the name up to the first underscore."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("kind", F.regexp_extract("file", r"^([^_.]+)", 1))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: the rows as a Markdown table; nulls become dashes."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    head = F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "---|" * len(columns)))
    return rows.agg(F.array_join(F.concat(head, lines), "\n").alias("table"))


def dual_write(rows: DataFrame, first: str, second: str) -> None:
    """The same rows under two paths, computed once: the second is written from the first."""
    rows.write.mode("overwrite").parquet(first)
    rows.sparkSession.read.parquet(first).write.mode("overwrite").parquet(second)

"""Sources and sinks: uploaded files, page tables, template stores, result envelopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.templates import TEMPLATE_SCHEMA

# --- Fixed values: what is taken in. ---
IMAGES = ("jpg", "jpeg", "png", "tiff", "tif", "bmp")
PDF = "pdf"
MOST_BYTES = 50 * 1024 * 1024
# --- End of fixed values. ---


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, kind, error) of the files under a path.

    kind: pdf, image, text or null. error: why a file is not taken, else null; no file stops the others. Listing and
    reading are Spark's, which passes over files of no bytes; content is only read where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    kind = F.when(ext == PDF, "pdf").when(ext.isin(*IMAGES), "image").when(ext == "txt", "text")
    files = files.select("path", "length", "content").withColumn("kind", kind)
    error = F.when(F.col("length") == 0, "File is empty").when(F.col("length") > MOST_BYTES, "File is too large").when(kind.isNull(), "Unsupported file type")
    return files.withColumn("error", error)


def accepted(uploads: DataFrame) -> DataFrame:
    return uploads.where("error is null")


def rejected(uploads: DataFrame) -> DataFrame:
    return uploads.where("error is not null").drop("content")


def recognize(uploads: DataFrame, engines: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, page_no, text, error): the pages of accepted uploads, by the engine of their kind.

    An engine turns a file's bytes into the texts of its pages. Text files need none: pages end at form feeds. A kind
    without an engine, and a file at which an engine fails, give one row with an error; other files go on.
    """
    engines = {"text": lambda raw: raw.decode("utf-8", "replace").split("\f")} | (engines or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch.path, batch.kind, batch.content, strict=True):
                engine = engines.get(kind)
                try:
                    pages = engine(bytes(content)) if engine else None
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                    continue
                if pages is None:
                    rows.append((path, None, None, f"no engine for {kind}"))
                else:
                    rows += [(path, k, text, None) for k, text in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return accepted(uploads).select("path", "kind", "content").mapInPandas(read, "path string, page_no int, text string, error string")


def best_pass(passes: DataFrame, score: Column) -> DataFrame:
    """Of several recognitions of a page (path, page_no, pass_no, ...) the one that scores most, the first of equals."""
    from docloom.operators.rank import best

    rest = [c for c in passes.columns if c not in ("path", "page_no")]
    return best(passes, ["path", "page_no"], [-score, F.col("pass_no")], rest)


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A page table (doc_id, page_no, source, text) from parquet, orc, json or csv with a fixed schema."""
    reader = spark.read.schema("doc_id long, page_no int, source string, text string")
    return reader.option("header", "true").option("multiLine", "true").load(path, format=format) if format == "csv" else reader.load(path, format=format)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A template store: a folder, or one file, with an array of JSON records; unknown fields are ignored."""
    return spark.read.schema(TEMPLATE_SCHEMA).option("multiLine", "true").json(path)


def write_templates(templates: DataFrame, path: str) -> None:
    """The store written anew as JSON lines, best templates first within a file."""
    templates.sortWithinPartitions(F.desc("quality_score"), "template_id").write.mode("overwrite").json(path)


def envelope(records: DataFrame, name: str, as_of: Column, fields: list[str]) -> DataFrame:
    """(file_name, response): a JSON envelope for each record, with nulls left out of its data."""
    data = F.struct(*[F.col(f) for f in fields])
    ok = F.col("error").isNull() if "error" in records.columns else F.lit(True)
    error = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    body = F.struct(ok.alias("success"), as_of.alias("timestamp"), F.col(name).alias("file_name"), F.when(ok, data).alias("data"), error.alias("error"))
    return records.select(F.col(name).alias("file_name"), F.to_json(body).alias("response"))


def write_records(records: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Records to parquet, orc or json, a folder for each value of partition_by."""
    records.write.mode("overwrite").partitionBy(*partition_by).format(format).save(path)

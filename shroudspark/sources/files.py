"""Files as DataFrames of segments; what can't be read becomes a note."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudspark.operators.scan import page_coverage
from shroudspark.sources.office import READERS

_ROW = "document string, seg_no bigint, locator string, kind string, text string, page int, code string, message string"


class Documents(NamedTuple):
    segments: DataFrame  # document, seg_no, locator, kind, text, page
    notes: DataFrame  # document, code, message
    coverage: DataFrame  # document, page, chars, median, flag
    files: DataFrame  # document, in the order of the paths


def read_documents(spark: SparkSession, path: str) -> Documents:
    """All supported files at or below a path, by their base names, or by their whole paths where a name occurs twice.

    Every file is read in the task that lists it; one that is broken, encrypted or of an
    unknown kind yields a note and no segments, and never stops the others.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.element_at(F.split("path", "/"), -1)
    twice = found.select(base.alias("base")).groupBy("base").count().filter("count > 1").select("base", F.lit(True).alias("twice"))
    named = found.withColumn("base", base).join(twice, "base", "left")
    named = named.select(F.when(F.col("twice"), F.col("path")).otherwise(F.col("base")).alias("document"), "path", "content")
    known = F.lower(F.regexp_extract("document", r"(\.[^.]+)$", 1)).isin(*READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, content in zip(batch["document"], batch["content"]):
                yield pd.DataFrame(list(_rows(document, content)), columns=[c.split()[0] for c in _ROW.split(", ")]).astype({"seg_no": "Int64", "page": "Int32"})

    rows = named.filter(known).select("document", "content").mapInPandas(run, _ROW)
    skipped = named.filter(~known).select("document", F.lit("unsupported").alias("code"), F.lit("skipped: not a supported kind of file").alias("message"))
    segments = rows.filter("code is null and text <> ''").select("document", "seg_no", "locator", "kind", "text", "page")
    notes = rows.filter("code is not null").select("document", "code", "message").unionByName(skipped)
    paged = rows.filter("code is null and page is not null")
    chars = paged.groupBy("document", "page").agg(F.sum(F.when(F.col("kind") != "prose_block", F.length("text")).otherwise(0)).alias("chars"))
    return Documents(segments, notes, page_coverage(chars), named.orderBy("path").select("document"))


def _rows(document: str, content: bytes) -> Iterator[tuple]:
    try:
        found = list(READERS[Path(document).suffix.lower()](bytes(content)))
    except Exception as error:  # noqa: BLE001 - whatever is wrong with one file is told, and is about that file
        yield (document, None, None, None, None, None, "unreadable", f"skipped: {type(error).__name__}")
        return
    for k, s in enumerate(found, 1):
        yield (document, k, s.locator, s.kind, s.text, s.page, None, None)


def known_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list with a name on each line; ``#`` begins a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return lines.filter((F.col("name") != "") & ~F.startswith("name", F.lit("#"))).distinct()


def nearest(start: str, name: str) -> str | None:
    """The path of the file of this name in the folder of ``start`` or the closest one above, then of the working folder."""
    place = Path(start)
    for folder in (place if place.is_dir() else place.parent, Path.cwd()):
        for above in (folder, *folder.parents):
            if (above / name).is_file():
                return str(above / name)
    return None


def manifest(start: str, name: str) -> dict | None:
    """The nearest label manifest; None without one or where it can't be parsed."""
    found = nearest(start, name)
    if found is None:
        return None
    try:
        read = json.loads(Path(found).read_text(encoding="utf-8"))
    except ValueError:
        return None
    return read if isinstance(read, dict) else None


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """Planted items, a JSON object on each line; broken and blank lines are left out."""
    schema = "document string, type string, value string, expected string, note string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def labelled_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, text, spans) of a JSON array of texts with labelled spans."""
    schema = "full_text string, spans array<struct<entity_type:string,start_position:int,end_position:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("record"), F.col("full_text").alias("text"), "spans")


def write_twin(twin: DataFrame, path: str, kind: str = "parquet") -> None:
    twin.write.mode("overwrite").format(kind).save(path)


def write_once(path: str, content: str, force: bool = False) -> bool:
    """Write a file of settings unless it is there; whether it was written."""
    target = Path(path)
    if target.exists() and not force:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content, encoding="utf-8")
    return True


def report_lines(table: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    head = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    body = ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in table.collect()]
    return "\n".join([*head, *body, ""])

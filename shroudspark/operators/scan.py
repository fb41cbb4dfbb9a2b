"""Scanning documents: segments, caps, value-free findings, counts and page coverage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudspark.config import Settings
from shroudspark.functions.text import normalize_ws
from shroudspark.operators.detect import explode_spans, with_spans

SEGMENTS = "document string, seg_no bigint, locator string, kind string, text string"


def line_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-empty lines of texts as prose segments, numbered from 1 as lines are."""
    lines = docs.select(F.col(id_col).cast("string").alias("document"), F.posexplode_outer(F.split(text_col, "\n", -1)).alias("p", "line"))
    rows = lines.select("document", (F.col("p") + 1).cast("bigint").alias("seg_no"), normalize_ws(F.col("line")).alias("text")).filter("text <> ''")
    return rows.select("document", "seg_no", F.concat(F.lit("line "), F.col("seg_no")).alias("locator"), F.lit("prose").alias("kind"), "text")


def capped(segments: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first segments of each document, and a note for each document that has more."""
    order = Window.partitionBy("document").orderBy("seg_no")
    kept = segments.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")
    over = segments.groupBy("document").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    notes = over.select(
        "document", F.lit("capped").alias("code"), F.format_string(f"%d segments; the first {most} were scanned", "n").alias("message")
    )
    return kept, notes


def dedupe_blocks(segments: DataFrame) -> DataFrame:
    """Without the whole-page blocks that repeat lines and cells of the page."""
    return segments.filter("kind <> 'prose_block'")


class Report(NamedTuple):
    summary: DataFrame  # one row: files_found, files_read
    counts: DataFrame  # type, n
    findings: DataFrame  # type, document, location; never a value
    notes: DataFrame  # document, code, message


def findings(segments: DataFrame, settings: Settings = Settings(), known=None, model=None) -> DataFrame:
    """(type, document, location), a row for each span.

    ``known`` adds spans of known names (a function from the text column to an array of
    spans); they are added after the filters and aren't matched against other types.
    """
    found = with_spans(segments, "text", settings, model)
    if known is not None:
        found = found.withColumn("spans", F.concat("spans", known(F.col("text"))))
    return explode_spans(found, "spans", ["document", "locator"]).select(F.col("s.type").alias("type"), "document", F.col("locator").alias("location"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("n")).orderBy("type")


def scan(segments: DataFrame, files: DataFrame | None = None, notes: DataFrame | None = None, settings: Settings = Settings(), known=None, model=None) -> Report:
    """The report on documents given as segments.

    ``files`` (document) are those that were found, else the documents of the segments;
    files without segments get a note.
    """
    kept, over = capped(segments, settings.most_segments)
    found = findings(kept, settings, known, model)
    read = segments.select("document").distinct()
    listed = (files if files is not None else read).select("document").distinct()
    empty = listed.join(read, "document", "left_anti").select("document", F.lit("empty").alias("code"), F.lit("nothing to read").alias("message"))
    summary = listed.agg(F.count("*").alias("files_found")).crossJoin(read.agg(F.count("*").alias("files_read")))
    told = over.unionByName(empty)
    if notes is not None:
        told = told.unionByName(notes)
    return Report(summary, counts(found), found, told.distinct())


def page_coverage(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(document, page, chars, median, flag) of pages given as (document, page, chars).

    The median is that of the document, rounded down; a page without characters is
    ``empty`` and one with less than ``share`` of the median ``sparse``.
    """
    median = F.floor(F.expr("percentile(chars, 0.5) OVER (PARTITION BY document)"))
    flag = F.when(F.col("chars") == 0, "empty").when((F.col("median") > 0) & (F.col("chars") < F.col("median") * share), "sparse").otherwise("")
    return pages.withColumn("median", median).withColumn("flag", flag)


def page_chars(segments: DataFrame) -> DataFrame:
    """(document, page, chars) of segments with a ``page``; whole-page blocks don't count again."""
    return dedupe_blocks(segments).groupBy("document", "page").agg(F.sum(F.length("text")).alias("chars"))

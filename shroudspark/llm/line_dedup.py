"""Line dedup: drop lines that too many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._common import HOT, materialise, same, spread_join, with_text


def normalise_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\n\f]+", " "))


def dedup_lines(
    docs: DataFrame,
    max_docs: int = 10,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop every line whose normal form occurs in more than ``max_docs`` documents.

    Lines are exploded with their positions, normalised (lower case, white space
    collapsed) and hashed, to 96 bits; distinct documents are counted per hash; what is
    left of each document is put together by position.  Hashes, ids and positions are
    written once and only they are shuffled for the counts; texts move once, to meet the
    positions they lose.  Lines that very many documents share aren't shuffled to be
    joined with their counts, which are broadcast: there are fewer than ``HOT`` of them.

    ``keep_first`` leaves the line in the document with the lowest id, so content
    that exists only in shared lines survives once.

    Returns all columns of ``docs`` with the text replaced, and ``n_lines`` and
    ``n_dropped`` (columns of these names are replaced).  Defined cases: a null text
    stays null with 0 lines; lines that are blank after normalising are never
    dropped; a document that loses all lines has the empty text; a line repeated
    within a document counts once; repeated rows with one id count as one document
    and are all cleaned alike; rows with a null id count as one unknown document,
    which ranks before all others; texts and lines of any length are treated whole; an
    empty table stays empty.  Other columns are carried along under any name that
    doesn't begin with ``__line``.
    """
    i, h, p, g, g2, n, w, bad, parts = (f"__line_{x}" for x in ("id", "row", "pos", "hash", "check", "n", "first", "bad", "parts"))
    lines = docs.select(
        F.col(id_col).alias(i),
        F.xxhash64(F.col(text_col)).alias(h),
        # Outer: an inner one infers a filter that splits each text a second time.  Null texts go with the blank lines.
        F.posexplode_outer(F.split(F.col(text_col), "\n", -1)).alias(p, "__line"),
    )
    hashed = (
        lines.withColumn("__line", normalise_line(F.col("__line")))
        .filter(F.col("__line") != "")
        .select(i, h, p, F.xxhash64("__line").alias(g), F.hash("__line").alias(g2))
    )
    hashed = materialise(hashed, "lines")
    over = (
        hashed.select(g, g2, i)
        .distinct()
        .groupBy(g, g2)
        .agg(F.count("*").alias(n), F.min(F.struct(F.col(i).isNotNull(), F.col(i))).getField(i).alias(w))
        .filter(F.col(n) > max_docs)
    )
    over = materialise(over, "shared")
    total = over.agg(F.sum(n)).first()[0] or 0
    hits = spread_join(hashed, over, [g, g2], over.filter(F.col(n) > total / HOT))
    if keep_first:
        hits = hits.filter(~same(F.col(i), F.col(w)))
    positions = hits.groupBy(i, h).agg(F.collect_set(p).alias(bad))
    # The split array crosses the join as a column, so lambdas below index it without splitting again.
    left = docs.withColumn(h + "_", F.xxhash64(F.col(text_col))).withColumn(parts, F.split(F.col(text_col), "\n", -1))
    joined = left.join(positions, same(F.col(id_col), F.col(i)) & (F.col(h + "_") == F.col(h)), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(bad))
    text = F.when(F.col(bad).isNull(), F.array_join(parts, "\n")).otherwise(
        F.array_join(F.transform(keep, lambda k: F.col(parts).__getitem__(k)), "\n")
    )
    out = with_text(
        joined.withColumn("n_lines", F.when(F.col(parts).isNull(), 0).otherwise(F.size(parts)))
        .withColumn("n_dropped", F.when(F.col(bad).isNull(), 0).otherwise(F.size(bad))),
        text_col,
        text,
    )
    return out.drop(i, h, h + "_", parts, bad)

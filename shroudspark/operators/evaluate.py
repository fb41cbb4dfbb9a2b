"""Scores of detections against planted items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values and texts of a document up to which they are compared in pairs; those of larger ones meet by equality of pieces.
MOST_PAIRED = 256


def _pieces(rows: DataFrame, text: str, others: DataFrame, other: str, least: int = 1) -> DataFrame:
    """``rows`` (document, text) with each part of ``text``, as ``__piece``, that is as long as one of the ``other`` texts.

    So that one text is part of another becomes equality, which is joined by hash.  The
    lengths are one row; there are no more of them than characters in the longest text.
    """
    lengths = others.filter(F.length(other) >= least).agg(F.collect_set(F.length(other)).alias("__lengths"))
    fits = F.filter("__lengths", lambda n: n <= F.length(text))
    cut = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, n))))
    return rows.crossJoin(F.broadcast(lengths)).select("document", text, F.explode_outer(F.array_distinct(cut)).alias("__piece")).filter("__piece is not null")


def _matches(key: DataFrame, detections: DataFrame, least: int) -> DataFrame:
    """(document, value, text): a text that holds a planted value, or is a part of it of ``least`` characters or more."""
    values = key.select("document", "value").distinct()
    texts = detections.select("document", "text").distinct()
    holds = _pieces(texts, "text", values, "value").join(values.withColumn("__piece", F.col("value")), ["document", "__piece"])
    part = _pieces(values, "value", texts, "text", least).join(texts.withColumn("__piece", F.col("text")), ["document", "__piece"])
    return holds.select("document", "value", "text").unionByName(part.select("document", "value", "text"))


def _met(key: DataFrame, detections: DataFrame, least: int, side: str) -> DataFrame:
    """Distinct (document, ``side``) that ``_matches`` finds, ``side`` being value or text.

    Values and texts cross one shuffle, by document.  Few of them in a document are
    compared in its own row, for pieces are about as many as a text's length squared.
    """
    tagged = key.select("document", F.col("value").alias("s"), F.lit(True).alias("planted")).unionByName(detections.select("document", F.col("text").alias("s"), F.lit(False).alias("planted")))
    sized = tagged.filter("document is not null and s is not null").withColumn("n", F.count("*").over(Window.partitionBy("document")))
    few = sized.filter(F.col("n") <= MOST_PAIRED).groupBy("document").agg(F.collect_set(F.when(F.col("planted"), F.col("s"))).alias("values"), F.collect_set(F.when(~F.col("planted"), F.col("s"))).alias("texts"))
    fits = lambda v, t: ((v != "") & F.contains(t, v)) | ((F.length(t) >= least) & F.contains(v, t))
    if side == "value":
        met = F.filter("values", lambda v: ((v != "") & F.array_contains("texts", v)) | F.exists("texts", lambda t: fits(v, t)))
    else:
        met = F.filter("texts", lambda t: ((t != "") & F.array_contains("values", t)) | F.exists("values", lambda v: fits(v, t)))
    # Outer, and filtered afterwards, as in ``detect.explode_spans``.
    paired = few.select("document", F.explode_outer(met).alias(side)).filter(F.col(side).isNotNull())
    many = sized.filter(F.col("n") > MOST_PAIRED).select("document", "s", "planted").repartition("document", "s")
    split = lambda planted, name: many.filter(planted).select("document", F.col("s").alias(name))
    return paired.unionByName(_matches(split(F.col("planted"), "value"), split(~F.col("planted"), "text"), least).select("document", side).distinct())


def caught(key: DataFrame, detections: DataFrame) -> DataFrame:
    """``key`` (document, type, value, expected, ...) with ``caught``: some detection of the
    document holds the value, or is a part of it of four characters or more."""
    hit = _met(key, detections, 4, "value").withColumn("caught", F.lit(True))
    return key.join(hit, ["document", "value"], "left").select(*key.columns, F.coalesce("caught", F.lit(False)).alias("caught"))


def false_positives(key: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections that neither hold nor are part of any planted value of their document."""
    return detections.join(_met(key, detections, 1, "text"), ["document", "text"], "left_anti").select(*detections.columns)


def false_by_type(key: DataFrame, detections: DataFrame) -> DataFrame:
    """(entity_type, n_false) of the types that have any, by type."""
    return false_positives(key, detections).groupBy("entity_type").agg(F.count("*").alias("n_false")).orderBy("entity_type")


def in_place(detections: DataFrame, name: str) -> DataFrame:
    """(n): detections whose locator contains a name, whatever its case; those of sheets where nothing may be found."""
    return detections.agg(F.count_if(F.contains(F.lower("locator"), F.lit(name.lower()))).alias("n"))


def recall(scored: DataFrame) -> DataFrame:
    """(type, n_detect, n_caught, recall, n_suppress, n_suppressed, n_gap, n_gap_caught) by type, and overall with a null type."""
    of = lambda e: F.col("expected") == e
    out = scored.rollup("type").agg(
        F.count_if(of("detect")).alias("n_detect"),
        F.count_if(of("detect") & F.col("caught")).alias("n_caught"),
        F.count_if(of("suppress")).alias("n_suppress"),
        F.count_if(of("suppress") & ~F.col("caught")).alias("n_suppressed"),
        F.count_if(of("gap")).alias("n_gap"),
        F.count_if(of("gap") & F.col("caught")).alias("n_gap_caught"),
    )
    return out.withColumn("recall", F.when(F.col("n_detect") > 0, F.round(F.col("n_caught") / F.col("n_detect"), 3)))


def precision(key: DataFrame, detections: DataFrame) -> DataFrame:
    """(n, n_false, precision) over all detections."""
    n = detections.agg(F.count("*").alias("n"))
    wrong = false_positives(key, detections).agg(F.count("*").alias("n_false"))
    return n.crossJoin(wrong).withColumn("precision", F.when(F.col("n") > 0, F.round((F.col("n") - F.col("n_false")) / F.col("n"), 3)))


def f1(p: F.Column, r: F.Column) -> F.Column:
    return F.when(p + r > 0, F.bround(2 * p * r / (p + r), 3)).otherwise(0.0)


def scorecard(key: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: items and detections, what of them was caught, suppressed or wrong, recall, precision and their F1."""
    overall = recall(caught(key, detections)).filter("type is null").drop("type")
    one = overall.crossJoin(precision(key, detections).withColumnsRenamed({"n": "n_found"}))
    return one.withColumn("f1", f1(F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))))


def first_records(records: DataFrame, n: int, order: str = "record") -> DataFrame:
    """The first ``n`` records in their order, for a quick score."""
    return records.orderBy(order).limit(n)


def span_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(type, n, n_caught, recall): gold spans (record, type, start, end) that some found span
    (record, start, end) of the record overlaps."""
    places = gold.select("record", "start", "end").distinct()
    touch = (F.col("g.record") == F.col("f.record")) & (F.col("f.start") < F.col("g.end")) & (F.col("g.start") < F.col("f.end"))
    hit = places.alias("g").join(found.alias("f"), touch, "left_semi").withColumn("hit", F.lit(1))
    return gold.join(hit, ["record", "start", "end"], "left").groupBy("type").agg(
        F.count("*").alias("n"), F.count("hit").alias("n_caught"), F.round(F.count("hit") / F.count("*"), 3).alias("recall")
    )

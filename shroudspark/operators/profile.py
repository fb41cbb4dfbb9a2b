"""Profiles of tables, and twins that have their shape and none of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = "header string, kind string, nulls double, minimum double, maximum double, decimals int, distinct bigint, date_min timestamp_ntz, date_max timestamp_ntz"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _blank(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def _decimals(c: Column) -> Column:
    """Digits after the point as a number is written, four at most."""
    return F.least(F.length(F.regexp_extract(F.format_number(F.abs(c.cast("double")), 6), r"\.([0-9]*?)0*$", 1)), F.lit(4))


def profile(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row for each column: kind, share of nulls, range, decimals and distinct values.

    Kinds are ``id`` (whole numbers that never fall in the order of ``order_col``, more
    than two), ``number``, ``date``, ``email`` (half of the values look like one),
    ``text`` and ``empty``; an empty string is a null, booleans are text.

    Everything comes from one aggregation.  Whether numbers never fall is found with
    the value before, within ranges of the order and across their borders, so no
    task has to see a whole column; without ``order_col`` no column is an ``id``.
    """
    fields = df.schema.fields
    total = F.count("*").cast("double")
    falls = _falls(df, order_col) if order_col else {}
    aggregates = []
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        there = ~_blank(c, f.dataType)
        aggregates.append(F.count_if(there).alias(f"n{k}"))
        if isinstance(f.dataType, _NUMBERS):
            d = c.cast("double")
            aggregates += [F.min(d).alias(f"lo{k}"), F.max(d).alias(f"hi{k}"), F.coalesce(F.max(_decimals(c)), F.lit(0)).alias(f"dec{k}"), F.bool_and(d == F.floor(d)).alias(f"whole{k}")]
        elif isinstance(f.dataType, _DATES):
            aggregates += [F.min(c).cast("timestamp_ntz").alias(f"lo{k}"), F.max(c).cast("timestamp_ntz").alias(f"hi{k}")]
        else:
            s = F.when(there, c.cast("string"))
            aggregates += [F.count_distinct(s).alias(f"distinct{k}"), F.count_if(s.rlike(r"@[^@]*\.[^@]*$")).alias(f"mail{k}")]
    row = df.agg(total.alias("total"), *aggregates)
    none_double, none_date = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    columns = []
    for k, f in enumerate(fields):
        n = F.col(f"n{k}")
        lo = hi = none_double
        date_lo = date_hi = none_date
        decimals, distinct = F.lit(0), F.lit(0).cast("bigint")
        if isinstance(f.dataType, _NUMBERS):
            lo, hi, decimals = F.col(f"lo{k}"), F.col(f"hi{k}"), F.col(f"dec{k}")
            rising = F.lit(order_col is not None and not falls.get(f.name, True))
            kind = F.when(rising & F.col(f"whole{k}") & (n > 2), "id").otherwise("number")
        elif isinstance(f.dataType, _DATES):
            date_lo, date_hi, kind = F.col(f"lo{k}"), F.col(f"hi{k}"), F.lit("date")
        else:
            mail = F.col(f"mail{k}") >= F.greatest(F.lit(1), F.floor(n / 2))
            kind, distinct = F.when(mail, "email").otherwise("text"), F.when(mail, F.lit(0).cast("bigint")).otherwise(F.col(f"distinct{k}"))
        columns.append(
            F.struct(
                F.lit(f.name).alias("header"),
                F.when(n == 0, "empty").otherwise(kind).alias("kind"),
                F.when(F.col("total") > 0, 1 - n / F.col("total")).otherwise(1.0).alias("nulls"),
                lo.alias("minimum"),
                hi.alias("maximum"),
                decimals.cast("int").alias("decimals"),
                distinct.alias("distinct"),
                date_lo.alias("date_min"),
                date_hi.alias("date_max"),
            )
        )
    return row.select(F.inline(F.array(*columns)))


def _falls(df: DataFrame, order_col: str) -> dict[str, bool]:
    """Whether each numeric column falls anywhere, its nulls left out, in the order of a column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMBERS)]
    if not names:
        return {}
    ranges = df.select(F.col(f"`{order_col}`").alias("__o"), *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names)))
    ranges = ranges.repartitionByRange("__o").sortWithinPartitions("__o").withColumn("__p", F.spark_partition_id())
    inner = Window.partitionBy("__p").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranges.select("__p", "__o", *(F.struct(F.col(f"c{k}").alias("v"), F.max(f"c{k}").over(inner).alias("before")).alias(f"c{k}") for k in range(len(names))))
    parts = seen.groupBy("__p").agg(
        *(
            F.struct(F.bool_or(F.col(f"c{k}.v") < F.col(f"c{k}.before")).alias("fall"), F.min(f"c{k}.v").alias("lo"), F.max(f"c{k}.v").alias("hi")).alias(f"c{k}")
            for k in range(len(names))
        )
    )
    borders = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    both = parts.select(*(F.coalesce(F.col(f"c{k}.fall"), F.lit(False)).alias(f"f{k}") for k in range(len(names))), *(F.coalesce(F.col(f"c{k}.lo") < F.max(f"c{k}.hi").over(borders), F.lit(False)).alias(f"g{k}") for k in range(len(names))))
    row = both.agg(*(F.bool_or(F.col(f"f{k}") | F.col(f"g{k}")).alias(f"x{k}") for k in range(len(names)))).first()
    return {c: bool(row[f"x{k}"]) for k, c in enumerate(names)}


def header_row(cells: DataFrame, first: int = 15) -> DataFrame:
    """(sheet, header_row) of grids given as (sheet, row, text): of the first rows the one with
    most non-blank strings, the earlier of equals."""
    strings = cells.filter(F.col("row") < first).groupBy("sheet", "row").agg(F.count_if(F.trim("text") != "").alias("n"))
    order = Window.partitionBy("sheet").orderBy(F.desc("n"), "row")
    return strings.withColumn("r", F.row_number().over(order)).filter("r = 1").select("sheet", F.col("row").alias("header_row"))


def _uniform(seed: int, column: int, row: Column) -> Column:
    """A number in [0, 1) that depends on the cell alone, so partitions can't matter."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(column), row), F.lit(1 << 52)) / float(1 << 52)).cast("double")


def twin(df: DataFrame, order_col: str | None = None, rows: int = 2000, seed: int = 7) -> DataFrame:
    """A table with the columns, kinds, ranges and null shares of ``df``, and none of its values.

    Columns keep their names.  Numbers are drawn between the extremes and never are the
    extremes; a constant column gives values beside it.  Texts have as many distinct
    values as those they stand for.  A profile, a row for each column, is all that is
    read on the driver; the twin's text is made up, so it can't hold text of ``df``.
    """
    columns = profile(df, order_col).collect()
    total = df.count()
    out = df.sparkSession.range(min(total, rows)).withColumnRenamed("id", "__row")
    made = []
    for k, p in enumerate(columns):
        u = _uniform(seed, 2 * k, F.col("__row"))
        if p["kind"] == "id":
            value = F.lit(100_000) + F.col("__row")
        elif p["kind"] == "number":
            lo, hi = p["minimum"], p["maximum"]
            if hi <= lo:
                lo, hi = lo + 1, lo + 2
            value = F.lit(lo) + (F.lit(hi) - F.lit(lo)) * (0.001 + 0.998 * u)
            value = F.round(value, p["decimals"]) if p["decimals"] else F.floor(value)
        elif p["kind"] == "date":
            days = max((p["date_max"] - p["date_min"]).days, 2)
            value = F.lit(p["date_min"]) + F.make_interval(days=1 + F.floor(u * F.lit(days - 1)).cast("int"), secs=F.lit(1))
        elif p["kind"] == "email":
            value = F.format_string("user%d@example.com", F.lit(100_000) + F.col("__row"))
        elif p["kind"] == "text":
            value = F.format_string("val_%d", F.floor(u * F.lit(max(p["distinct"], 1))).cast("bigint"))
        else:
            value = F.lit(None).cast("string")
        made.append(F.when(_uniform(seed, 2 * k + 1, F.col("__row")) >= p["nulls"], value).alias(p["header"]))
    return out.select(*made)


def twin_schema(df: DataFrame, order_col: str | None = None, rows: int = 2000) -> DataFrame:
    """(name, type, nulls, rows, twin_rows) of each column of a twin."""
    size = df.agg(F.count("*").alias("rows"))
    return profile(df, order_col).crossJoin(F.broadcast(size)).select(
        F.col("header").alias("name"), F.col("kind").alias("type"), F.round("nulls", 2).alias("nulls"), "rows", F.least("rows", F.lit(rows)).alias("twin_rows")
    )


def twin_leaks(source: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the twin's cells that are cells of the same column of the source."""
    cells = lambda d: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    return cells(made).distinct().join(cells(source), ["column", "value"], "left_semi")

"""Labels of paths by ordered glob rules, and what they block."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILT_IN: tuple[tuple[str, str], ...] = tuple(
    (f"*/{folder}/*", label)
    for folder, label in {"real": "restricted", "sensitive": "confidential", "corpus": "restricted", "ground_truth": "restricted", "data": "confidential"}.items()
)
BLOCKED = ("confidential", "restricted")


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole paths; ``*`` also stands for slashes."""
    python = fnmatch.translate(glob.lower())
    body = python.removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
    return rf"(?s)\A(?:{body.replace('(?>.*?', '(?:.*?')})\z"


def label(path: Column, rules: Sequence[tuple[str, str]] = BUILT_IN, default: str = "public") -> Column:
    """The label of the last rule that matches; rules are few and become one expression."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    out = F.lit(default.lower())
    for glob, name in rules:
        if glob:
            out = F.when(low.rlike(glob_pattern(glob)), F.lit(name.lower())).otherwise(out)
    return F.when(path.isNull(), F.lit(default.lower())).otherwise(out)


def manifest_rules(manifest: Mapping | None) -> tuple[tuple[tuple[str, str], ...], str]:
    """Rules and default label of a manifest; without one, the built-in rules."""
    if not manifest:
        return BUILT_IN, "public"
    default = str(manifest.get("default", "public"))
    return tuple((str(r.get("glob", "")), str(r.get("label", default))) for r in manifest.get("rules", [])), default


def label_by_table(paths: DataFrame, rules: DataFrame, path_col: str = "path", default: str = "public", most_rules: int = 10_000) -> DataFrame:
    """As ``label``, with rules from a table (ord, glob, label); the last match wins.

    Rules are read to the driver, where globs become patterns as they do for ``label``;
    more than ``most_rules`` are an error.  Up to a hundred become one expression, more
    are sent to the executors as one array.
    """
    listed = [(r["glob"] or "", r["label"]) for r in rules.orderBy("ord", "glob", "label").limit(most_rules + 1).collect() if r["label"] is not None]
    if len(listed) > most_rules:
        raise ValueError(f"there are more than {most_rules} rules")
    if len(listed) <= 100:
        return paths.withColumn("label", label(F.col(path_col), listed, default))
    spark = paths.sparkSession
    rows = spark.createDataFrame([([(glob_pattern(g), name.lower()) for g, name in listed if g],)], "__rules array<struct<pattern:string,label:string>>")
    low = F.replace(F.lower(F.col(path_col)), F.lit("\\"), F.lit("/"))
    last = F.try_element_at(F.filter("__rules", lambda r: F.regexp_like(low, r["pattern"])), F.lit(-1))["label"]
    return paths.crossJoin(F.broadcast(rows)).withColumn("label", F.coalesce(last, F.lit(default.lower()))).drop("__rules")


def blocked(path: Column, rules: Sequence[tuple[str, str]] = BUILT_IN, default: str = "public") -> Column:
    """Whether a path must not be read; no path blocks nothing."""
    return F.coalesce(path != "", F.lit(False)) & label(path, rules, default).isin(*BLOCKED)

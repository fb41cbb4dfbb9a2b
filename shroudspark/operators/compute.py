"""Queries over protected tables, of which only masked and capped results come back."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudspark.config import Settings
from shroudspark.operators.redact import redact

CAVEAT = "Masked by pattern; aggregate before you share."
_REFUSED = ("java_method", "reflect", "try_reflect", "read_files", "input_file_name", "python_worker", "from_file", "url_encode_file")
_WRITES = re.compile(r"(?is)\b(?:insert|create|drop|alter|truncate|delete|update|merge|load|cache|uncache|refresh|add|set|reset|msck|analyze|use|grant|revoke|call|execute|declare)\b")


class Refused(ValueError):
    """The query may not run."""


def check(query: str) -> None:
    """Refuse all but one SELECT (or WITH ... SELECT) of tables by their registered names."""
    plain = re.sub(r"(?s)'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", query)
    plain = re.sub(r"(?s)--[^\n]*|/\*.*?\*/", " ", plain).strip().rstrip(";").strip()
    if ";" in plain or not re.match(r"(?is)(?:select|with)\b", plain):
        raise Refused("one SELECT is allowed")
    if found := _WRITES.search(plain):
        raise Refused(f"{found.group().upper()} is not allowed")
    for name in _REFUSED:
        if re.search(rf"(?i)\b{name}\s*\(", plain):
            raise Refused(f"{name} is not allowed")
    if re.search(r"(?i)\b(?:parquet|csv|json|orc|text|avro|binaryFile|jdbc|delta)\s*\.\s*`", plain):
        raise Refused("files can't be named")


def mask_strings(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every string column masked."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out = redact(out, f.name, settings)
    return out


def safe_query(query: str, tables: Mapping[str, DataFrame], rows: int = 1000, settings: Settings = Settings()) -> DataFrame:
    """The result of one SELECT over named tables, its strings masked, ``rows`` rows at most.

    The text is checked first, and then the plan: every relation that it reads must be one
    of those that the tables read.  Nested values are turned into JSON strings, so that
    they are masked too.  Which rows a limit leaves is the query's order to say.
    """
    check(query)
    if not tables:
        raise Refused("there are no tables")
    found = _over(query, tables)
    flat = found.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in found.schema.fields))
    return mask_strings(flat.limit(rows), settings)


def _over(query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run the query with the tables as common table expressions, which hide all others of their names."""
    session = next(iter(tables.values())).sparkSession
    mark = f"__protected_{uuid.uuid4().hex}"
    for name in tables:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise Refused(f"{name!r} is no table name")
    bodies = ", ".join(f"{name} AS (SELECT * FROM {mark}_{name})" for name in tables)
    plain = query.strip().rstrip(";")
    rest = re.sub(r"(?is)^with\s+(recursive\s+)?", "", plain)
    recursive = "RECURSIVE " if re.match(r"(?is)with\s+recursive\b", plain) else ""
    try:
        for name, table in tables.items():
            table.createOrReplaceTempView(f"{mark}_{name}")
        found = session.sql(f"WITH {recursive}{bodies}, {rest}" if rest != plain else f"WITH {bodies} {plain}")
    finally:  # the plan that was made holds the tables themselves
        for name in tables:
            session.catalog.dropTempView(f"{mark}_{name}")
    allowed = [node.canonicalized() for table in tables.values() for node in _nodes(table) if node.children().isEmpty()]
    inner = {node.desc().identifier().table() for table in tables.values() for node in _nodes(table) if node.nodeName() == "View"}
    for node in _nodes(found):
        if node.nodeName() == "View" and not (name := node.desc().identifier().table()).startswith(mark) and name not in inner:
            raise Refused("only the tables that are named may be read")
        if node.children().isEmpty() and node.nodeName() not in _HARMLESS and not any(node.canonicalized().equals(own) for own in allowed):
            raise Refused("only the tables that are named may be read")
    return found


#: Relations that hold nothing but what the query says itself, and the references of a recursive one to itself.
_HARMLESS = ("LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "UnionLoopRef")


def _nodes(df: DataFrame) -> list:
    """The nodes of a plan as it was analysed, in subqueries too."""
    plan = df._jdf.queryExecution().analyzed()
    below = plan.subqueriesAll()
    left, out = [plan, *(below.apply(k) for k in range(below.size()))], []
    while left:
        node = left.pop()
        out.append(node)
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return out


class Output(NamedTuple):
    text: str
    truncated: bool  # whether the unmasked text was over the limit
    timed_out: bool
    caveat: str = CAVEAT


def run_query(query: str, tables: Mapping[str, DataFrame], timeout: float = 30.0, chars: int = 4000, rows: int = 1000) -> Output:
    """The result as text: masked, then cut to ``chars``; its jobs are cancelled after ``timeout`` seconds."""
    df = safe_query(query, tables, rows)
    context = df.sparkSession.sparkContext
    tag = f"safe-query-{id(df)}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        lines = ["\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in row) for row in df.collect())]
    except Exception:
        if over.is_set():
            return Output("", False, True)
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    text = "\n".join(lines)
    return Output(text[:chars], len(text) > chars, False)

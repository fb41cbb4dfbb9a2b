"""Registered queries of this package: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudspark.llm import byte_bpe as _byte_bpe
from shroudspark.llm import chat_format as _chat_format
from shroudspark.llm import decontaminate as _decontaminate
from shroudspark.llm import factorisation_machine as _factorisation_machine
from shroudspark.llm import html_extract as _html_extract
from shroudspark.llm import kmeans_tree as _kmeans_tree
from shroudspark.llm import line_dedup as _line_dedup
from shroudspark.llm import order_minhash as _order_minhash
from shroudspark.llm import skip_chain as _skip_chain
from shroudspark.llm import suffix_ranks as _suffix_ranks
from shroudspark.llm._common import read, settled


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    return settled(spark, lambda: _kmeans_tree.neighbours(read(spark, sf_dir, "embeddings"), every=20), "neighbours")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skip_chain.entities(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _line_dedup.dedup_lines(docs)


OP3_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM parts),
normal AS (
  SELECT *, trim(regexp_replace(lower(line), '[ \t\r\n\f]+', ' ', 'g'), ' ') AS norm FROM lines),
shared AS (
  SELECT norm FROM normal WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > 10),
marked AS (
  SELECT n.doc_id, n.pos, n.line, s.norm IS NOT NULL AS bad
  FROM normal n LEFT JOIN shared s ON n.norm = s.norm)
SELECT doc_id,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS text,
  CAST(count(*) AS INTEGER) AS n_lines,
  CAST(count(*) FILTER (WHERE bad) AS INTEGER) AS n_dropped
FROM marked GROUP BY doc_id
"""


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return settled(spark, lambda: _order_minhash.duplicates(docs), "duplicates")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_extract.extract(read(spark, sf_dir, "pages")).drop("html")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: _suffix_ranks.repeats(read(spark, sf_dir, "documents")), "repeats")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _byte_bpe.encode(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all conversations; the target spans as text, ``start-end`` with commas."""
    found = _chat_format.windows(read(spark, sf_dir, "conversations"))
    spans = F.transform("targets", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return found.withColumn("targets", F.array_join(spans, ","))


OP9_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT DISTINCT conv_id AS c, turn AS t, role AS r, text AS x FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
costs AS (
  SELECT *, len(regexp_extract_all(x, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) + 4 AS n FROM turns),
head AS (
  SELECT c, sum(n) AS fixed, string_agg('<|' || r || '|>' || chr(10) || x || chr(10) || '<|end|>' || chr(10), '' ORDER BY t, r, x) AS opening
  FROM costs WHERE r = 'system' GROUP BY c),
talk AS (
  SELECT k.c, t, r, x, row_number() OVER w - 1 AS i, sum(n) OVER w AS upto, sum(n) OVER w - n AS before_it,
    coalesce(h.fixed, 0) AS fixed, coalesce(h.opening, '') AS opening
  FROM costs k LEFT JOIN head h ON k.c = h.c WHERE r <> 'system'
  WINDOW w AS (PARTITION BY k.c ORDER BY t, r, x)),
begins AS (
  SELECT a.c, a.i, min(b.i) AS h, min(b.before_it) AS low
  FROM talk a JOIN talk b ON a.c = b.c AND b.i <= a.i AND b.i >= a.i - 4 AND b.before_it >= a.before_it - 128
  GROUP BY a.c, a.i),
ends AS (
  SELECT g.c, g.i, g.h, g.low, greatest(coalesce(max(b.i), 0), g.i) + 1 AS stop
  FROM begins g JOIN talk b ON b.c = g.c AND (b.upto <= g.low + 512 - b.fixed OR b.i = g.i)
  GROUP BY g.c, g.i, g.h, g.low),
walk AS (
  SELECT c, i, h, low, stop, 0 AS win FROM ends WHERE i = 0
  UNION ALL
  SELECT e.c, e.i, e.h, e.low, e.stop, w.win + 1 FROM walk w JOIN ends e ON e.c = w.c AND e.i = w.stop),
pieces AS (
  SELECT w.c, w.win, w.i AS a, w.h, w.stop, w.low, t.i, t.t, t.r, t.x, t.upto, t.fixed, t.opening,
    '<|' || t.r || '|>' || chr(10) AS mark
  FROM walk w JOIN talk t ON t.c = w.c AND t.i >= w.h AND t.i < w.stop),
placed AS (
  SELECT *, length(opening) + sum(length(mark) + length(x) + 9) OVER (PARTITION BY c, win ORDER BY i) - length(x) - 9 AS s FROM pieces)
SELECT c AS conv_id, CAST(win AS INTEGER) AS "window", min(t) FILTER (WHERE i = a) AS first_turn,
  max(t) FILTER (WHERE i = stop - 1) AS last_turn, CAST(any_value(a - h) AS INTEGER) AS n_history,
  CAST(any_value(fixed) + max(upto) - any_value(low) AS INTEGER) AS n_tokens,
  any_value(opening) || string_agg(mark || x || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg(s || '-' || (s + length(x)), ',' ORDER BY i) FILTER (WHERE r = 'assistant' AND i >= a), '') AS targets
FROM placed GROUP BY c, win
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    docs = read(spark, sf_dir, "documents")
    return _factorisation_machine.keep_good(docs, read(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_order_minhash": op4_order_minhash,
    "op5_html_extraction": op5_html_extraction,
    "op6_suffix_array": op6_suffix_array,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op9_chat_format": OP9_SQL,
}

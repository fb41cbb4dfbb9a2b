"""Queries of the engine's own operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudspark.config import Settings
from shroudspark.functions import checksums, spans, text
from shroudspark.operators import compute, detect, evaluate, known, policy, profile, redact, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small files of long texts as more partitions than one, for pattern-heavy work.

    A file smaller than a split is one task however slow its rows are.  Only where the
    scan gives fewer partitions than there are cores are rows moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Patterns as the detectors have them, for SQL engines without lookaround.
_EMAIL = r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"
_CARD = r"\b(?:[0-9][ -]?){12,18}[0-9]\b"
_IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
_PHONE = detect.PHONE
_LUHN = "(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(substr(reverse({d}), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse({d}), i, 1) AS INTEGER)) % 10 ELSE CAST(substr(reverse({d}), i, 1) AS INTEGER) END)) % 10 = 0)"
_SECRETS = (
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", ""),
    (r"\bgh[opsru]_[A-Za-z0-9]{36}\b", ""),
    (r"\bAIza[A-Za-z0-9_-]{35}\b", ""),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", ""),
    (r"\b[rs]k_(?:test|live)_[A-Za-z0-9]{16,}\b", ""),
    (r"\beyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2}\b", ""),
    (r"-----BEGIN[A-Z ]*PRIVATE KEY-----.*?-----END[A-Z ]*PRIVATE KEY-----", ""),
    (r"\b(?:redis|amqps?|mysql|postgres(?:ql)?|mongodb(?:\+srv)?)://[^\s:/@''\x22]+(?::[^\s:/@''\x22]+)@[^\s''\x22]+", ""),
    (r"\b[\w.-]*(?:pwd|password|passwd|(?:auth[_-]?)?token|(?:client[_-]?)?secret|(?:access|api)[_-]?key)\s*[:=]\s*[''\x22][^''\x22\s]{8,}[''\x22]", ""),
    (r"\b[\w.-]*(?:pwd|password|passwd|(?:auth[_-]?)?token|(?:client[_-]?)?secret|(?:access|api)[_-]?key)\s*[:=]\s*[A-Za-z0-9._/+=-]{8,}", "[0-9]"),
    (r"\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*", ""),
)


def _secret_count(column: str) -> str:
    parts = []
    for pattern, has in _SECRETS:
        found = f"regexp_extract_all({column}, '(?ism){pattern}')"
        parts.append(f"len(list_filter({found}, lambda x: regexp_matches(x, '[:=].*{has}')))" if has else f"len({found})")
    return " + ".join(parts)


def _typed(column: str) -> str:
    """Number of spans of each type in a text, as SQL."""
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    words = " OR ".join(f"contains(lower({column}), '{w}')" for w in "call cell contact fax mob mobile phone tel telephone".split())
    compact = r"regexp_replace(x, '[\s()+-]', '', 'g')"
    return f"""
  len(regexp_extract_all({column}, '{_EMAIL}')) AS "EMAIL_ADDRESS",
  len(list_filter(regexp_extract_all({column}, '{_CARD}'), lambda x: length({digits}) BETWEEN 13 AND 19 AND {_LUHN.format(d=digits)})) AS "CREDIT_CARD",
  len(list_filter(regexp_extract_all({column}, '{_IP}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS INTEGER))) <= 255)) AS "IP_ADDRESS",
  len(list_filter(regexp_extract_all({column}, '{_PHONE}'), lambda x: length({digits}) BETWEEN 7 AND 15 AND (({words})
    OR regexp_matches(x, '^\\s*(?:\\+[0-9]|\\([0-9]{{2,3}}\\)|0[2-478]|1[38]00)')
    OR (regexp_matches({compact}, '^[0-9]{{7,15}}$') AND regexp_matches(x, '[\\s()-]'))))) AS "PHONE_NUMBER",
  {_secret_count(column)} AS "CREDENTIAL\""""


_TYPES = ("CREDENTIAL", "CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER")
_COMMON = Settings(types=_TYPES)
_UNPIVOT = ", ".join(f'"{t}"' for t in _TYPES)


@query(f"""
WITH each AS (SELECT {_typed("text")} FROM documents),
long AS (UNPIVOT each ON {_UNPIVOT} INTO NAME type VALUE k)
SELECT type, CAST(sum(k) AS BIGINT) AS n FROM long GROUP BY type HAVING sum(k) > 0
""")
def scan_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = detect.detect(docs, ["doc_id"], settings=_COMMON)
    return scan.counts(found)


@query(f"""
WITH each AS (SELECT doc_id, {_typed("text")} FROM documents),
long AS (UNPIVOT each ON {_UNPIVOT} INTO NAME type VALUE k)
SELECT doc_id, type, CAST(k AS BIGINT) AS n FROM long WHERE k > 0
""")
def scan_findings_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return detect.detect(docs, ["doc_id"], settings=_COMMON).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


_LINES = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
segments AS (SELECT doc_id, k, trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') AS text FROM lines)
"""


@query(f"""
WITH {_LINES},
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM segments WHERE text <> '')
SELECT CAST(doc_id AS VARCHAR) AS document, CAST(count(*) FILTER (WHERE r <= 20) AS BIGINT) AS scanned, max(r) > 20 AS noted FROM numbered GROUP BY doc_id
""")
def scan_capped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of a scan, set low enough to bite here."""
    segments = scan.line_segments(table(spark, sf_dir, "documents"))
    kept, notes = scan.capped(segments, 20)
    scanned = kept.groupBy("document").agg(F.count("*").alias("scanned"))
    return scanned.join(notes.select("document", F.lit(True).alias("noted")), "document", "left").withColumn("noted", F.coalesce("noted", F.lit(False)))


@query(f"""
WITH {_LINES}, each AS (SELECT doc_id, k, {_typed("text")} FROM segments WHERE text <> ''),
long AS (UNPIVOT each ON {_UNPIVOT} INTO NAME type VALUE n)
SELECT type, CAST(doc_id AS VARCHAR) AS document, 'line ' || k AS location, CAST(sum(n) AS BIGINT) AS n FROM long WHERE n > 0 GROUP BY ALL
""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a whole scan, line by line, counted by place."""
    segments = spread(scan.line_segments(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return scan.findings(segments, _COMMON).groupBy("type", "document", "location").agg(F.count("*").alias("n"))


def _weights(column: str, weights: list[int], first_less: int = 0) -> str:
    return " + ".join(f"(CAST(substr({column}, {k}, 1) AS INTEGER){f' - {first_less}' if k == 1 and first_less else ''}) * {w}" for k, w in enumerate(weights, 1))


_ABN_SQL = f"({_weights('s', [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 1)}) % 89 = 0"
_ACN_CHECK = f"((10 - ({_weights('s', [8, 7, 6, 5, 4, 3, 2, 1])}) % 10) % 10)"
_TFN8_SQL = f"({_weights('s', [10, 7, 8, 4, 6, 3, 5, 1])}) % 11 = 0"
_TFN9_SQL = f"({_weights('s', [1, 4, 3, 7, 5, 8, 6, 9, 10])}) % 11 = 0"
_MEDICARE_CHECK = f"(({_weights('s', [1, 3, 7, 9, 1, 3, 7, 9])}) % 10)"


def _orders(spark: SparkSession, sf_dir: str, width: int, factor: int = 1) -> DataFrame:
    key = (F.col("o_orderkey") * factor).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(key, width, "0").alias("s"))


def _orders_sql(width: int, factor: int = 1) -> str:
    return f"(SELECT o_orderkey, lpad(CAST(o_orderkey * {factor} AS VARCHAR), {width}, '0') AS s FROM orders)"


@query(f"SELECT o_orderkey, {_ABN_SQL} AS ok FROM {_orders_sql(11, 7919)}")
def abn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 11, 7919).select("o_orderkey", checksums.valid_abn(F.col("s")).alias("ok"))


@query(f"SELECT o_orderkey, {_ACN_CHECK} = CAST(substr(s, 9, 1) AS INTEGER) AS ok FROM {_orders_sql(9, 37)}")
def acn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 9, 37).select("o_orderkey", checksums.valid_acn(F.col("s")).alias("ok"))


@query(f"""SELECT o_orderkey, {_TFN8_SQL} AS ok8, {_TFN9_SQL.replace("s,", "t,")} AS ok9
FROM (SELECT o_orderkey, s, lpad(CAST(o_orderkey * 13 AS VARCHAR), 9, '0') AS t FROM {_orders_sql(8)})""")
def tfn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nine = F.lpad((F.col("o_orderkey") * 13).cast("string"), 9, "0")
    return _orders(spark, sf_dir, 8).select("o_orderkey", checksums.valid_tfn(F.col("s")).alias("ok8"), checksums.valid_tfn(nine).alias("ok9"))


@query(f"SELECT o_orderkey, substr(s, 1, 1) BETWEEN '2' AND '6' AND {_MEDICARE_CHECK} = CAST(substr(s, 9, 1) AS INTEGER) AS ok FROM {_orders_sql(10, 199999)}")
def medicare_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 10, 199999).select("o_orderkey", checksums.valid_medicare(F.col("s")).alias("ok"))


@query(f"SELECT o_orderkey, s || {_ACN_CHECK} AS acn FROM {_orders_sql(8)}")
def acn_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 8).select("o_orderkey", checksums.complete_acn(F.col("s")).alias("acn"))


@query(f"SELECT o_orderkey, CASE WHEN substr(s, 1, 1) BETWEEN '2' AND '6' THEN s || {_MEDICARE_CHECK} || '1' END AS card FROM {_orders_sql(8, 1999)}")
def medicare_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 8, 1999).select("o_orderkey", checksums.complete_medicare(F.col("s")).alias("card"))


@query(f"""
SELECT c_custkey, substr(x, 1, 2) || ' ' || substr(x, 3, 3) || ' ' || substr(x, 6, 3) || ' ' || substr(x, 9, 3) AS abn FROM (
  SELECT c_custkey, min(s) AS x
  FROM (SELECT c_custkey, CAST(10000000000 + c_custkey * 1000 + unnest(range(0, 400)) AS VARCHAR) AS s FROM customer)
  WHERE {_ABN_SQL} GROUP BY c_custkey)
""")
def abn_mint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first business number of each customer's four hundred; keys are made distinct, as in the SQL, which also spreads them."""
    number = checksums.mint_abn(F.lit(10_000_000_000) + F.col("c_custkey") * 1000, 400)
    keys = table(spark, sf_dir, "customer").select("c_custkey").distinct()
    # Generated, not projected: a filter on the number isn't pushed into another search for it.
    found = keys.select("c_custkey", F.explode_outer(F.array(number)).alias("number")).filter("number is not null")
    return found.select("c_custkey", checksums.spaced(F.col("number"), (2, 3, 3, 3)).alias("abn"))


@query(f"""
WITH keys AS (SELECT 'lineitem' AS source, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS s FROM lineitem
  UNION ALL SELECT 'orders', lpad(CAST(o_orderkey AS VARCHAR), 8, '0') FROM orders)
SELECT source, count(*) AS n, count(*) FILTER (WHERE {_TFN8_SQL}) AS n_valid, round(count(*) FILTER (WHERE {_TFN8_SQL}) / count(*), 4) AS rate
FROM keys GROUP BY source
""")
def checksum_fp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many running numbers pass the eight-digit test by chance."""
    orders = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"))
    keys = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("k")).unionByName(orders)
    ok = checksums.valid_tfn(F.lpad(F.col("k").cast("string"), 8, "0"))
    found = keys.groupBy("source").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))
    return found.withColumn("rate", F.round(F.col("n_valid") / F.col("n"), 4))


@query(f"""
SELECT o_orderkey % 2 = 0 AS labelled, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0 AND {_TFN8_SQL}) AS BIGINT) AS n, count(*) AS total
FROM {_orders_sql(8)} GROUP BY 1
""")
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a label and without: only those with one are found."""
    rows = _orders(spark, sf_dir, 8).withColumn("text", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "TFN ").otherwise("Ref "), "s"))
    found = detect.with_spans(rows, settings=Settings(types=("AU_TFN",)))
    return found.groupBy((F.col("o_orderkey") % 2 == 0).alias("labelled")).agg(F.sum(F.size("spans")).alias("n"), F.count("*").alias("total"))


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_findings FROM lineitem")
def ledger_fp_torture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal numbers, codes, amounts, dates and grouped digits: nothing may be found."""
    key = F.lpad((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), 8, "0")
    row = F.concat_ws(
        " ; ",
        key,
        F.concat(F.lit("EP"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")),
        F.format_string("%.2f", -F.col("l_extendedprice")),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        checksums.spaced(F.concat(F.lit("9"), key), (3, 3, 3)),
    )
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    found = detect.with_spans(spread(table(spark, sf_dir, "lineitem").select(*columns)).select(row.alias("text")), settings=Settings())
    return found.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n_findings"))


_PHONE_FORMS = (
    ("s", "'ref ' || s"),
    ("substr(s, 1, 4) || ' ' || substr(s, 5, 4)", "'ref'"),
    ("substr(s, 1, 6) || '.' || substr(s, 7, 2)", "'call us'"),
    ("s", "'Phone ' || s"),
    ("'+61' || s", "'x'"),
)


@query(
    "SELECT o_orderkey, form, NOT contains(v, '.') AND (contains(low, 'phone') OR contains(low, 'call') OR regexp_matches(v, '^(?:\\+[0-9]|0[2-478])') "
    "OR (regexp_matches(regexp_replace(v, '[ +-]', '', 'g'), '^[0-9]{7,15}$') AND regexp_matches(v, '[ -]'))) AS ok FROM ("
    + " UNION ALL ".join(f"SELECT o_orderkey, {k} AS form, {v} AS v, lower({low}) AS low FROM {_orders_sql(8)}" for k, (v, low) in enumerate(_PHONE_FORMS))
    + ")"
)
def phone_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*(F.struct(F.lit(k).alias("form"), F.expr(v).alias("v"), F.lower(F.expr(low)).alias("low")) for k, (v, low) in enumerate(_PHONE_FORMS)))
    rows = _orders(spark, sf_dir, 8).select("o_orderkey", F.inline(forms))
    return rows.select("o_orderkey", "form", detect.phone_survives(F.col("v"), F.col("low")).alias("ok"))


@query("SELECT p_partkey, NOT regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' EP' || p_partkey END, '[0-9]') AS kept FROM part")
def ner_digit_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a model might give them: those with digits are dropped."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" EP"), "p_partkey"))

    def model(text: Column) -> Column:
        return F.array(F.struct(F.lit("PERSON").alias("type"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(0.85).alias("score"), text.alias("value")))

    found = detect.with_spans(table(spark, sf_dir, "part").select("p_partkey", name.alias("text")), settings=Settings(types=()), model=model)
    return found.select("p_partkey", (F.size("spans") > 0).alias("kept"))


@query(f"""
SELECT o_orderkey, CASE WHEN r <= 40 AND r <> 1 THEN 1 ELSE 0 END AS n, CASE WHEN r <= 40 AND r <> 1 THEN CAST(11 + greatest(r, 1) AS INTEGER) END AS "start"
FROM (SELECT o_orderkey, o_orderkey % 45 AS r FROM orders)
""")
def bsb_account_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 to 44 characters after a branch code: up to 40 they are accounts, unless a
    single space makes both one number."""
    gap = F.repeat(F.lit("x"), (F.col("o_orderkey") % 45 - 2).cast("int"))
    line = F.when(F.col("o_orderkey") % 45 == 0, F.concat(F.lit("BSB 062-000"), F.lit(";"), "s")).otherwise(
        F.concat(F.lit("BSB 062-000"), F.when(F.col("o_orderkey") % 45 == 1, " ").otherwise(F.concat(F.lit(" "), gap, F.lit(" "))), "s")
    )
    found = detect.with_spans(_orders(spark, sf_dir, 8).withColumn("text", line), settings=Settings(types=("AU_BANK_ACCOUNT",)))
    return found.select("o_orderkey", F.size("spans").alias("n"), F.when(F.size("spans") > 0, F.col("spans")[0]["start"]).alias("start"))


_STATES = ("NSW 2000", "VIC 3000", "QLD 2000", "TAS 7001", "")


@query(
    "SELECT s_suppkey, 4 AS \"start\", CAST(4 + length('12 Kings Road') + CASE s_suppkey % 5 "
    + " ".join(f"WHEN {k} THEN {len(', Mosman ' + s) - (4 if s.startswith('QLD') else 0) - (1 if not s else 0)}" for k, s in enumerate(_STATES))
    + " END AS INTEGER) AS \"end\", CAST(0.85 AS DOUBLE) AS score FROM supplier"
)
def address_postcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with suburbs: a postcode of another state ends the address before it."""
    tail = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("at: 12 Kings Road, Mosman "), tail).alias("text"))
    rows = rows.withColumn("text", F.rtrim("text"))
    return detect.detect(rows, ["s_suppkey"], settings=Settings(types=("AU_ADDRESS",))).select("s_suppkey", "start", "end", "score")


_LABELLED = (
    ("DATE_OF_BIRTH", "dob ", "'1' || o_orderkey % 9 || '/0' || (1 + o_orderkey % 9) || '/19' || (10 + o_orderkey % 90)"),
    ("AU_PASSPORT", "passport ", "'PA' || substr(s, 2, 7)"),
    ("AU_DRIVER_LICENCE", "licence ", "substr(s, 1, 6)"),
)


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS type, labelled, CASE WHEN labelled THEN n ELSE 0 END AS n FROM (SELECT o_orderkey % 2 = 0 AS labelled, count(*) AS n FROM orders GROUP BY 1)" for t, *_ in _LABELLED)
    + " UNION ALL SELECT 'ENGAGEMENT_CODE', o_orderkey % 2 = 0, count(*) FROM orders GROUP BY ALL"
)
def labelled_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth, passports and licences need their label; engagement codes don't."""
    base = _orders(spark, sf_dir, 8)
    parts = []
    for kind, label, sql in (*_LABELLED, ("ENGAGEMENT_CODE", "code ", "'AB-' || substr(s, 3, 6)")):
        line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, label).otherwise("see "), F.expr(sql))
        found = detect.with_spans(base.withColumn("text", line), settings=Settings(types=(kind,)))
        parts.append(found.groupBy((F.col("o_orderkey") % 2 == 0).alias("labelled")).agg(F.sum(F.size("spans")).alias("n")).select(F.lit(kind).alias("type"), "labelled", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""
SELECT 'documents' AS source, doc_id AS id, CAST({_secret_count("text")} AS INTEGER) AS n FROM documents WHERE {_secret_count("text")} > 0
UNION ALL SELECT 'pages', page_id, CAST({_secret_count("html")} AS INTEGER) FROM pages WHERE {_secret_count("html")} > 0
""")
def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"))
    pages = spread(table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    found = detect.with_spans(docs.unionByName(pages), settings=Settings(types=("CREDENTIAL",)))
    return found.select("source", "id", F.size("spans").alias("n")).filter("n > 0")


_MASKED = f"regexp_replace(regexp_replace(text, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g'), '{_SECRETS[0][0]}', '<CREDENTIAL>', 'g')"


def _mask_mail_and_ip(df: DataFrame) -> DataFrame:
    return redact.redact(df, settings=Settings(types=("EMAIL_ADDRESS", "IP_ADDRESS")))


_MASK_SQL = (
    f"regexp_replace(regexp_replace(text, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g'), "
    r"'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\b', '<IP_ADDRESS>', 'g')"
)


@query(f"SELECT doc_id, {_MASK_SQL} AS text FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_mail_and_ip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"SELECT conv_id, turn, {_MASK_SQL} AS text FROM conversations")
def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_mail_and_ip(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '_x00[01][0-9A-Fa-f]_|\x{00A0}', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM pages")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_ws(F.col("html")).alias("text"))


_FORMS = ("Pty Ltd", "PTY. LTD.", "P/L", "Proprietary Limited", "Hldgs Pty Limited", "Noms Ltd.", "Aust. Limited", "PL")
_FOLDED = ("ptyltd", "ptyltd .", "ptyltd", "ptyltd", "holdings ptyltd", "nominees ltd .", "australia . ltd", "ptyltd")
_CORES = ("", " ptyltd .", "", "", " holdings", " nominees ltd .", " australia .", "")


def _pick(words: tuple[str, ...]) -> str:
    return "CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Alder  Creek"), "s_suppkey", F.lit(" "), F.expr(_pick(_FORMS))).alias("name"))


@query(f"SELECT s_suppkey, 'alder creek' || s_suppkey || ' ' || {_pick(_FOLDED)} AS canonical FROM supplier")
def canonicalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("s_suppkey", text.canonicalize(F.col("name")).alias("canonical"))


@query(f"""
SELECT DISTINCT s_suppkey, form FROM (
  SELECT s_suppkey, unnest([lower('alder creek' || s_suppkey || ' ' || {_pick(_FORMS)}), 'alder creek' || s_suppkey || ' ' || {_pick(_FOLDED)},
    'alder creek' || s_suppkey || {_pick(_CORES)}]) AS form FROM supplier)
""")
def forbidden_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("s_suppkey", F.explode(text.forbidden_forms(F.col("name"))).alias("form"))


@query(r"""
WITH forms AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS form FROM benchmark)
SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM forms WHERE contains(lower(regexp_replace(documents.text, '\s+', ' ', 'g')), form))
""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return redact.leaking(docs, table(spark, sf_dir, "benchmark"), term_col="text").select("doc_id")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(?:apache)\W+(?:license)|\b(?:all)\W+(?:rights)\W+(?:reserved)')) AS INTEGER) AS n
FROM documents WHERE regexp_matches(text, '(?i)\b(?:apache)\W+(?:license)|\b(?:all)\W+(?:rights)\W+(?:reserved)')""")
def known_entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = known.known_spans(["Apache License", "All Rights Reserved Pty Ltd", "Ltd"])
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(find(F.col("text"))).alias("n")).filter("n > 0")


@query("""
WITH m AS (SELECT source, CAST(floor(quantile_cont(n_chars, 0.5)) AS BIGINT) AS median FROM documents GROUP BY source)
SELECT d.source AS document, doc_id AS page, n_chars AS chars, median,
  CASE WHEN n_chars = 0 THEN 'empty' WHEN median > 0 AND n_chars < median * 0.2 THEN 'sparse' ELSE '' END AS flag
FROM documents d JOIN m ON d.source = m.source
""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.col("n_chars").alias("chars"))
    return scan.page_coverage(pages)


def _profile_sql(columns: dict[str, str], of: str) -> str:
    out = []
    for name, kind in columns.items():
        if kind in ("id", "number"):
            lo, hi, distinct = f"CAST(min({name}) AS DOUBLE)", f"CAST(max({name}) AS DOUBLE)", "0"
        else:
            lo, hi, distinct = "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", f"count(DISTINCT {name})" if kind == "text" else "0 * count(*)"
        out.append(f"SELECT '{name}' AS header, '{kind}' AS kind, CAST(0 AS DOUBLE) AS nulls, {lo} AS minimum, {hi} AS maximum, CAST({distinct} AS BIGINT) AS \"distinct\" FROM {of}")
    return " UNION ALL ".join(out)


_ORDERS = {"o_orderkey": "id", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"}
_SHAPE = ("header", "kind", "nulls", "minimum", "maximum", "distinct")


@query(_profile_sql(_ORDERS, "orders"))
def column_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "orders"), "o_orderkey").select(*_SHAPE)


@query(_profile_sql({"c_custkey": "id", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}, "customer"))
def column_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "customer"), "c_custkey").select(*_SHAPE)


@query("""
SELECT 'sheet ' || n_regionkey AS sheet, CAST(2 + n_regionkey AS BIGINT) AS header_row FROM nation GROUP BY n_regionkey
""")
def header_row_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids whose header, with more strings than the rows around it, stands in a row of its own."""
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.concat(F.lit("sheet "), "n_regionkey").alias("sheet"), "n_regionkey", "n_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("row"))
    cell = F.when(F.col("row") == F.col("n_regionkey") + 2, F.col("n_name")).when(F.col("row") == F.col("n_regionkey") + 5, F.when(F.col("n_name") < "M", F.col("n_name")))
    return profile.header_row(rows.select("sheet", "row", cell.alias("text")))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{k}' AS type, CAST(0 AS DOUBLE) AS nulls, count(*) AS \"rows\", least(count(*), 2000) AS twin_rows FROM orders" for c, k in _ORDERS.items()
    )
)
def twin_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.twin_schema(table(spark, sf_dir, "orders"), "o_orderkey")


@query()
def twin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin of the orders: made-up values, so SQL has nothing to compare."""
    return profile.twin(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT CAST(NULL AS VARCHAR) AS \"column\", CAST(NULL AS VARCHAR) AS value WHERE false")
def twin_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the twin that are in the orders: none."""
    orders = table(spark, sf_dir, "orders")
    return profile.twin_leaks(orders, profile.twin(orders, "o_orderkey"), ["o_orderstatus", "o_orderpriority"])


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A key with an item for each order, and what a detector that misses some of them found."""
    k = F.col("o_orderkey")
    base = _orders(spark, sf_dir, 8)
    key = base.select(
        (k % 50).cast("string").alias("document"),
        F.when(k % 3 == 0, "AU_TFN").otherwise("EMAIL_ADDRESS").alias("type"),
        F.concat(F.lit("v"), "s").alias("value"),
        F.when(k % 7 == 0, "suppress").when(k % 7 == 1, "gap").otherwise("detect").alias("expected"),
        F.lit("").alias("note"),
    )
    value = F.when(k % 5 == 0, F.concat(F.lit("<v"), "s", F.lit(">"))).when(k % 5 == 1, F.substring("s", 3, 6)).when(k % 5 == 2, F.substring("s", 6, 3)).otherwise(F.concat(F.lit("z"), "s"))
    found = base.select((k % 50).cast("string").alias("document"), F.lit("X").alias("entity_type"), value.alias("text"), F.concat(F.lit("line "), "o_orderkey").alias("locator"), F.lit(1.0).alias("score"))
    return key, found


_PLANTED_SQL = """
base AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS s FROM orders),
key AS (SELECT k, k % 50 AS document, CASE WHEN k % 3 = 0 THEN 'AU_TFN' ELSE 'EMAIL_ADDRESS' END AS type, 'v' || s AS value,
  CASE k % 7 WHEN 0 THEN 'suppress' WHEN 1 THEN 'gap' ELSE 'detect' END AS expected FROM base),
found AS (SELECT k, k % 50 AS document, CASE k % 5 WHEN 0 THEN '<v' || s || '>' WHEN 1 THEN substr(s, 3, 6) WHEN 2 THEN substr(s, 6, 3) ELSE 'z' || s END AS text FROM base),
scored AS (SELECT key.*, EXISTS (SELECT 1 FROM found f WHERE f.document = key.document AND (contains(f.text, key.value) OR (contains(key.value, f.text) AND length(f.text) >= 4))) AS caught FROM key)
"""


@query(f"""
WITH {_PLANTED_SQL}
SELECT type, count(*) FILTER (WHERE expected = 'detect') AS n_detect, count(*) FILTER (WHERE expected = 'detect' AND caught) AS n_caught,
  count(*) FILTER (WHERE expected = 'suppress') AS n_suppress, count(*) FILTER (WHERE expected = 'suppress' AND NOT caught) AS n_suppressed,
  count(*) FILTER (WHERE expected = 'gap') AS n_gap, count(*) FILTER (WHERE expected = 'gap' AND caught) AS n_gap_caught,
  round(count(*) FILTER (WHERE expected = 'detect' AND caught) / count(*) FILTER (WHERE expected = 'detect'), 3) AS recall
FROM scored GROUP BY ROLLUP (type)
""")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(evaluate.caught(*_planted(spark, sf_dir)))


@query(f"""
WITH {_PLANTED_SQL},
wrong AS (SELECT count(*) AS n FROM found f WHERE NOT EXISTS (SELECT 1 FROM key WHERE key.document = f.document AND (contains(f.text, key.value) OR contains(key.value, f.text))))
SELECT count(*) AS n, any_value(wrong.n) AS n_false, round((count(*) - any_value(wrong.n)) / count(*), 3) AS precision FROM found, wrong
""")
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision(*_planted(spark, sf_dir))


@query("""
WITH g AS (SELECT o_orderkey AS record, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS type, o_orderkey % 20 AS s, o_orderkey % 20 + 5 AS e FROM orders),
f AS (SELECT o_orderkey AS record, o_orderkey % 13 AS s, o_orderkey % 13 + 3 AS e FROM orders)
SELECT type, count(*) AS n, count(*) FILTER (WHERE hit) AS n_caught, round(count(*) FILTER (WHERE hit) / count(*), 3) AS recall
FROM (SELECT g.type, EXISTS (SELECT 1 FROM f WHERE f.record = g.record AND f.s < g.e AND g.s < f.e) AS hit FROM g) GROUP BY type
""")
def span_overlap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    gold = orders.select(k.alias("record"), F.when(k % 3 == 0, "A").otherwise("B").alias("type"), (k % 20).alias("start"), (k % 20 + 5).alias("end"))
    found = orders.select(k.alias("record"), (k % 13).alias("start"), (k % 13 + 3).alias("end"))
    return evaluate.span_recall(gold, found)


_RULES = (("*/en/*", "confidential"), ("*/de/*", "restricted"), ("*.org/*", "internal"), ("*page=?*", "public"))


@query("""
SELECT page_id, CASE WHEN lower(url) LIKE '%page=_%' THEN 'public' WHEN lower(url) LIKE '%.org/%' THEN 'internal'
  WHEN lower(url) LIKE '%/de/%' THEN 'restricted' WHEN lower(url) LIKE '%/en/%' THEN 'confidential' ELSE 'public' END AS label,
  (lower(url) NOT LIKE '%page=_%' AND lower(url) NOT LIKE '%.org/%' AND (lower(url) LIKE '%/de/%' OR lower(url) LIKE '%/en/%')) AS blocked
FROM pages
""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", policy.label(url, _RULES).alias("label"), policy.blocked(url, _RULES).alias("blocked"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY event_type")
def safe_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a protected table; strings of the result are masked."""
    sql = "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY event_type"
    return compute.safe_query(sql, {"events": table(spark, sf_dir, "events")})


@query(f"""
WITH each AS (SELECT doc_id, {_typed("text")} FROM documents),
hit AS (SELECT doc_id, ("CREDENTIAL" + "CREDIT_CARD" + "EMAIL_ADDRESS" + "IP_ADDRESS" + "PHONE_NUMBER") > 0 AS sensitive FROM each)
SELECT quality, sensitive, count(*) AS n FROM hit JOIN labels ON hit.doc_id = labels.doc_id GROUP BY ALL
""")
def quality_by_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hit = detect.with_spans(docs, settings=_COMMON).select("doc_id", (F.size("spans") > 0).alias("sensitive"))
    return hit.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "sensitive").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {_LUHN.format(d='s')} AS card_ok FROM {_orders_sql(16, 999999937)}")
def card_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 16, 999999937).select("o_orderkey", checksums.valid_card(F.col("s")).alias("card_ok"))


@query(f"SELECT o_orderkey, CAST(s || '161100' AS HUGEINT) % 97 = 1 AS iban_ok FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 31 AS VARCHAR), 18, '0') || '1314' AS s FROM orders)".replace("|| '161100'", "|| '00'"))
def iban_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as accounts of a country: those with the right remainder pass."""
    account = F.lpad((F.col("o_orderkey") * 31).cast("string"), 18, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.valid_iban(F.concat(F.lit("DE00"), account)).alias("iban_ok"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sensitive data is where: types and how many of each, over all documents."""
    return scan_counts_by_type(spark, sf_dir)

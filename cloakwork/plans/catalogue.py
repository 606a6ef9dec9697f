"""The library's own queries by name, each with the SQL it is held against.

Shapes that no table holds are tested on carrier texts built from key columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions.lineage import scratch, stored
from cloakwork.functions.spans import find_all, overlaps, piece
from cloakwork.functions.values import VERHOEFF_D, VERHOEFF_P, date_of_birth, luhn_valid, normalized, upper_each
from cloakwork.operators import audit, evaluate, pseudonyms, recognizers, redact, validate
from cloakwork.operators.recognizers import Rule, deny_rules, spans
from cloakwork.operators.resolve import admitted, detect, entity_rows
from cloakwork.plans import bundle, sql
from cloakwork.sources import annotations, ooxml, store
from cloakwork.sources.ooxml import grey_png, package_from
from cloakwork.sources.tables import html_units, line_units, read, text_units
from cloakwork.streaming.stream import windowed_counts

SEED = 17
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "resolved_span_counts"

EMAIL = next(r for r in recognizers.RULES if r.recognizer == "email")
IPV4 = next(r for r in recognizers.RULES if r.recognizer == "IPv4")
CARD = next(r for r in recognizers.RULES if r.recognizer == "credit card")
US_PHONE = Rule("PHONE_NUMBER", "US phone", r"\+1 \([2-9]\d{2}\) \d{3}-\d{4}", 0.65)
LONG_NUMBER = Rule("IN_PAN", "long number", r"\b\d{12,19}\b", 0.9)
MAIL_HOST = Rule("ORGANIZATION", "mail host", r"\bmail\d+\.example\.com\b", 0.8)
#: Rules that documents hold hits of, some of them overlapping.
CORE = (EMAIL, US_PHONE, CARD, IPV4, LONG_NUMBER, MAIL_HOST)
CORE_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "IN_PAN", "ORGANIZATION")
IPV4_OK = "list_bool_and(list_transform(string_split(value, '.'), lambda o: CAST(o AS INT) <= 255))"
#: Context can't raise a score here: no cue words stand in the tables' invented prose but by chance.
CORE_BARE = tuple(Rule(r.entity_type, r.recognizer, r.pattern, r.score, (), r.valid, r.confirms, flags=r.flags, only=r.only) for r in CORE)
CORE_SQL = "WITH " + sql.candidates_cte(CORE_BARE, {"credit card": (sql.luhn("value"), 1.0), "IPv4": (IPV4_OK, 0.6)})
RESOLVED_SQL = CORE_SQL + "," + sql.resolved_ctes()


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def doc_units(spark: SparkSession, d: str) -> DataFrame:
    return text_units(read(spark, d, "documents"))


def core_detected(spark: SparkSession, d: str) -> DataFrame:
    return detect(doc_units(spark, d), rules=CORE_BARE)


def core_rows(spark: SparkSession, d: str) -> DataFrame:
    return entity_rows(core_detected(spark, d), ["doc_id", "unit_no"])


def core_mappings(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.mapped(core_rows(spark, d), SEED, unicode=False)


def rule_spans(name: str, rule: Rule) -> None:
    """A query of one rule's pattern over documents, before any check."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = read(spark, d, "documents").select("doc_id", "text")
        hits = docs.select("doc_id", F.explode_outer(find_all(F.col("text"), rule.flags + rule.pattern)).alias("h")).where("h is not null")
        return hits.select("doc_id", "h.start", "h.end", "h.value")

    run.__name__ = name
    query(sql.span_select("documents", "doc_id", "text", rule.flags + rule.pattern))(run)


for _name, _rule in (("email_spans", EMAIL), ("ipv4_spans", IPV4), ("phone_spans", US_PHONE), ("card_spans", CARD)):
    rule_spans(_name, _rule)


@query(f"SELECT doc_id, start, value FROM ({sql.span_select('documents', 'doc_id', 'text', CARD.flags + CARD.pattern)}) x WHERE {sql.luhn('value')}")
def card_luhn_valid(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["card_spans"](spark, d).where(luhn_valid(F.col("value"))).select("doc_id", "start", "value")


def carrier(spark: SparkSession, d: str, table: str, key: str, text: Column) -> DataFrame:
    return read(spark, d, table).select(F.col(key).cast("bigint").alias("k"), text.alias("text"))


def carried(spark: SparkSession, units: DataFrame, rule: Rule) -> DataFrame:
    return spans(units, [rule], ["k"]).select("k", "start", "end", "score", "value", "context")


def padded(col: str, width: int, factor: int = 1) -> Column:
    return F.lpad((F.col(col) * factor % 10**width).cast("string"), width, "0")


def sql_padded(col: str, width: int, factor: int = 1) -> str:
    return f"lpad(CAST({col} * {factor} % {10**width} AS VARCHAR), {width}, '0')"


SSN_SQL = f"concat({sql_padded('c_custkey', 3, 7)}, '-', {sql_padded('c_custkey', 2, 3)}, '-', {sql_padded('c_custkey', 4, 31)})"


@query(
    f"SELECT CAST(c_custkey AS BIGINT) AS k, s AS value, CAST(0.85 AS DOUBLE) AS score FROM (SELECT c_custkey, {SSN_SQL} AS s FROM customer) "
    "WHERE s[1:3] NOT IN ('000','666') AND s[1:1] <> '9' AND s[5:6] <> '00' AND s[8:11] <> '0000'"
)
def ssn_rule(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat_ws("-", padded("c_custkey", 3, 7), padded("c_custkey", 2, 3), padded("c_custkey", 4, 31))
    rule = next(r for r in recognizers.RULES if r.recognizer == "social security number")
    found = carried(spark, carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("her SSN: "), number)), rule)
    return found.select("k", "value", "score")


PAN_SQL = f"concat(CASE WHEN c_custkey % 3 = 0 THEN 'ABCXK' ELSE 'ABCPK' END, {sql_padded('c_custkey', 4)}, 'Z')"


@query(
    f"SELECT CAST(c_custkey AS BIGINT) AS k, {PAN_SQL} AS value, "
    "CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.60 ELSE 0.85 END AS DOUBLE) AS score FROM customer"
)
def pan_rule(spark: SparkSession, d: str) -> DataFrame:
    """The strict and the loose shape; the resolver keeps the better."""
    value = F.concat(F.when(F.col("c_custkey") % 3 == 0, "ABCXK").otherwise("ABCPK"), padded("c_custkey", 4), F.lit("Z"))
    rules = [Rule(r.entity_type, r.recognizer, r.pattern, r.score) for r in recognizers.RULES if r.entity_type == "IN_PAN"]
    units = carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("ref "), value, F.lit(".")))
    return entity_rows(detect(units, rules=rules), ["k"]).select("k", "value", "score")


@query(
    f"SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(13 AS INT) AS start, concat('L', {sql_padded('o_orderkey', 5)}, 'MH2020PLC', {sql_padded('o_orderkey', 6, 7)}) AS value "
    "FROM orders WHERE o_orderkey % 2 = 0"
)
def cin_rule(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderkey") % 2 == 0, "MH").otherwise("M1")  # a digit breaks the shape
    text = F.concat(F.lit("registered: ("), F.lit("L"), padded("o_orderkey", 5), state, F.lit("2020PLC"), padded("o_orderkey", 6, 7), F.lit(")"))
    rule = next(r for r in recognizers.RULES if r.entity_type == "IN_CIN")
    return carried(spark, carrier(spark, d, "orders", "o_orderkey", text), rule).select("k", "start", "value")


@query(
    f"SELECT CAST(o_orderkey AS BIGINT) AS k, {sql_padded('o_orderkey', 8, 12345)} AS value, "
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.80 ELSE 0.45 END AS DOUBLE) AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'din' END AS context FROM orders"
)
def din_context(spark: SparkSession, d: str) -> DataFrame:
    cue = F.when(F.col("o_orderkey") % 3 == 0, "the director's DIN is ").otherwise("the order is ")
    rule = next(r for r in recognizers.RULES if r.entity_type == "IN_DIN")
    units = carrier(spark, d, "orders", "o_orderkey", F.concat(cue, padded("o_orderkey", 8, 12345)))
    # 0.45 + 0.35 is rounded as a score that is reported, not compared.
    return carried(spark, units, rule).select("k", "value", F.round("score", 2).alias("score"), "context")


AADHAAR_SQL = f"concat('2', {sql_padded('c_custkey', 3, 13)}, ' ', {sql_padded('c_custkey', 4, 17)}, ' ', {sql_padded('c_custkey', 4, 19)})"


@query(
    f"WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS k, {AADHAAR_SQL} AS value FROM customer), "
    f"s AS (SELECT k, value, replace(value, ' ', '') AS n, {sql.listed(VERHOEFF_D)} AS d, {sql.listed(VERHOEFF_P)} AS p FROM t) "
    "SELECT k, value, CAST(1.0 AS DOUBLE) AS score FROM s WHERE list_reduce(list_transform(range(0, len(n)), "
    "lambda i: CAST(p[CAST(i % 8 AS INT) + 1][CAST(n[len(n) - i] AS INT) + 1] AS INT)), lambda c, x: CAST(d[c + 1][x + 1] AS INT)) = 0"
)
def aadhaar_verhoeff(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Aadhaar: 2"), padded("c_custkey", 3, 13), F.lit(" "), padded("c_custkey", 4, 17), F.lit(" "), padded("c_custkey", 4, 19))
    rule = next(r for r in recognizers.RULES if r.entity_type == "IN_AADHAAR")
    return carried(spark, carrier(spark, d, "customer", "c_custkey", text), rule).select("k", "value", "score")


@query(
    "SELECT CAST(o_orderkey AS BIGINT) AS k, strftime(o_orderdate, '%-d %B %Y') AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'born' ELSE 'dob' END AS context, "
    "CAST(o_orderdate AS DATE) AS born FROM orders WHERE o_orderkey % 4 IN (0, 1)"
)
def dob_context(spark: SparkSession, d: str) -> DataFrame:
    cue = (
        F.when(F.col("o_orderkey") % 4 == 0, "She was born on ").when(F.col("o_orderkey") % 4 == 1, "DOB ").otherwise("Signed on ")
    )
    text = F.concat(cue, F.date_format(F.col("o_orderdate"), "d MMMM yyyy"), F.lit("."))
    rule = next(r for r in recognizers.RULES if r.recognizer == "birth date, named month")
    found = carried(spark, carrier(spark, d, "orders", "o_orderkey", text), rule)
    return found.select("k", "value", "context", date_of_birth(F.col("value")).alias("born"))


STREET_SQL = "concat(CAST(c_custkey % 900 + 1 AS VARCHAR), ' MG Road, Bengaluru, Karnataka 5600', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'))"


@query(
    f"SELECT k, CAST(strpos(t, v) - 1 AS INT) AS start, v AS value FROM (SELECT CAST(c_custkey AS BIGINT) AS k, {STREET_SQL} AS v, "
    f"concat('Send it to ', {STREET_SQL}) AS t FROM customer)"
)
def address_spans(spark: SparkSession, d: str) -> DataFrame:
    street = F.concat((F.col("c_custkey") % 900 + 1).cast("string"), F.lit(" MG Road, Bengaluru, Karnataka 5600"), padded("c_custkey", 2))
    rule = next(r for r in recognizers.RULES if r.recognizer == "street address")
    units = carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("Send it to "), street))
    return carried(spark, units, rule).select("k", "start", "value")


POSTAL_SQL = "concat('Plot No. ', CAST(c_custkey % 90 + 1 AS VARCHAR), ', Gandhi Nagar Lane, Jaipur 302 ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'))"


@query(f"SELECT CAST(c_custkey AS BIGINT) AS k, CAST(9 AS INT) AS start, {POSTAL_SQL} AS value, CAST(1.0 AS DOUBLE) AS score, 'address' AS context FROM customer")
def postal_spans(spark: SparkSession, d: str) -> DataFrame:
    plot = F.concat(F.lit("Plot No. "), (F.col("c_custkey") % 90 + 1).cast("string"), F.lit(", Gandhi Nagar Lane, Jaipur 302 "), padded("c_custkey", 3))
    rule = next(r for r in recognizers.RULES if r.recognizer == "Indian postal address")
    units = carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("Address: "), plot))
    return carried(spark, units, rule).select("k", "start", "value", "score", "context")


def birth_query(name: str, recognizer: str, spark_format: str, sql_format: str, text_format: str) -> None:
    """Birth dates of another shape after a cue; without one there are none."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        cue = F.when(F.col("o_orderkey") % 2 == 0, "date of birth: ").otherwise("paid on ")
        text = F.concat(cue, F.date_format(F.col("o_orderdate"), spark_format), F.lit(text_format))
        rule = next(r for r in recognizers.RULES if r.recognizer == recognizer)
        found = carried(spark, carrier(spark, d, "orders", "o_orderkey", text), rule)
        return found.select("k", "value", "context", date_of_birth(F.col("value")).alias("born"))

    run.__name__ = name
    query(
        f"SELECT CAST(o_orderkey AS BIGINT) AS k, strftime(o_orderdate, '{sql_format}') AS value, 'date of birth' AS context, CAST(o_orderdate AS DATE) AS born "
        "FROM orders WHERE o_orderkey % 2 = 0"
    )(run)


birth_query("dob_day_first", "birth date, day first", "d/M/yyyy", "%-d/%-m/%Y", ".")
birth_query("dob_iso", "birth date, ISO", "yyyy-MM-dd", "%Y-%m-%d", ", she said")

#: (lead, digits, digits, gap between them).
PHONE_SHAPES = (("+91 9", 4, 5, " "), ("(415) 55", 1, 4, "-"), ("+44 20 7", 3, 4, " "), ("+ 91 20 4", 3, 4, " "))


def phone_text() -> Column:
    chosen = F
    for k, (lead, a, b, gap) in enumerate(PHONE_SHAPES):
        chosen = chosen.when(F.col("c_custkey") % 4 == k, F.concat(F.lit(lead), padded("c_custkey", a, 7), F.lit(gap), padded("c_custkey", b, 13)))
    return chosen


PHONE_SQL = "CASE c_custkey % 4 " + " ".join(
    f"WHEN {k} THEN concat('{lead}', {sql_padded('c_custkey', a, 7)}, '{gap}', {sql_padded('c_custkey', b, 13)})"
    for k, (lead, a, b, gap) in enumerate(PHONE_SHAPES)
) + " END"


@query(f"SELECT CAST(c_custkey AS BIGINT) AS k, CAST(10 AS INT) AS start, {PHONE_SQL} AS value, CAST(0.75 AS DOUBLE) AS score FROM customer")
def phones_by_country(spark: SparkSession, d: str) -> DataFrame:
    """The library's own phone rule: Indian mobile and fixed lines, the United States, Great Britain."""
    rule = next(r for r in recognizers.RULES if r.entity_type == "PHONE_NUMBER")
    units = carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("telephone "), phone_text(), F.lit("; x")))
    return carried(spark, units, rule).select("k", "start", "value", F.round("score", 2).alias("score"))


@query("SELECT CAST(c_custkey AS BIGINT) AS k, CAST(10 AS INT) AS start, concat('2001:db8::', lower(to_hex(c_custkey)), ':1') AS value FROM customer WHERE c_custkey % 3 > 0")
def ipv6_rule(spark: SparkSession, d: str) -> DataFrame:
    """Valid addresses only: every third has two gaps."""
    value = F.concat(F.when(F.col("c_custkey") % 3 == 0, "2001::db8::").otherwise("2001:db8::"), F.lower(F.hex("c_custkey")), F.lit(":1"))
    rule = next(r for r in recognizers.RULES if r.recognizer == "IPv6")
    units = carrier(spark, d, "customer", "c_custkey", F.concat(F.lit("served by "), value, F.lit(" now")))
    return carried(spark, units, rule).select("k", "start", "value")


LETTER_MAIL, LETTER_PAN = "concat('a.', CAST(c_custkey AS VARCHAR), '@example.co')", f"concat('ABCPK', {sql_padded('c_custkey', 4)}, 'Z')"
LETTER_IP = "concat('10.0.', CAST(c_custkey % 200 AS VARCHAR), '.7')"


@query(
    " UNION ALL ".join(
        f"SELECT CAST(c_custkey AS BIGINT) AS k, '{kind}' AS entity_type, {value} AS value, CAST({score} AS DOUBLE) AS score, {context} AS context FROM customer"
        for kind, value, score, context in (
            ("PERSON", "'Asha Rao'", 0.85, "CAST(NULL AS VARCHAR)"),
            ("EMAIL_ADDRESS", LETTER_MAIL, 1.0, "'email'"),
            ("IN_PAN", LETTER_PAN, 1.0, "'pan'"),
            ("IP_ADDRESS", LETTER_IP, 0.95, "'ip'"),
        )
    )
)
def registry_on_letters(spark: SparkSession, d: str) -> DataFrame:
    """The whole registry with its words of context and names, through the resolver."""
    key = F.col("c_custkey").cast("string")
    mail, pan = F.concat(F.lit("a."), key, F.lit("@example.co")), F.concat(F.lit("ABCPK"), padded("c_custkey", 4), F.lit("Z"))
    ip = F.concat(F.lit("10.0."), (F.col("c_custkey") % 200).cast("string"), F.lit(".7"))
    text = F.concat(F.lit("Applicant name: Asha Rao; email "), mail, F.lit("; her PAN: "), pan, F.lit(", seen from ip "), ip, F.lit(" only."))
    found = entity_rows(detect(carrier(spark, d, "customer", "c_custkey", text)), ["k"])
    return found.select("k", "entity_type", "value", F.round("score", 2).alias("score"), "context")


@query(
    "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, least(count(*), 100) AS faked, least(count(*), 100) AS different, greatest(count(*) - 100, 0) AS missing FROM customer GROUP BY c_nationkey"
)
def unique_fakes(spark: SparkSession, d: str) -> DataFrame:
    """A hundred fake phones for a nation's customers: collisions are settled until none is left."""
    value = F.concat(F.lit("+91 9"), padded("c_custkey", 9))
    rows = read(spark, d, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("unit_no"), F.col("c_custkey").cast("int").alias("start"), F.lit("PHONE_NUMBER").alias("entity_type"), value.alias("value")
    )
    maps = stored(pseudonyms.mapped(rows, SEED, unicode=False), "mappings")
    counts = maps.groupBy("doc_id").agg(F.count("replacement").alias("faked"), F.count_distinct(F.lower("replacement")).alias("different"))
    missing = pseudonyms.incomplete(maps).select("doc_id", "missing")
    return counts.join(missing, "doc_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


@query()
def documents_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents through both passes with the whole registry, its context and its names."""
    texts, mappings = redact.redact(doc_units(spark, d), SEED)
    counts = mappings.groupBy("doc_id").agg(F.sum("occurrences").alias("occurrences"))
    out = texts.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256")).join(counts, "doc_id", "left")
    return out.withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


DENIED = {"IN_DIN": ["Customer#000000001", "00000077"]}
DENIED_SQL = "CASE WHEN c_name = 'Customer#000000001' THEN c_name WHEN c_custkey = 77 THEN '00000077' END"


@query(
    f"SELECT CAST(c_custkey AS BIGINT) AS k, CAST(8 AS INT) AS start, {DENIED_SQL} AS value, CAST(1.0 AS DOUBLE) AS score FROM customer WHERE {DENIED_SQL} IS NOT NULL"
)
def denylist_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whole listed values, with no word of context; a longer number that holds one is none."""
    eight = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    text = F.concat(F.lit("Ref no. "), F.when(F.col("c_custkey") == 77, eight).otherwise(F.col("c_name")), F.lit("; x"), eight)
    units = carrier(spark, d, "customer", "c_custkey", text)
    return spans(units, deny_rules(DENIED), ["k"]).select("k", "start", "value", "score")


@query(sql.span_select("(SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS text FROM pages) p", "page_id", "text", EMAIL.flags + EMAIL.pattern))
def pages_email_spans(spark: SparkSession, d: str) -> DataFrame:
    units = html_units(read(spark, d, "pages"))
    hits = units.select("page_id", F.explode_outer(find_all(F.col("text"), EMAIL.flags + EMAIL.pattern)).alias("h")).where("h is not null")
    return hits.select("page_id", "h.start", "h.end", "h.value")


SPAN_COLUMNS = ["doc_id", "entity_type", "start", "end", "score", "recognizer", "value"]


@query(CORE_SQL + ' SELECT doc_id, entity_type, start, "end", score, recognizer, value FROM cand')
def all_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spans(doc_units(spark, d), CORE_BARE, ["doc_id"]).select(*SPAN_COLUMNS)


@query(RESOLVED_SQL + ' SELECT doc_id, entity_type, start, "end", score, recognizer, value FROM adm')
def admitted_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = recognizers.with_candidates(doc_units(spark, d), CORE_BARE)
    kept = found.select("doc_id", "text", F.explode_outer(F.filter("candidates", lambda c: admitted(F.col("text"), c))).alias("c")).where("c is not null")
    return kept.select("doc_id", "c.*", piece(F.col("text"), F.col("c.start"), F.col("c.end")).alias("value")).select(*SPAN_COLUMNS)


@query(
    CORE_SQL + ' SELECT a.doc_id, a.recognizer AS one, b.recognizer AS other, a.start AS one_start, b.start AS other_start FROM cand a JOIN cand b '
    'ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal AND a.start < b."end" AND b.start < a."end"'
)
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of different rules that overlap: pairs within the short array of a text."""
    found = recognizers.with_candidates(doc_units(spark, d), CORE_BARE).select("doc_id", "candidates")
    each = found.select("doc_id", "candidates", F.explode_outer("candidates").alias("a")).where("a is not null")
    over = F.filter("candidates", lambda b: (F.col("a.ordinal") < b["ordinal"]) & overlaps(F.col("a"), b))
    pairs = each.select("doc_id", "a", F.explode(over).alias("b"))
    return pairs.select("doc_id", F.col("a.recognizer").alias("one"), F.col("b.recognizer").alias("other"), F.col("a.start").alias("one_start"), F.col("b.start").alias("other_start"))


@query(RESOLVED_SQL + ' SELECT doc_id, entity_type, start, "end", score, recognizer, value FROM res')
def resolved_spans(spark: SparkSession, d: str) -> DataFrame:
    return core_rows(spark, d).select(*SPAN_COLUMNS)


@query(RESOLVED_SQL + " SELECT entity_type, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM res GROUP BY entity_type")
def resolved_span_counts(spark: SparkSession, d: str) -> DataFrame:
    return core_rows(spark, d).groupBy("entity_type").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("docs"))


@query(RESOLVED_SQL + " SELECT doc_id, entity_type, start, score FROM res QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) = 1")
def top_span_per_doc(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "start")
    ranked = core_rows(spark, d).withColumn("n", F.row_number().over(best)).where("n = 1")
    return ranked.select("doc_id", "entity_type", "start", "score")


NORMAL_SQL = RESOLVED_SQL + f", norm AS (SELECT *, {sql.normal_form('entity_type', 'value')} AS normalized_original FROM res)"
MAPPING_SQL = NORMAL_SQL + (
    ", maps AS (SELECT doc_id, entity_type, normalized_original, arg_min(value, start) AS original, count(*) AS occurrences, "
    f"{sql.fake_by_type(CORE_TYPES, 'entity_type', sql.seed(SEED, 'entity_type', 'normalized_original'))} AS replacement "
    "FROM norm GROUP BY doc_id, entity_type, normalized_original)"
)


@query(MAPPING_SQL + " SELECT doc_id, entity_type, original, normalized_original, replacement, occurrences FROM maps")
def mapping_table(spark: SparkSession, d: str) -> DataFrame:
    return core_mappings(spark, d).drop("first_no")


@query(MAPPING_SQL + " SELECT entity_type, occurrences, count(*) AS n FROM maps GROUP BY entity_type, occurrences")
def occurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    return core_mappings(spark, d).groupBy("entity_type", "occurrences").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS BIGINT) AS k, regexp_replace(concat(c_name, ' (', CAST(c_nationkey AS VARCHAR), ')'), '[^0-9]', '', 'g') AS normalized FROM customer")
def normalized_digits(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat("c_name", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")"))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), normalized(F.lit("PHONE_NUMBER"), value).alias("normalized"))


@query("SELECT CAST(p_partkey AS BIGINT) AS k, lower(concat(p_name, ' ', p_brand)) AS normalized FROM part")
def normalized_casefold(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_brand", F.lit(" "))
    return read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"), normalized(F.lit("PERSON"), value).alias("normalized"))


@query(f"SELECT CAST(c_custkey AS BIGINT) AS k, {sql.seed(SEED, chr(39) + 'PERSON' + chr(39), 'lower(c_name)')} AS seed FROM customer")
def seed_values(spark: SparkSession, d: str) -> DataFrame:
    seeds = pseudonyms.seed_hash(SEED, F.lit("PERSON"), F.lower("c_name"), F.lit(0))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), seeds.alias("seed"))


def fake_query(name: str, entity_type: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        made = pseudonyms.generated(SEED, F.lit(entity_type), key, F.lit(0))
        return read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), made.alias("fake"))

    run.__name__ = name
    n = sql.seed(SEED, f"'{entity_type}'", "CAST(c_custkey AS VARCHAR)")
    query(f"SELECT CAST(c_custkey AS BIGINT) AS k, {sql.fake(entity_type, 'n')} AS fake FROM (SELECT c_custkey, {n} AS n FROM customer)")(run)


for _type in sql.FAKED:
    fake_query(f"fake_{_type.lower()}", _type)


REDACTED_SQL = MAPPING_SQL + (
    ", fakes AS (SELECT n.doc_id, list({'s': n.start, 'e': n.\"end\", 'f': m.replacement} ORDER BY n.start) AS r FROM norm n "
    "JOIN maps m USING (doc_id, entity_type, normalized_original) GROUP BY n.doc_id)"
    ", redacted AS (SELECT d.doc_id, d.text AS source, CASE WHEN r IS NULL THEN d.text ELSE concat(array_to_string(list_transform(range(1, len(r) + 1), "
    "lambda i: concat(substr(d.text, CASE WHEN i = 1 THEN 1 ELSE r[i-1].e + 1 END, r[i].s - CASE WHEN i = 1 THEN 0 ELSE r[i-1].e END), r[i].f)), ''), "
    "substr(d.text, r[len(r)].e + 1)) END AS text FROM documents d LEFT JOIN fakes USING (doc_id))"
)


@query(REDACTED_SQL + " SELECT doc_id, sha256(text) AS redacted_sha256, len(text) AS n_chars FROM redacted")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    texts, _ = redact.first_pass(doc_units(spark, d), SEED, rules=CORE_BARE, unicode=False)
    return texts.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.char_length("redacted").cast("bigint").alias("n_chars"))


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey % 4 AS INT) AS hits FROM customer WHERE c_custkey % 4 > 0")
def replay_hits(spark: SparkSession, d: str) -> DataFrame:
    """Names that one pass knows, in upper case, none to three times in another text of the same document."""
    customers = read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("doc_id"), "c_name")
    known = customers.select(
        "doc_id", F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), F.lower("c_name").alias("normalized_original"), F.lit("Asha Rao").alias("replacement")
    )
    signed = F.concat(F.lit("signed by "), F.repeat(F.concat(F.upper("c_name"), F.lit(", ")), (F.col("doc_id") % 4).cast("int")), F.lit("x."))
    texts = customers.select("doc_id", F.lit(0).cast("bigint").alias("unit_no"), signed.alias("redacted"))
    hits = redact.replay_hits(texts, known, unicode=False)
    return hits.groupBy("doc_id").agg(F.count("*").cast("int").alias("hits"))


def two_type_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Orders' statuses and priorities as originals of a customer, under two types."""
    orders = read(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("doc_id"), "o_orderpriority", "o_orderstatus")
    typed = F.when(F.col("o_orderstatus") == "F", "PERSON").otherwise("ORGANIZATION")
    named = orders.select("doc_id", typed.alias("entity_type"), F.col("o_orderpriority").alias("original"), F.lit("5-LOW or not").alias("replacement"))
    return named.distinct()


TWO_TYPES_SQL = (
    "WITH m AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, "
    "o_orderpriority AS original FROM orders)"
)


@query(TWO_TYPES_SQL + " SELECT doc_id, lower(original) AS key, count(DISTINCT entity_type) AS types FROM m GROUP BY doc_id, lower(original) HAVING count(DISTINCT entity_type) > 1")
def ambiguous_originals(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.ambiguous_originals(two_type_mappings(spark, d))


@query(
    TWO_TYPES_SQL + " SELECT doc_id, lower(original) AS key, min(entity_type) AS entity_type FROM m WHERE len(trim(original)) >= 5 "
    "AND strpos('5-low or not', lower(original)) = 0 GROUP BY doc_id, lower(original) HAVING count(DISTINCT entity_type) = 1"
)
def replay_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.replay_dictionary(two_type_mappings(spark, d), unicode=False)


@query(
    f"SELECT CAST(c_custkey AS BIGINT) AS k, {sql.fake('PERSON', 'n')} AS pseudonym, o.n_orders FROM (SELECT c_custkey, "
    f"{sql.seed(SEED, chr(39) + 'PERSON' + chr(39), 'lower(c_name)')} AS n FROM customer) c JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"
)
def customer_name_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    made = pseudonyms.generated(SEED, F.lit("PERSON"), F.lower("c_name"), F.lit(0))
    names = read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), made.alias("pseudonym"))
    orders = read(spark, d, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("k")).agg(F.count("*").alias("n_orders"))
    return names.join(orders, "k")


def eval_sides(spark: SparkSession, d: str) -> tuple[DataFrame, evaluate.Sides]:
    """Cases are documents, by source; gold: exact rules; predicted: the resolver, less precise.

    Both sides are found in one look at the texts and stored, since every metric reads them again.
    """
    docs = read(spark, d, "documents")
    cases = docs.select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("case_id"), "text")
    found = recognizers.with_candidates(detect(cases, rules=CORE_BARE), GOLD)
    sides = {"gold": F.col("candidates"), "pred": F.col("entities")}
    slim = {name: F.transform(spans, lambda c: F.struct(c["entity_type"].alias("entity_type"), c["start"].alias("start"), c["end"].alias("end"))) for name, spans in sides.items()}
    both = stored(found.select("dataset", "case_id", *[c.alias(n) for n, c in slim.items()]).where("size(gold) > 0 or size(pred) > 0"), "sides")
    return cases, evaluate.Sides(*[both.select("dataset", "case_id", F.inline(name)).distinct() for name in sides])


EMAIL_BARE, CARD_BARE, IPV4_BARE = CORE_BARE[0], CORE_BARE[2], CORE_BARE[3]
CARD_GOLD = Rule("CREDIT_CARD", "any card", CARD.pattern, 0.3)
PHONE_GOLD = Rule("PHONE_NUMBER", "any phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", 0.65)
GOLD = (EMAIL_BARE, IPV4_BARE, CARD_GOLD, PHONE_GOLD)
EVAL_SQL = RESOLVED_SQL + (
    ", " + sql.candidates_cte(GOLD, {"IPv4": (IPV4_OK, 0.6)}).replace("cand AS", "gold0 AS", 1)
    + ", gold AS (SELECT DISTINCT d.source AS dataset, CAST(doc_id AS VARCHAR) AS case_id, entity_type, start, \"end\" FROM gold0 JOIN documents d USING (doc_id))"
    ", pred AS (SELECT DISTINCT d.source AS dataset, CAST(doc_id AS VARCHAR) AS case_id, entity_type, start, \"end\" FROM res JOIN documents d USING (doc_id))"
    ", marks AS (SELECT dataset, case_id, entity_type, start, \"end\", CAST(g.g IS NOT NULL AND p.p IS NOT NULL AS BIGINT) AS tp, "
    "CAST(g.g IS NULL AS BIGINT) AS fp, CAST(p.p IS NULL AS BIGINT) AS fn FROM (SELECT *, 1 AS g FROM gold) g FULL JOIN (SELECT *, 1 AS p FROM pred) p "
    "USING (dataset, case_id, entity_type, start, \"end\"))"
    ", lost AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.dataset = g.dataset AND p.case_id = g.case_id AND p.start <= g.start AND p.\"end\" >= g.\"end\"))"
    ", each AS (SELECT m.*, CAST(l.case_id IS NOT NULL AS BIGINT) AS leaked FROM marks m LEFT JOIN lost l USING (dataset, case_id, entity_type, start, \"end\"))"
    ", levels AS (SELECT CASE WHEN grouping(dataset) = 1 THEN 'combined' ELSE dataset END AS dataset, entity_type, "
    "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(leaked) AS BIGINT) AS leaked FROM each GROUP BY CUBE (dataset, entity_type))"
)


@query(EVAL_SQL + " SELECT dataset, entity_type, tp, fp, fn FROM levels")
def eval_tp_fp_fn(spark: SparkSession, d: str) -> DataFrame:
    _, sides = eval_sides(spark, d)
    return evaluate.entity_metrics(*sides).select("dataset", "entity_type", "tp", "fp", "fn")


@query(EVAL_SQL + " SELECT dataset, case_id, entity_type, start, \"end\" FROM lost")
def eval_leakage(spark: SparkSession, d: str) -> DataFrame:
    _, sides = eval_sides(spark, d)
    return evaluate.leaked(*sides)


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


@query(
    EVAL_SQL + f", pr AS (SELECT *, {_sql_ratio('tp', 'tp + fp')} AS p, {_sql_ratio('tp', 'tp + fn')} AS r FROM levels) "
    f"SELECT dataset, entity_type, tp + fn AS support, round(p, 4) AS precision, round(r, 4) AS recall, round({_sql_ratio('2 * p * r', 'p + r')}, 4) AS f1, "
    f"round({_sql_ratio('5 * p * r', '4 * p + r')}, 4) AS f2, leaked, round({_sql_ratio('leaked', 'tp + fn')}, 4) AS leakage_rate FROM pr"
)
def prf_scores(spark: SparkSession, d: str) -> DataFrame:
    _, sides = eval_sides(spark, d)
    scores = evaluate.entity_metrics(*sides)
    ratios = [F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "f2", "leakage_rate")]
    return scores.select("dataset", "entity_type", "support", "leaked", *ratios)


@query(
    EVAL_SQL + ", tok AS (SELECT d.source AS dataset, CAST(doc_id AS VARCHAR) AS case_id, start, \"end\" FROM ("
    + sql.span_select("documents", "doc_id", "text", r"[^\s]+") + ") JOIN documents d USING (doc_id))"
    ", g AS (SELECT t.dataset, t.case_id, t.start, list_sort(list_distinct(list(s.entity_type))) AS l FROM tok t JOIN gold s ON s.dataset = t.dataset AND s.case_id = t.case_id AND s.start < t.\"end\" AND t.start < s.\"end\" GROUP BY ALL)"
    ", p AS (SELECT t.dataset, t.case_id, t.start, list_sort(list_distinct(list(s.entity_type))) AS l FROM tok t JOIN pred s ON s.dataset = t.dataset AND s.case_id = t.case_id AND s.start < t.\"end\" AND t.start < s.\"end\" GROUP BY ALL)"
    ", acc AS (SELECT t.dataset, CAST(coalesce(g.l, []) = coalesce(p.l, []) AS BIGINT) AS ok FROM tok t LEFT JOIN g USING (dataset, case_id, start) LEFT JOIN p USING (dataset, case_id, start))"
    " SELECT coalesce(dataset, 'combined') AS dataset, CAST(sum(ok) AS BIGINT) AS correct, count(*) AS n_tokens, round(sum(ok) / count(*), 4) AS token_accuracy FROM acc GROUP BY ROLLUP (dataset)"
)
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    cases, sides = eval_sides(spark, d)
    out = evaluate.token_accuracy(cases, *sides)
    return out.withColumn("token_accuracy", F.round("token_accuracy", 4))


@query(MAPPING_SQL + " SELECT entity_type, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS mappings FROM maps GROUP BY entity_type")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.type_counts(core_mappings(spark, d))


@query(MAPPING_SQL + " SELECT CAST(sum(occurrences) AS BIGINT) AS total_entities, count(*) AS unique_mappings FROM maps")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_row(core_mappings(spark, d)).select(F.col("total_entities").cast("bigint").alias("total_entities"), F.col("unique_mappings").cast("bigint").alias("unique_mappings"))


@query(
    REDACTED_SQL + ", hay AS (SELECT doc_id, lower(source) AS a, lower(text) AS b FROM redacted), fk AS (SELECT doc_id, list(lower(replacement)) AS f FROM maps GROUP BY doc_id) "
    "SELECT m.doc_id, m.entity_type, m.normalized_original, CAST((len(a) - len(replace(a, lower(original), ''))) // len(original) - (len(b) - len(replace(b, lower(original), ''))) // len(original) AS BIGINT) AS removed "
    "FROM maps m JOIN hay USING (doc_id) JOIN fk USING (doc_id) WHERE len(list_filter(f, lambda x: strpos(x, lower(original)) > 0)) = 0"
)
def removed_occurrences(spark: SparkSession, d: str) -> DataFrame:
    units = doc_units(spark, d)
    texts, mappings = redact.first_pass(units, SEED, rules=CORE_BARE, unicode=False)
    return validate.removed_occurrences(units.select("doc_id", "text"), texts.select("doc_id", F.col("redacted").alias("text")), mappings, unicode=False)


@query(
    RESOLVED_SQL + " SELECT d.lang, d.source, r.entity_type, count(*) AS spans FROM res r JOIN documents d USING (doc_id) GROUP BY CUBE (d.lang, d.source, r.entity_type)"
)
def pii_by_lang_source_cube(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("lang", "source", "text")
    found = entity_rows(detect(docs, rules=CORE_BARE), ["lang", "source"])
    return found.cube("lang", "source", "entity_type").agg(F.count("*").alias("spans"))


@query(
    RESOLVED_SQL + ", n AS (SELECT doc_id, count(*) AS spans FROM res GROUP BY doc_id) SELECT quality, toxic, count(*) AS docs, CAST(coalesce(sum(spans), 0) AS BIGINT) AS spans "
    "FROM labels LEFT JOIN n USING (doc_id) GROUP BY quality, toxic"
)
def pii_rate_by_label(spark: SparkSession, d: str) -> DataFrame:
    counts = core_detected(spark, d).select("doc_id", F.size("entities").cast("bigint").alias("spans")).where("spans > 0")
    labelled = read(spark, d, "labels").join(counts, "doc_id", "left")
    return labelled.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"))


@query(RESOLVED_SQL + " SELECT lang, count(*) AS docs FROM documents d WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.doc_id = d.doc_id) GROUP BY lang")
def docs_without_pii(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    # The spans of a text are in its own row: the anti join needs no shuffle.
    return detect(docs, rules=CORE_BARE).where(F.size("entities") == 0).groupBy("lang").agg(F.count("*").alias("docs"))


# --- Packages and annotation files, made from the tables ---------------------


def sample_packages(spark: SparkSession, d: str) -> DataFrame:
    """A package for each supplier: a mail address over two runs and again in up to three more
    paragraphs, an image, and hidden parts that name the supplier."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), "s_name", "s_nationkey")

    def build(frames):
        for frame in frames:
            made = []
            for k, name, nation in zip(frame["doc_id"], frame["s_name"], frame["s_nationkey"], strict=True):
                again = [[f"write INFO{k}@example.com", f" again {i}"] for i in range(k % 4)]
                parts = ooxml.hidden_parts(name) | {"word/media/image1.png": grey_png(3 + k % 50, 4 + nation)}
                made.append(package_from([["Contact Email: ", f"info{k}", "@example.com", " today."], *again], parts))
            yield frame[["doc_id"]].assign(content=made)

    return rows.mapInPandas(build, "doc_id bigint, content binary")


MAIL_SQL = "concat('info', CAST(s_suppkey AS VARCHAR), '@example.com')"


@query(
    f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(1 + s_suppkey % 4 AS INT) AS mails, CAST(1 + s_suppkey % 4 AS BIGINT) AS occurrences, "
    f"concat('Contact Email: ', {sql.fake('EMAIL_ADDRESS', 'n')}, ' today.') AS first_text, false AS mail_left, CAST(NULL AS VARCHAR) AS fault "
    f"FROM (SELECT s_suppkey, {sql.seed(SEED, chr(39) + 'EMAIL_ADDRESS' + chr(39), MAIL_SQL)} AS n FROM supplier)"
)
def docx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = sample_packages(spark, d)
    output, mappings = bundle.redact_packages(docs, SEED)
    output = stored(output, "packages")
    left = ooxml.searchable_values(output).groupBy("doc_id").agg(F.max(F.lower("text").rlike(r"info\d+@example\.com")).alias("mail_left"))
    units = ooxml.text_units(output).where("unit_kind = 'paragraph' and part = 'word/document.xml'")
    texts = units.groupBy("doc_id").agg(
        F.count_if(F.contains("text", F.lit("@example.invalid"))).cast("int").alias("mails"), F.min(F.struct("unit_no", "text"))["text"].alias("first_text")
    )
    mails = mappings.where("entity_type = 'EMAIL_ADDRESS'").select("doc_id", "occurrences")
    faults = ooxml.package_faults(output)
    found = texts.join(mails, "doc_id").join(left, "doc_id").join(faults, "doc_id", "left")
    return found.select("doc_id", "mails", "occurrences", "first_text", "mail_left", "fault")


@query(
    "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, s_name AS title, '' AS creator, '' AS company, 'https://example.invalid/' AS target, "
    "CAST(0 AS BIGINT) AS private, CAST(8 AS BIGINT) AS parts FROM supplier"
)
def hidden_parts(spark: SparkSession, d: str) -> DataFrame:
    """Scrubbed: people, revision ids, custom properties and targets go, titles stay."""
    docs = sample_packages(spark, d)
    nothing = spark.createDataFrame([], "doc_id bigint, unit_no bigint, replacements array<struct<start:int,end:int,value:string>>")
    rows = ooxml.parts(ooxml.rewrite(docs, nothing)).withColumn("xml", F.when(~F.endswith("name", F.lit(".png")), F.decode("content", "UTF-8")))

    def told(part: str, pattern: str) -> Column:
        return F.max(F.when(F.col("name") == part, F.regexp_extract("xml", pattern, 1)))

    return rows.groupBy("doc_id").agg(
        told("docProps/core.xml", "title>([^<]*)<").alias("title"),
        told("docProps/core.xml", "creator>([^<]*)<").alias("creator"),
        told("docProps/app.xml", "Company>([^<]*)<").alias("company"),
        told("word/_rels/document.xml.rels", 'Target="([^"]*)"').alias("target"),
        F.count_if(F.rlike("xml", F.lit('rsid|custom|author="[^"]'))).alias("private"),
        F.count("*").alias("parts"),
    )


@query("SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(3 + s_suppkey % 50 AS INT) AS width, CAST(4 + s_nationkey AS INT) AS height, CAST(NULL AS VARCHAR) AS problem FROM supplier")
def image_neutralize(spark: SparkSession, d: str) -> DataFrame:
    """Sizes stay, bytes go: the samples' pictures carry more bytes than a placeholder."""
    docs = ooxml.media(sample_packages(spark, d))

    def swap(frames):
        for frame in frames:
            # A placeholder replaces other bytes than its own: note them beside the picture.
            yield frame.assign(content=[bytes(c) + b"comment" for c in frame["content"]])

    def neutral(frames):
        for frame in frames:
            yield frame.assign(content=[ooxml.neutral_image(bytes(c)) for c in frame["content"]])

    schema = docs.schema
    before = docs.mapInPandas(swap, schema)
    after = before.mapInPandas(neutral, schema)
    problems = validate.media_violations(before, after)
    return after.join(problems, ["doc_id", "name"], "left").select("doc_id", "width", "height", "problem")


@query(
    "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CASE s_suppkey % 4 WHEN 1 THEN 'kept' WHEN 2 THEN 'resized' WHEN 3 THEN 'absent' END AS problem FROM supplier WHERE s_suppkey % 4 > 0"
)
def media_faults(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that were left, resized or lost are each found."""
    before = ooxml.media(sample_packages(spark, d))
    case = F.col("doc_id") % 4
    changed = F.when(case == 1, F.col("content")).otherwise(F.concat("content", F.lit(b"x")))
    after = before.where(case != 3).withColumns({"content": changed, "width": F.col("width") + F.when(case == 2, 1).otherwise(0)})
    return validate.media_violations(before, after).select("doc_id", "problem")


@query(MAPPING_SQL + " SELECT doc_id, entity_type, original, normalized_original, replacement, occurrences FROM maps")
def seal_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Mappings sealed by document, opened and read again."""
    mappings = core_mappings(spark, d)
    metadata = mappings.select("doc_id").distinct().select(
        "doc_id", *[F.lit(v).alias(k) for k, v in (("source_sha256", "s"), ("output_sha256", None), ("config_version", "1"), ("model_version", "rules-1"), ("schema_version", "1"))]
    )
    key = store.MappingKey("MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY=")
    again = store.read_mappings(store.opened(store.sealed(store.documents(mappings, metadata), key), key))
    return again.drop("metadata")


@query(
    "SELECT concat('nation ', c_nationkey) AS dataset, CAST(c_custkey AS VARCHAR) AS case_id, 'PERSON' AS entity_type, "
    "CAST(8 + (c_custkey % 3) * (len(c_name) + 5) AS INT) AS start, CAST(8 + (c_custkey % 3) * (len(c_name) + 5) + len(c_name) AS INT) AS \"end\" FROM customer"
)
def annotation_gold(spark: SparkSession, d: str) -> DataFrame:
    """Annotation files, one for each nation, written and read: the first to third occurrence of a name."""
    rows = read(spark, d, "customer")
    text = F.concat(F.lit("Contact "), F.array_join(F.array(*["c_name"] * 3), " and "), F.lit("."))
    entity = F.struct(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value"), (1 + F.col("c_custkey") % 3).cast("int").alias("occurrence"))
    case = F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("made").alias("source"), text.alias("text"), F.array(entity).alias("entities"))
    files = rows.groupBy("c_nationkey").agg(F.collect_list(case).alias("cases"))
    dataset = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    path = f"{scratch(spark, 'annotations')}/files"
    files.select("c_nationkey", F.lit("1").alias("schema_version"), F.create_map(dataset, "cases").alias("datasets")).write.partitionBy("c_nationkey").json(path)
    return annotations.gold(annotations.annotated(spark, path))


@query(
    "SELECT event_type AS entity_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS spans FROM events GROUP BY ALL"
)
def windowed_span_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stream's tumbling windows on a bounded table, where the watermark drops nothing."""
    events = read(spark, d, "events").select(F.col("ts"), F.col("event_type").alias("entity_type"))
    counts = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(MAPPING_SQL + " SELECT doc_id, CAST(sum(occurrences) AS BIGINT) AS total_entities, count(*) AS unique_mappings FROM maps GROUP BY doc_id")
def document_audits(spark: SparkSession, d: str) -> DataFrame:
    return audit.document_audits(core_mappings(spark, d)).select("doc_id", "total_entities", "unique_mappings")


TOLD = "status success; urgent 1-Urgent, others 3-MEDIUM or 5-low"


@query(
    TWO_TYPES_SQL + f" SELECT DISTINCT value FROM (SELECT original AS value FROM m UNION ALL SELECT '5-LOW or not' FROM m) v WHERE len(trim(value)) >= 5 AND strpos(lower('{TOLD}'), lower(value)) > 0"
)
def audit_leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Mapped values that an audit's text tells, whatever their case."""
    return validate.audit_leaks(TOLD, two_type_mappings(spark, d))


@query("SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS unit_no FROM documents)")
def line_text_units(spark: SparkSession, d: str) -> DataFrame:
    return line_units(read(spark, d, "documents")).select("doc_id", "unit_no", "text")


@query("SELECT doc_id, sha256(text) AS expected, sha256(upper(text)) AS found FROM documents WHERE text <> upper(text) AND doc_id % 50 = 0")
def hash_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents that changed against their recorded hash: every fiftieth was changed."""
    docs = read(spark, d, "documents")
    before = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 50 == 0, upper_each(F.col("text"))).otherwise(F.col("text"))
    return validate.hash_mismatches(before, docs.select("doc_id", F.sha2(changed, 256).alias("sha256")))

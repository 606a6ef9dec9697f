"""Builders of the DuckDB SQL that the queries are held against."""

from __future__ import annotations

from collections.abc import Sequence

from cloakwork.operators.pseudonyms import FAMILY_NAMES, GIVEN_NAMES
from cloakwork.operators.recognizers import Rule
from cloakwork.schemas import ENTITY_TYPES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def span_select(table: str, key: str, text: str, pattern: str, extra: str = "") -> str:
    """(key, start, "end", value) of every match: gaps and matches of one pattern, added up."""
    p = quoted(pattern)
    return f"""
    SELECT {key}, CAST(place AS INT) AS start, CAST(place + len(value) AS INT) AS "end", value{extra} FROM (
      SELECT {key}, m[i] AS value,
             list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS place
      FROM (SELECT {key}, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS g FROM {table}
            WHERE regexp_matches({text}, {p})) s, unnest(range(1, len(m) + 1)) AS t(i))"""


LUHN = """list_sum(list_transform(range(1, len({v}) + 1), lambda i:
    CASE WHEN (len({v}) - i) % 2 = 0 THEN CAST({v}[i] AS INT)
         ELSE CASE WHEN CAST({v}[i] AS INT) * 2 > 9 THEN CAST({v}[i] AS INT) * 2 - 9 ELSE CAST({v}[i] AS INT) * 2 END END)) % 10 = 0"""


def luhn(value: str) -> str:
    return LUHN.replace("{v}", f"regexp_replace({value}, '[^0-9]', '', 'g')")


def by_type(column: str, at: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{t}' THEN {n[at]}" for t, n in ENTITY_TYPES.items()) + " END"


def candidates_cte(rules: Sequence[Rule], conditions: dict[str, tuple[str, float]], table: str = "documents", key: str = "doc_id") -> str:
    """``cand`` (key, entity_type, start, end, score, recognizer, ordinal, value)."""
    parts = []
    for k, rule in enumerate(rules):
        where, score = conditions.get(rule.recognizer, ("true", rule.score))
        parts.append(
            f"SELECT {key}, '{rule.entity_type}' AS entity_type, start, \"end\", CAST({score} AS DOUBLE) AS score, "
            f"'{rule.recognizer}' AS recognizer, {k} AS ordinal, value FROM ({span_select(table, key, 'text', rule.flags + rule.pattern)}) x WHERE {where}"
        )
    return "cand AS (" + " UNION ALL ".join(parts) + ")"


def resolved_ctes(key: str = "doc_id") -> str:
    """``adm``: admitted candidates, ``res``: greedily chosen spans, from ``cand``."""
    return f"""
    adm AS (SELECT * FROM cand WHERE score >= {by_type("entity_type", 0)}),
    ranked AS (SELECT {key}, list({{'s': start, 'e': "end", 't': entity_type, 'r': recognizer, 'v': value, 'x': score}}
      ORDER BY score DESC, {by_type("entity_type", 1)} DESC, "end" - start DESC, start, entity_type DESC, ordinal) AS c FROM adm GROUP BY {key}),
    chosen AS (SELECT {key}, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS c FROM ranked),
    res AS (SELECT {key}, u.t AS entity_type, u.s AS start, u.e AS "end", u.x AS score, u.r AS recognizer, u.v AS value
      FROM (SELECT {key}, unnest(c) AS u FROM chosen) q)"""


def normal_form(entity_type: str, value: str) -> str:
    """ASCII values only."""
    return (
        f"CASE WHEN {entity_type} IN ('PHONE_NUMBER','US_SSN','CREDIT_CARD','IN_AADHAAR','IN_DIN') "
        f"THEN regexp_replace({value}, '[^0-9]', '', 'g') WHEN {entity_type} = 'IP_ADDRESS' THEN {value} "
        f"ELSE lower(regexp_replace(trim({value}), '\\s+', ' ', 'g')) END"
    )


def seed(seed_value: int, entity_type: str, value: str, attempt: str = "'0'") -> str:
    material = f"concat('{seed_value}', chr(0), {entity_type}, chr(0), {value}, chr(0), {attempt})"
    return f"CAST(concat('0x', substr(sha256({material}), 1, 15)) AS BIGINT)"


FAKED = tuple(ENTITY_TYPES)


def fake(entity_type: str, n: str) -> str:
    """The first attempt's fake for a type, from the number ``n``."""
    given, family = listed(GIVEN_NAMES), listed(FAMILY_NAMES)
    first = f"{given}[CAST(({n}) % {len(GIVEN_NAMES)} AS INT) + 1]"
    last = f"{family}[CAST((({n}) >> 20) % {len(FAMILY_NAMES)} AS INT) + 1]"

    def numbered(x: str, space: int, width: int, start: int = 0) -> str:
        return f"lpad(CAST(({x}) % {space} + {start} AS VARCHAR), {width}, '0')"

    body = f"concat('000000', {numbered(n, 1_000_000_000, 9)})"
    number = f"concat({body}, list_filter(['0','1','2','3','4','5','6','7','8','9'], lambda d: {luhn(f'concat({body}, d)')})[1])"
    return {
        "PERSON": f"concat({first}, ' ', {last})",
        "EMAIL_ADDRESS": f"concat(lower({first}), '.', lower({last}), {numbered(f'({n}) >> 30', 10_000, 4)}, '@example.invalid')",
        "PHONE_NUMBER": f"concat('+1 202-555-', {numbered(n, 100, 4, 100)})",
        "ORGANIZATION": f"concat({last}, ' ', {numbered(n, 1_000_000, 6)}, ' Test Systems Private Limited')",
        "US_SSN": f"concat('000-', {numbered(n, 99, 2, 1)}, '-', {numbered(f'({n}) >> 20', 9_999, 4, 1)})",
        "CREDIT_CARD": f"array_to_string(list_transform([1, 5, 9, 13], lambda k: substr({number}, k, 4)), ' ')",
        "IP_ADDRESS": f"concat('192.0.2.', CAST(({n}) % 254 + 1 AS VARCHAR))",
        "IN_PAN": f"concat('AAAPA', {numbered(n, 10_000, 4)}, 'A')",
        "IN_DIN": f"concat('DIN-TEST-', {numbered(n, 100_000_000, 8)})",
        "IN_AADHAAR": f"concat('0000 0000 ', {numbered(n, 9_999, 4, 1)})",
        "IN_CIN": f"concat('L00000ZZ2000PLC', {numbered(n, 1_000_000, 6)})",
        "PHYSICAL_ADDRESS": f"concat(CAST(({n}) % 999 + 1 AS VARCHAR), ' Example Road, Test Nagar, Bengaluru, Karnataka 560001')",
        "DATE_OF_BIRTH": f"strftime(DATE '1945-01-01' + CAST(({n}) % 22645 AS INT), '%d %B %Y')",
    }[entity_type]


def fake_by_type(types: Sequence[str], entity_type: str, n: str) -> str:
    return "CASE " + " ".join(f"WHEN {entity_type} = '{t}' THEN {fake(t, n)}" for t in types) + " END"

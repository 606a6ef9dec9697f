"""Recognizers: a table of rules, each a projection from text to an array of scored spans.

All rules run in one narrow stage over the text; no rule shuffles. A rule is a pattern with a
base score; a validator may confirm a hit (score 1) or drop it, and a context word among the five
tokens before a hit raises its score.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.memo import remembered
from cloakwork.functions.spans import find_all, let, piece
from cloakwork.functions.values import date_of_birth, ipv4_valid, ipv6_valid, luhn_valid, ssn_valid, verhoeff_valid
from cloakwork.schemas import CANDIDATE, ENTITY_TYPES

FLAGS = "(?ims)"
CONTEXT_BOOST, CONTEXT_FLOOR, CONTEXT_TOKENS, CONTEXT_CHARS = 0.35, 0.40, 5, 300

# Patterns of the custom recognizers.
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b"
ADDRESS_PATTERN = (
    r"\b(?:[A-Z0-9][A-Za-z0-9 .#/-]{1,40},[ \t]*(?:\r?\n)?){0,2}"
    r"\d{1,5}[A-Za-z]?(?:[ \t]+[A-Za-z0-9.-]+){0,6}[ \t]+"
    r"(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Highway|Nagar)"
    r"(?:,[ \t]*(?:\r?\n)?[A-Za-z][A-Za-z.-]*"
    r"(?:[ \t]+[A-Za-z][A-Za-z.-]*)*){1,3}"
    r"(?:[ \t]+\d{5,6}(?:-\d{4})?)?\b"
)
INDIAN_POSTAL_ADDRESS_PATTERN = (
    r"(?:(?<=Address: )|^)"
    r"(?=[^\n]{10,220}\b(?:Road|Rd|Street|St|Lane|Nagar)\b)"
    r"[A-Z0-9][A-Za-z0-9 .,#/'()–-]{10,220}?"
    r"\b\d{3}[ -]?\d{3}\b"
    r"(?:[ ,–-]+[A-Za-z][A-Za-z ]+){0,2}"
    r"(?=[.;]?(?:$|\n))"
)
DOB_NAMED_MONTH_PATTERN = r"\b(?:0?[1-9]|[12]\d|3[01])\s+[A-Z]{3,9}\s+(?:19|20)\d{2}\b"
DOB_DAY_FIRST_PATTERN = r"\b(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}\b"
DOB_ISO_PATTERN = r"\b(?:19|20)\d{2}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])\b"
DIN_PATTERN = r"\b\d{8}\b"
CIN_PATTERN = r"\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b"
DOB_CUES = ("date of birth", "birth date", "born", "dob")
DOB_CUE_BEFORE, DOB_CUE_AFTER = 40, 10

IPV4_PATTERN = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
IPV6_PATTERN = r"(?<![0-9A-Za-z:.])(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}(?![0-9A-Za-z:.])"
PHONE_PATTERN = (
    r"(?<![\w+.-])(?:"
    r"(?:\+ ?91[- ]?|0)?[6-9]\d{4}[- ]?\d{5}"  # India: mobiles
    r"|(?:\+ ?91[- ]?|0)(?:11|20|22|33|40|44|79|80)[- ]?[2-7]\d{3}[- ]?\d{4}"  # India: fixed lines of large cities
    r"|(?:\+1[- ]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])[2-9]\d{2}[-. ]\d{4}"  # United States
    r"|(?:\+44[- ]?|0)(?:20|1\d{2,3}|7\d{3})[- ]?\d{3,4}[- ]?\d{3,4}"  # Great Britain
    r")(?![\w-])"
)
CARD_PATTERN = r"\b[13456]\d{3}[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b"
SSN_PATTERN = r"\b\d{3}[- .]\d{2}[- .]\d{4}\b"
BARE_SSN_PATTERN = r"\b\d{9}\b"
PAN_PATTERN = r"\b[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]\b"
LOOSE_PAN_PATTERN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
AADHAAR_PATTERN = r"\b\d{4}[- :]?\d{4}[- :]?\d{4}\b"
NAME_WORD = r"[A-Z][a-z'’-]+"
PERSON_PATTERN = (
    r"(?<=\b(?i:name|director|applicant|signatory|person|attention|secretary|officer|chairman|by|mr|mrs|ms|dr|shri|smt)"
    rf"[.:]{{0,1}}[ ]{{1,3}}){NAME_WORD}(?:[ ](?:[A-Z]\.|{NAME_WORD})){{1,3}}"
)
LEGAL_FORM = r"(?:Private Limited|Pvt\.? Ltd\.?|Limited|Ltd\.?|LLP|Incorporated|Inc\.?|Corporation|Corp\.?|PLC|GmbH|Bank|University)(?!\w)"
ORGANIZATION_PATTERN = (
    rf"\b(?!(?:The|This|That|Any|Each|Such|Our|Your|An?)[ ]{LEGAL_FORM})"
    rf"[A-Z][\w&'.-]*(?:[ ](?:(?:of|and|the|for)[ ])?[A-Z&][\w&'.-]*){{0,5}}[ ]{LEGAL_FORM}"
)


@dataclass(frozen=True)
class Rule:
    entity_type: str
    recognizer: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    valid: Callable[[Column], Column] | None = None
    confirms: bool = True  # a valid hit scores 1; otherwise it keeps the base score
    cues: tuple[str, ...] = ()  # words that must be near
    flags: str = FLAGS
    only: Callable[[Column], Column] | None = field(default=None)  # a cheap gate on the text


def _aadhaar(value: Column) -> Column:
    return ~F.rlike(value, F.lit("^[01]")) & verhoeff_valid(value)


RULES: tuple[Rule, ...] = (
    Rule("EMAIL_ADDRESS", "email", EMAIL_PATTERN, 0.85, ("email", "contact"), only=lambda t: F.contains(t, F.lit("@"))),
    Rule("PHYSICAL_ADDRESS", "street address", ADDRESS_PATTERN, 0.75, ("address", "office", "registered", "mailing")),
    Rule("PHYSICAL_ADDRESS", "Indian postal address", INDIAN_POSTAL_ADDRESS_PATTERN, 0.80, ("address", "office", "registered", "mailing")),
    Rule("DATE_OF_BIRTH", "birth date, named month", DOB_NAMED_MONTH_PATTERN, 0.75, (), lambda v: date_of_birth(v).isNotNull(), cues=DOB_CUES),
    Rule("DATE_OF_BIRTH", "birth date, day first", DOB_DAY_FIRST_PATTERN, 0.75, (), lambda v: date_of_birth(v).isNotNull(), cues=DOB_CUES),
    Rule("DATE_OF_BIRTH", "birth date, ISO", DOB_ISO_PATTERN, 0.75, (), lambda v: date_of_birth(v).isNotNull(), cues=DOB_CUES),
    Rule("IN_DIN", "director number", DIN_PATTERN, 0.45, ("din", "director identification number")),
    Rule("IN_CIN", "corporate number", CIN_PATTERN, 0.75, ("cin", "corporate identity number")),
    Rule("PHONE_NUMBER", "phone", PHONE_PATTERN, 0.40, ("phone", "telephone", "mobile", "contact")),
    Rule("CREDIT_CARD", "credit card", CARD_PATTERN, 0.30, ("credit", "card", "visa", "mastercard"), luhn_valid),
    Rule("US_SSN", "social security number", SSN_PATTERN, 0.50, ("social", "security", "ssn"), ssn_valid, confirms=False),
    Rule("US_SSN", "bare social security number", BARE_SSN_PATTERN, 0.05, ("social", "security", "ssn"), ssn_valid, confirms=False),
    Rule("IP_ADDRESS", "IPv4", IPV4_PATTERN, 0.60, ("ip", "ipv4"), ipv4_valid, confirms=False),
    Rule("IP_ADDRESS", "IPv6", IPV6_PATTERN, 0.60, ("ip", "ipv6"), ipv6_valid, confirms=False, only=lambda t: F.contains(t, F.lit(":"))),
    Rule("IN_PAN", "PAN", PAN_PATTERN, 0.85, ("permanent account number", "pan")),
    Rule("IN_PAN", "loose PAN", LOOSE_PAN_PATTERN, 0.60, ("permanent account number", "pan")),
    Rule("IN_AADHAAR", "Aadhaar", AADHAAR_PATTERN, 0.01, ("aadhaar", "uidai"), _aadhaar),
)
#: Stand-in for a named-entity model; ``detect`` takes another in its place.
NAME_RULES: tuple[Rule, ...] = (
    Rule("PERSON", "names after a cue", PERSON_PATTERN, 0.85, flags="(?m)"),
    Rule("ORGANIZATION", "names with a legal form", ORGANIZATION_PATTERN, 0.85, flags="(?m)"),
)


def deny_rules(deny_lists: Mapping[str, Sequence[str]]) -> tuple[Rule, ...]:
    """One rule for each type: whole listed values, longest first, score 1."""
    out = []
    for entity_type, values in deny_lists.items():
        if values:
            listed = "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in sorted(values, key=len, reverse=True))
            out.append(Rule(entity_type, f"{entity_type} deny list", rf"(?:^|(?<=\W))(?:{listed})(?:(?=\W)|$)", 1.0))
    return tuple(out)


def _cue(text: Column, hit: Column, cues: tuple[str, ...]) -> Column:
    """The first of ``cues``, in their order, near the hit; null without one."""
    first = F.greatest(hit["start"] - DOB_CUE_BEFORE, F.lit(0))
    window = F.lower(piece(text, first, hit["end"] + DOB_CUE_AFTER))
    return F.coalesce(*[F.when(F.contains(window, F.lit(c)), F.lit(c)) for c in cues])


def _context(text: Column, hit: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words`` that one of the tokens just before the hit holds; null without one."""
    if not words:
        return F.lit(None).cast("string")
    first = F.greatest(hit["start"] - CONTEXT_CHARS, F.lit(0))
    before = F.filter(F.split(F.lower(piece(text, first, hit["start"])), r"(?U)\W+"), lambda t: t != "")
    near = F.slice(before, F.greatest(F.size(before) - CONTEXT_TOKENS + 1, F.lit(1)), CONTEXT_TOKENS)
    return let(near, lambda n: F.coalesce(*[F.when(_held(n, w), F.lit(w)) for w in words]))


def _held(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: F.contains(t, F.lit(word)))


def rule_candidates(text: Column, rule: Rule, ordinal: int) -> Column:
    """The spans of one rule as an array of candidates."""
    hits = find_all(text, rule.flags + rule.pattern)
    if rule.only is not None:
        hits = F.when(rule.only(text), hits).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    if rule.valid is not None:
        hits = F.filter(hits, lambda h: F.coalesce(rule.valid(h["value"]), F.lit(False)))
    score = 1.0 if rule.valid is not None and rule.confirms else rule.score

    def scored(hit: Column) -> Column:
        word = _cue(text, hit, rule.cues) if rule.cues else _context(text, hit, rule.context)
        lifted = F.lit(score) if rule.cues else F.when(
            word.isNotNull(), F.lit(min(1.0, max(score + CONTEXT_BOOST, CONTEXT_FLOOR)))
        ).otherwise(F.lit(score))
        return F.struct(
            F.lit(rule.entity_type).alias("entity_type"),
            hit["start"].alias("start"),
            hit["end"].alias("end"),
            lifted.alias("score"),
            F.lit(rule.recognizer).alias("recognizer"),
            word.alias("context"),
            F.lit(ordinal).alias("ordinal"),
        )

    found = F.transform(hits, scored)
    return F.filter(found, lambda c: c["context"].isNotNull()) if rule.cues else found


def candidates_of(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules' candidates in one array, in the order of the rules."""
    arrays = [rule_candidates(text, rule, k).cast(f"array<{CANDIDATE}>") for k, rule in enumerate(rules)]
    return F.concat(*arrays) if arrays else F.array().cast(f"array<{CANDIDATE}>")


def registry(
    deny_lists: Mapping[str, Sequence[str]] | None = None,
    entities: Sequence[str] | None = None,
    names: Sequence[Rule] = NAME_RULES,
) -> tuple[Rule, ...]:
    """The rules in order, pruned to the entity types asked for before anything is scanned."""
    wanted = set(entities or ENTITY_TYPES)
    unknown = wanted - set(ENTITY_TYPES)
    if unknown:
        raise ValueError(f"unsupported entity types: {sorted(unknown)}")
    return tuple(r for r in (*RULES, *deny_rules(deny_lists or {}), *names) if r.entity_type in wanted)


@remembered
def candidates_column(text_col: str, rules: tuple[Rule, ...]) -> Column:
    """All rules' candidates in a text column; null counts as empty."""
    return candidates_of(F.coalesce(F.col(text_col), F.lit("")), rules)


def with_candidates(units: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    return units.withColumn("candidates", candidates_column(text_col, tuple(rules)))


def spans(units: DataFrame, rules: Sequence[Rule], keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row a candidate: ``keep`` columns, the candidate's fields and its value."""
    found = with_candidates(units, rules, text_col).select(*keep, text_col, F.explode_outer("candidates").alias("c")).where("c is not null")
    return found.select(*keep, "c.*", piece(F.col(text_col), F.col("c.start"), F.col("c.end")).alias("value"))

"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens that any URL it matches must hold. The rule is filed under
the one of them that is rarest in the table; a URL's tokens fetch the rules filed under them,
and only those run: path rules by comparing strings, pattern rules by their regular expression,
on host + path. Rules without a literal token run on every URL. Everything is a projection: no
shuffle, no join, and repeated or null ids are of no account. Regular expressions of a pack of at
most LITERAL_RULES are compiled once each; a larger pack's are compiled where they are fetched.
The pack travels with the plan, so it has at most MOST_RULES rules: more are refused.

Defined results: null urls and urls without ``://`` have an empty host and path and are
allowed; the longest path rule that fits decides, then a pattern rule, else ``allow``; of
pattern rules the first in code point order of the name is reported.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import ascii_lower, table, without

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN_GAP = r"[^0-9a-z]+"
INDEX_BLOCK = 20_000  # rules in one literal index; longer lists take several
MOST_RULES, LITERAL_RULES = 500_000, 256
OUTPUTS = ("host", "path", "rule", "verdict", "pattern_rule")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported. A path rule fits ``host`` and its subdomains where the path starts with
    ``prefix``; a pattern rule fits where ``regex`` is found in host + path. ``tokens`` must all be there."""

    name: str
    verdict: str
    tokens: tuple[str, ...]
    regex: str = ""
    host: str = ""
    prefix: str = ""

    @property
    def is_path(self) -> bool:
        return not self.regex


def path_rule(verdict: str, spec: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts so."""
    host, slash, path = spec.partition("/")
    host = host.lower()
    # Tokens that are bounded on both sides in every match; the last of the path may go on.
    bounded = f"{host}{slash}{path}"
    tokens = tuple(t for t in re.split(TOKEN_GAP, bounded.lower()) if t)
    if path and re.match("[0-9a-z]", bounded[-1].lower()):
        tokens = tokens[:-1]
    return Rule(spec, verdict, tokens, host=host, prefix=slash + path)


def word_rule(verdict: str, word: str) -> Rule:
    """A word, or words joined by hyphens, anywhere in the host or path."""
    return Rule(word, verdict, tuple(re.split(TOKEN_GAP, word)), rf"(?i)(?:^|[^0-9a-z]){re.escape(word)}(?:[^0-9a-z]|$)")


PATH_RULES = tuple(
    path_rule(*x)
    for x in (
        ("block", "com/en/"),
        ("allow", "example.com/en/7"),
        ("allow", "net/de/"),
        ("block", "example.net/de/8"),
        ("block", "org/es/"),
    )
)
PATTERN_RULES = (
    *(word_rule("block", w) for w in ("spam-farm", "cheap-pills", "casino", "porn", "xxx", "wp-login", "doubleclick")),
    Rule("calendar page", "block", ("calendar",), r"(?i)/calendar/[0-9]{4}/[0-9]{1,2}"),
    Rule("session id", "block", ("jsessionid",), r"(?i);jsessionid=[0-9a-f]+"),
    Rule("login page", "block", ("login",), r"(?i)/(?:user|account|member)s?/login(?:[/.]|$)"),
    Rule("listing page", "block", ("page",), r"(?i)/(?:tag|tags|category|author)/[^/]+/page/[0-9]+"),
    Rule("search result", "block", ("search",), r"(?i)/search(?:/|\.(?:php|aspx?)|$)"),
    Rule("shopping cart", "block", ("cart",), r"(?i)/(?:shop|store)/cart(?:/|$)"),
    Rule("betting host", "block", (), r"^(?:[^/]*[.-])?(?:poker|betting|jackpot)[a-z0-9-]*\.[^/]*(?:/|$)"),
    Rule("bare address", "block", (), r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)"),
    Rule("binary file", "block", (), r"(?i)\.(?:exe|zip|iso|dmg|apk)$"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_tokens(canonical: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(canonical), TOKEN_GAP), lambda t: t != ""))


def token_counts(urls: DataFrame, canonical: Column, tokens: set[str]) -> dict[str, int]:
    """URLs holding each of the rules' own tokens: at most one small row for each of these."""
    if not tokens:
        return {}
    each = urls.select(F.explode(url_tokens(canonical)).alias("token")).where(F.col("token").isin(sorted(tokens)))
    return {r["token"]: r["count"] for r in each.groupBy("token").count().collect()}


ENTRY = "struct<number:int,is_path:boolean,length:int,name:string,verdict:string,regex:string,host:string,prefix:string>"


def _index(rules: list[tuple[int, Rule]], counts: dict[str, int], n_slots: int) -> tuple[Column, Column]:
    """Literal hash table from token to rules, and the rules that must always run."""
    slots: list[list[dict]] = [[] for _ in range(n_slots)]
    always = []
    for number, rule in rules:
        entry = asdict(rule) | {"number": number, "is_path": rule.is_path, "length": len(rule.name)}
        del entry["tokens"]
        if rule.tokens:
            token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            slots[zlib.crc32(token.encode()) % n_slots].append({"token": token, "rule": entry})
        else:
            always.append(entry)
    index = F.from_json(F.lit(json.dumps(slots)), f"array<array<struct<token:string,rule:{ENTRY}>>>")
    return index, F.from_json(F.lit(json.dumps(always)), f"array<{ENTRY}>")


def _filed_under(index: Column, n_slots: int):
    def rules(token: Column) -> Column:
        slot = (F.crc32(token.cast("binary")) % n_slots + 1).cast("int")
        here = F.filter(F.element_at(index, slot), lambda e: e["token"] == token)
        return F.transform(here, lambda e: e["rule"])

    return rules


def candidate_rules(canonical: Column, rules: list[Rule], counts: dict[str, int]) -> Column:
    """Array of the rules that a URL's tokens fetch, and of those that always run."""
    found = []
    numbered = list(enumerate(rules))
    for first in range(0, len(rules), INDEX_BLOCK):
        block = numbered[first : first + INDEX_BLOCK]
        n_slots = max(1, 2 * len(block))
        index, always = _index(block, counts, n_slots)
        found += [F.flatten(F.transform(url_tokens(canonical), _filed_under(index, n_slots))), always]
    return F.concat(*found) if found else F.array().cast(f"array<{ENTRY}>")


def fitting_patterns(candidates: Column, canonical: Column, rules: list[Rule]) -> Column:
    """Array of (name, verdict) of the candidates whose regular expression is found."""
    patterns = [(k, r) for k, r in enumerate(rules) if not r.is_path]
    if len(patterns) > LITERAL_RULES:
        found = F.filter(candidates, lambda r: ~r["is_path"] & F.rlike(canonical, r["regex"]))
        return F.transform(found, lambda r: F.struct(r["name"].alias("name"), r["verdict"].alias("verdict")))

    def tried(number: int, rule: Rule) -> Column:
        fetched = F.exists(candidates, lambda r: r["number"] == number) if rule.tokens else F.lit(True)
        named = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        return F.when(fetched, F.when(F.rlike(canonical, F.lit(rule.regex)), named))

    if not patterns:
        return F.array().cast("array<struct<name:string,verdict:string>>")
    return F.array_compact(F.array(*[tried(*p) for p in patterns]))


def filter_urls(
    pages: DataFrame, path_rules: tuple[Rule, ...] = PATH_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, url_col: str = "url"
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern_rule."""
    rules = [*path_rules, *pattern_rules]
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    clean = without(pages, *(c for c in OUTPUTS if c != url_col))
    named = clean.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    canonical = F.concat("host", "path")
    counts = token_counts(named, canonical, {t for r in rules for t in r.tokens})
    fetched = named.withColumn("__cw_rules", candidate_rules(canonical, rules, counts))

    def fits(r: Column) -> Column:
        on_host = (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return r["is_path"] & on_host & F.startswith(F.col("path"), r["prefix"])

    longest = F.array_max(F.transform(F.filter("__cw_rules", fits), lambda r: F.struct(r["length"], r["name"].alias("name"), r["verdict"].alias("verdict"))))
    chosen = fetched.withColumns({"__cw_path": longest, "__cw_pattern": F.array_min(fitting_patterns(F.col("__cw_rules"), canonical, rules))})
    return chosen.withColumns(
        {
            "rule": F.col("__cw_path.name"),
            "verdict": F.coalesce(F.col("__cw_path.verdict"), F.col("__cw_pattern.verdict"), F.lit("allow")),
            "pattern_rule": F.col("__cw_pattern.name"),
        }
    ).drop("__cw_rules", "__cw_path", "__cw_pattern")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")

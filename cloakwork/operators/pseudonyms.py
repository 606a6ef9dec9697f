"""Seeded pseudonyms: generators, the mapping of each document, and its replay dictionary.

A fake depends on seed, type, normal form and attempt alone, so values are faked in parallel; only
collisions within a document need its order. They are settled inside the document's own array
of records, in order of first appearance, exactly as one after another would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.memo import remembered
from cloakwork.functions.spans import let, literal
from cloakwork.functions.values import casefold, normalized

# The shapes of fakes (documentation ranges, test numbers), in the functions below.
GIVEN_NAMES = (
    "Aarav", "Aditi", "Anika", "Arjun", "Bhavna", "Chetan", "Deepa", "Dev", "Esha", "Farhan", "Gauri", "Harsh",
    "Ishan", "Jaya", "Kabir", "Kavya", "Lakshmi", "Manav", "Meera", "Nikhil", "Nisha", "Omkar", "Pooja", "Pranav",
    "Radha", "Rahul", "Rohan", "Sanya", "Shreya", "Tara", "Uday", "Varun", "Vidya", "Yash", "Zoya",
)
FAMILY_NAMES = (
    "Acharya", "Bansal", "Bhatt", "Chopra", "Dalal", "Deshpande", "Ganguly", "Gupta", "Iyer", "Jain", "Joshi",
    "Kapoor", "Khanna", "Kulkarni", "Mehta", "Menon", "Mishra", "Nair", "Pandey", "Patel", "Pillai", "Rao", "Reddy",
    "Saxena", "Shah", "Sharma", "Singh", "Sinha", "Thakur", "Trivedi", "Varma", "Verma", "Yadav",
)
MOST_ATTEMPTS = 1000
#: Attempts looked at together; later tiers run only where all of the earlier ones collide.
TIERS = ((0, 4), (4, 64), (64, MOST_ATTEMPTS))
LEAST_REPLAY_LENGTH = 5
BIRTH_DATES_FROM = "1945-01-01"  # 62 years of dates: ages 18 to 80 in 2025
BIRTH_DATES = 62 * 365 + 15
#: At most so many fakes has a type that a document's values may outnumber; IP addresses of version 4 only.
SPACES = {
    "PERSON": len(GIVEN_NAMES) * len(FAMILY_NAMES),
    "PHONE_NUMBER": 100,
    "PHYSICAL_ADDRESS": 999,
    "US_SSN": 99 * 9_999,
    "DATE_OF_BIRTH": BIRTH_DATES,
    "IP_ADDRESS": 254,
    "IN_PAN": 10_000,
    "IN_AADHAAR": 9_999,
    "IN_CIN": 1_000_000,
}
#: Records settled before their fakes are put to the others', fakes in a slot of the used ones, and slots.
BLOCK, SLOT, MOST_SLOTS = 512, 8, 1024


def seed_hash(seed: int, entity_type: Column, value: Column, attempt: Column) -> Column:
    """A positive number below 2**60 from SHA-256 of seed, type, value and attempt."""
    material = F.concat_ws("\u0000", F.lit(str(seed)), entity_type, value, attempt.cast("string"))
    return F.conv(F.substring(F.sha2(material, 256), 1, 15), 16, 10).cast("bigint")


def _numbered(n: Column, space: int, width: int, first: int = 0) -> Column:
    return F.lpad((n % space + first).cast("string"), width, "0")


def _pick(n: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def person(n: Column, _: Column) -> Column:
    return F.concat_ws(" ", _pick(n, GIVEN_NAMES), _pick(F.shiftright(n, 20), FAMILY_NAMES))


def email(n: Column, _: Column) -> Column:
    names = (F.lower(_pick(n, GIVEN_NAMES)), F.lower(_pick(F.shiftright(n, 20), FAMILY_NAMES)))
    return F.concat(F.concat_ws(".", *names), _numbered(F.shiftright(n, 30), 10_000, 4), F.lit("@example.invalid"))


def phone(n: Column, _: Column) -> Column:
    return F.concat(F.lit("+1 202-555-"), _numbered(n, 100, 4, 100))


def organization(n: Column, _: Column) -> Column:
    return F.concat(_pick(F.shiftright(n, 20), FAMILY_NAMES), F.lit(" "), _numbered(n, 1_000_000, 6), F.lit(" Test Systems Private Limited"))


def address(n: Column, _: Column) -> Column:
    return F.concat((n % 999 + 1).cast("string"), F.lit(" Example Road, Test Nagar, Bengaluru, Karnataka 560001"))


def ssn(n: Column, _: Column) -> Column:
    return F.concat(F.lit("000-"), _numbered(n, 99, 2, 1), F.lit("-"), _numbered(F.shiftright(n, 20), 9_999, 4, 1))


def credit_card(n: Column, _: Column) -> Column:
    def checked(body: Column) -> Column:
        check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(body, d)))
        return F.concat(body, F.element_at(check, 1))

    number = let(F.concat(F.lit("000000"), _numbered(n, 1_000_000_000, 9)), checked)
    return F.concat_ws(" ", *(F.substring(number, k, 4) for k in (1, 5, 9, 13)))


def birth_date(n: Column, _: Column) -> Column:
    return F.date_format(F.date_add(F.lit(BIRTH_DATES_FROM).cast("date"), (n % BIRTH_DATES).cast("int")), "dd MMMM yyyy")


def ip_address(n: Column, value: Column) -> Column:
    # The host's four groups are never 0, so the text is in canonical form.
    groups = [F.lower(F.hex(F.shiftright(n, 15 * k) % 32_767 + 1)) for k in (3, 2, 1, 0)]
    v6 = F.concat(F.lit("2001:db8::"), F.concat_ws(":", *groups))
    return F.when(F.contains(value, F.lit(":")), v6).otherwise(F.concat(F.lit("192.0.2."), (n % 254 + 1).cast("string")))


def pan(n: Column, _: Column) -> Column:
    return F.concat(F.lit("AAAPA"), _numbered(n, 10_000, 4), F.lit("A"))


def aadhaar(n: Column, _: Column) -> Column:
    return F.concat(F.lit("0000 0000 "), _numbered(n, 9_999, 4, 1))


def din(n: Column, _: Column) -> Column:
    return F.concat(F.lit("DIN-TEST-"), _numbered(n, 100_000_000, 8))


def cin(n: Column, _: Column) -> Column:
    return F.concat(F.lit("L00000ZZ2000PLC"), _numbered(n, 1_000_000, 6))


GENERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "PERSON": person,
    "EMAIL_ADDRESS": email,
    "PHONE_NUMBER": phone,
    "ORGANIZATION": organization,
    "PHYSICAL_ADDRESS": address,
    "US_SSN": ssn,
    "CREDIT_CARD": credit_card,
    "DATE_OF_BIRTH": birth_date,
    "IP_ADDRESS": ip_address,
    "IN_PAN": pan,
    "IN_AADHAAR": aadhaar,
    "IN_DIN": din,
    "IN_CIN": cin,
}


Generator = Callable[[Column, Column], Column]
Overrides = tuple[tuple[str, Generator], ...]


def generated(seed: int, entity_type: Column, value: Column, attempt: Column, overrides: Overrides = ()) -> Column:
    """The fake for a normal form at an attempt; an unknown type is an error.

    ``overrides`` name other generators for some types: functions of the seed's number and the
    normal form, as columns.
    """

    def fake(n: Column) -> Column:
        chosen = F
        for name, make in (GENERATORS | dict(overrides)).items():
            chosen = chosen.when(entity_type == name, make(n, value))
        return chosen.otherwise(F.raise_error(F.concat(F.lit("unsupported entity type: "), entity_type)).cast("string"))

    return let(seed_hash(seed, entity_type, value, attempt), fake)


def first_unused(seed: int, entity_type: Column, value: Column, used: Callable[[Column], Column], overrides: Overrides = ()) -> Column:
    """The first attempt's fake that isn't ``used`` (asked in lower case) nor the value itself;
    null where MOST_ATTEMPTS make none."""

    def free(fake: Column) -> Column:
        return let(F.lower(fake), lambda f: ~used(f) & (f != value))

    tiers = [
        F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda k: generated(seed, entity_type, value, k, overrides)), free), F.lit(0))
        for a, b in TIERS
    ]
    return F.coalesce(*tiers)


RECORD = "struct<entity_type:string,original:string,normalized_original:string,replacement:string,occurrences:bigint>"


def mapped(
    rows: DataFrame,
    seed: int,
    scope: str = "doc_id",
    order: tuple[str, ...] = ("unit_no", "start"),
    unicode: bool = True,
    overrides: Overrides = (),
) -> DataFrame:
    """(scope, entity_type, original, normalized_original, replacement, occurrences, first_no).

    ``rows`` has a row for each resolved span (scope, order..., entity_type, value). One
    partial-aggregating shuffle by (scope, type, normal form), one by scope. A document with more
    values than a type has fakes gets null replacements for the rest, see ``incomplete``.
    """
    keyed = rows.withColumn("normalized_original", normalized(F.col("entity_type"), F.col("value"), unicode))
    distinct = keyed.groupBy(scope, "entity_type", "normalized_original").agg(
        F.count("*").alias("occurrences"), F.min(F.struct(*order, "value")).alias("first")
    )
    return assigned(distinct, seed, scope, overrides)


def assigned(distinct: DataFrame, seed: int, scope: str = "doc_id", overrides: Overrides = ()) -> DataFrame:
    """Replacements for distinct (scope, entity_type, normalized_original, occurrences, first)."""
    record = F.struct("first", "entity_type", "normalized_original", "occurrences")
    ordered = distinct.groupBy(scope).agg(F.array_sort(F.collect_list(record)).alias("records"))
    each = ordered.select(scope, F.posexplode_outer(settled_records(seed, overrides)).alias("first_no", "m")).where("m is not null")
    return each.select(scope, "m.*", "first_no")


def _space(entity_type: Column, value: Column, types: list[str]) -> Column:
    """The place in ``types`` of the space that a value's fakes are from; null for any other."""
    chosen = F.when(F.lit(False), F.lit(0))
    for k, name in enumerate(types):
        own = entity_type == name
        chosen = chosen.when(own & ~F.contains(value, F.lit(":")) if name == "IP_ADDRESS" else own, F.lit(k))
    return chosen


@remembered
def settled_records(seed: int, overrides: Overrides = ()) -> Column:
    """The array ``records``, in order of first appearance, with a replacement for each.

    Used fakes lie in slots by their hash, and those of each small space are counted: where all are
    used, no attempt could find another, and none is made.
    """
    sizes = {name: size for name, size in SPACES.items() if name not in dict(overrides)}
    counts = F.array(*[F.lit(0)] * len(sizes)).cast("array<int>")
    limits = F.array(*map(F.lit, sizes.values())).cast("array<int>")

    def settle_one(state: Column, r: Column) -> Column:
        used, slots = state["used"], F.size(state["used"])

        def slot(fake: Column) -> Column:
            return F.pmod(F.hash(fake), slots)

        def settle_in(space: Column) -> Column:
            def put(fake: Column) -> Column:
                def added(f: Column) -> Column:
                    own = F.array(F.concat(F.get(used, slot(f)), F.array(f)))
                    return F.concat(F.slice(used, F.lit(1), slot(f)), own, F.slice(used, slot(f) + 2, slots))

                counted = F.transform(state["counts"], lambda n, k: n + F.when(k == space, 1).otherwise(0))
                return F.struct(
                    F.when(fake.isNull(), used).otherwise(let(F.lower(fake), added)).alias("used"),
                    F.when(fake.isNull() | space.isNull(), state["counts"]).otherwise(counted).alias("counts"),
                    F.concat(state["fakes"], F.array(fake)).alias("fakes"),
                )

            unused = first_unused(
                seed, r["entity_type"], r["normalized_original"], lambda f: F.array_contains(F.get(used, slot(f)), f), overrides
            )
            spent = F.coalesce(F.get(state["counts"], space) >= F.get(limits, space), F.lit(False))
            return let(F.when(~spent, unused), put)

        return let(_space(r["entity_type"], r["normalized_original"], list(sizes)), settle_in)

    def settle_block(state: Column, k: Column) -> Column:
        # An array grows by copying: blocks keep documents with many thousands of records cheap.
        begin = F.struct(state["used"].alias("used"), state["counts"].alias("counts"), none.alias("fakes"))
        return F.aggregate(
            F.slice("records", k * BLOCK + 1, F.lit(BLOCK)),
            begin,
            settle_one,
            lambda s: F.struct(s["used"].alias("used"), s["counts"].alias("counts"), F.concat(state["fakes"], s["fakes"]).alias("fakes")),
        )

    def done(fakes: Column) -> Column:
        return F.transform(
            "records",
            lambda r, k: F.struct(
                r["entity_type"].alias("entity_type"),
                r["first"]["value"].alias("original"),
                r["normalized_original"].alias("normalized_original"),
                F.get(fakes, k).alias("replacement"),
                r["occurrences"].alias("occurrences"),
            ),
        ).cast(f"array<{RECORD}>")

    none = F.array().cast("array<string>")
    slots = F.least((F.size("records") / SLOT).cast("int") + 1, F.lit(MOST_SLOTS))
    start = F.struct(F.array_repeat(none, slots).alias("used"), counts.alias("counts"), none.alias("fakes"))
    blocks = F.sequence(F.lit(0), F.greatest(((F.size("records") - 1) / BLOCK).cast("int"), F.lit(0)))
    return let(F.aggregate(blocks, start, settle_block, lambda s: s["fakes"]), done)


def incomplete(mappings: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, entity_type, missing): documents whose values outnumber the fakes of a type. Their
    redacted text is null: one such document neither leaks nor stops the others."""
    return mappings.where(F.col("replacement").isNull()).groupBy(scope, "entity_type").agg(F.count("*").alias("missing"))


def existing_replacements(rows: DataFrame, mappings: DataFrame, scope: str = "doc_id", unicode: bool = True) -> DataFrame:
    """``rows`` (scope, entity_type, value) with the replacement each already has; counts stay.

    A value that no mapping knows is an error.
    """
    keyed = rows.withColumn("normalized_original", normalized(F.col("entity_type"), F.col("value"), unicode))
    keys = [scope, "entity_type", "normalized_original"]
    found = keyed.join(mappings.select(*keys, "replacement"), keys, "left")
    unknown = F.raise_error(F.concat(F.lit("no mapping for a value of type "), F.col("entity_type"))).cast("string")
    return found.withColumn("replacement", F.coalesce("replacement", unknown))


def replay_dictionary(mappings: DataFrame, scope: str = "doc_id", unicode: bool = True) -> DataFrame:
    """(scope, key, entity_type): known originals that may be replaced wherever they stand.

    Left out are keys of two types, originals of under five characters, and keys that are part
    of any replacement of their document.
    """
    fold = casefold if unicode else F.lower
    fakes = mappings.groupBy(scope).agg(F.collect_list(F.lower("replacement")).alias("fakes"))
    keyed = mappings.withColumn("key", fold(F.col("original"))).join(fakes, scope)
    bare = F.regexp_replace("original", r"(?U)^\s+|\s+$", "")
    inside = F.exists("fakes", lambda f: F.contains(f, F.col("key")))  # nulls aren't collected
    long_enough = F.char_length(bare) >= LEAST_REPLAY_LENGTH
    by_key = keyed.groupBy(scope, "key").agg(
        F.count_distinct("entity_type").alias("types"),
        F.min("entity_type").alias("entity_type"),
        F.max(long_enough & ~inside).alias("usable"),
    )
    return by_key.where("types = 1 and usable").select(scope, "key", "entity_type")


def ambiguous_originals(mappings: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, key, types): originals that are mapped under more than one type."""
    keyed = mappings.withColumn("key", casefold(F.col("original")))
    return keyed.groupBy(scope, "key").agg(F.count_distinct("entity_type").alias("types")).where("types > 1")


def replay_patterns(dictionary: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, pattern, by_key): one alternation for each document, longest first, any case."""
    entry = F.struct((-F.char_length("key")).alias("n"), F.col("key").alias("key"))
    grouped = dictionary.groupBy(scope).agg(
        F.array_sort(F.collect_list(entry)).alias("keys"), F.map_from_entries(F.collect_list(F.struct("key", "entity_type"))).alias("by_key")
    )
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform("keys", lambda k: literal(k["key"])), "|"))
    return grouped.select(scope, pattern.alias("pattern"), "by_key")

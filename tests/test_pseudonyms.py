"""Mappings are seeded, unique, per document; replay and splicing follow them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.spans import find_all, spliced
from cloakwork.functions.values import ipv6_compressed, luhn_valid, normalized, verhoeff_valid
from cloakwork.operators.pseudonyms import BLOCK, MOST_ATTEMPTS, SPACES, generated, incomplete, mapped, replay_dictionary
from cloakwork.operators.redact import redact, replay_hits

ROWS = "doc_id long, unit_no long, start int, entity_type string, value string"
SAMPLES = [
    ("PERSON", "Rahul Sharma", r"\w+ \w+"),
    ("EMAIL_ADDRESS", "a@example.com", r"[\w.]+@example\.invalid"),
    ("PHONE_NUMBER", "+91 98765 43210", r"\+1 202-555-01\d\d"),
    ("ORGANIZATION", "Acme Limited", r"\w+ \d{6} Test Systems Private Limited"),
    ("PHYSICAL_ADDRESS", "12 MG Road, Bengaluru", r"\d{1,3} Example Road, Test Nagar, Bengaluru, Karnataka 560001"),
    ("US_SSN", "219-09-9999", r"000-\d\d-\d{4}"),
    ("CREDIT_CARD", "4111 1111 1111 1111", r"0000 00\d\d \d{4} \d{4}"),
    ("DATE_OF_BIRTH", "14 September 1988", r"\d\d [A-Z][a-z]+ (19|20)\d\d"),
    ("IP_ADDRESS", "192.0.2.10", r"192\.0\.2\.\d+"),
    ("IP_ADDRESS", "2001:db8::1234", r"2001:db8::[0-9a-f:]+"),
    ("IN_PAN", "AAAPA1234A", r"AAAPA\d{4}A"),
    ("IN_AADHAAR", "2345 6789 0124", r"0000 0000 \d{4}"),
    ("IN_DIN", "01234567", r"DIN-TEST-\d{8}"),
    ("IN_CIN", "L12345MH2020PLC123456", r"L00000ZZ2000PLC\d{6}"),
]


def make(spark, rows, seed=23):
    df = spark.createDataFrame([(1, 0, k, t, v) for k, (t, v) in enumerate(rows)], ROWS)
    return {(r["entity_type"], r["normalized_original"]): r for r in mapped(df, seed).collect()}


def test_generators(spark):
    one, two = (make(spark, [s[:2] for s in SAMPLES]) for _ in range(2))
    assert one == two and len(one) == len(SAMPLES)
    fakes = [r["replacement"] for r in one.values()]
    assert len({f.lower() for f in fakes}) == len(fakes)
    for r in one.values():
        shape = next(s[2] for s in SAMPLES if s[0] == r["entity_type"] and s[1] == r["original"])
        assert re.fullmatch(shape, r["replacement"]), r
    card = next(r["replacement"] for r in one.values() if r["entity_type"] == "CREDIT_CARD")
    assert spark.range(1).select(luhn_valid(F.lit(card))).first()[0]


def test_normalized_reuse_and_type_isolation(spark):
    rows = [("EMAIL_ADDRESS", " Rashi.Patil@Example.com "), ("EMAIL_ADDRESS", "rashi.patil@example.com"), ("PERSON", "Acme Limited"), ("ORGANIZATION", "Acme Limited")]
    out = make(spark, rows)
    assert out["EMAIL_ADDRESS", "rashi.patil@example.com"]["occurrences"] == 2
    assert out["EMAIL_ADDRESS", "rashi.patil@example.com"]["original"] == " Rashi.Patil@Example.com "
    assert out["PERSON", "acme limited"]["replacement"] != out["ORGANIZATION", "acme limited"]["replacement"]


def test_small_spaces_stay_unique_until_exhausted(spark):
    phones = [("PHONE_NUMBER", f"+91 98765 4{k:04d}") for k in range(60)]
    assert len({r["replacement"] for r in make(spark, phones).values()}) == 60
    out = make(spark, [("PHONE_NUMBER", f"+91 98765 4{k:04d}") for k in range(103)] + [("PERSON", "Asha Rao")])
    assert sum(r["replacement"] is None for r in out.values()) == 3 and out["PERSON", "asha rao"]["replacement"]


def test_a_document_without_fakes_enough_stops_no_other(spark):
    text = " ".join(f"phone +91 98765 4{k:04d}," for k in range(101))
    units = spark.createDataFrame([(1, 0, text), (2, 0, "phone +91 98765 43210")], "doc_id long, unit_no long, text string")
    texts, mappings = redact(units, 17, entities=["PHONE_NUMBER"])
    out = {r["doc_id"]: r["redacted"] for r in texts.collect()}
    assert out[1] is None and out[2].startswith("phone +1 202-555-01")
    assert [tuple(r) for r in incomplete(mappings).collect()] == [(1, "PHONE_NUMBER", 1)]


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported entity type"):
        make(spark, [("NOPE", "x")])


def test_normal_forms(spark):
    values = [("PERSON", "Ｒａｈｕｌ   Straße", "rahul strasse"), ("PHONE_NUMBER", "(91) 98-76", "919876"), ("IP_ADDRESS", "2001:0DB8:0:0:0:0:0:1", "2001:db8::1")]
    df = spark.createDataFrame(values, "t string, v string, e string")
    assert all(r["n"] == r["e"] for r in df.select("e", normalized(F.col("t"), F.col("v")).alias("n")).collect())


def test_ipv6_like_the_standard_library(spark):
    import ipaddress

    draw = random.Random(3)
    values = [":".join(f"{draw.choice([0, 0, draw.getrandbits(16)]):x}" for _ in range(8)) for _ in range(200)] + ["::", "::1", "1::"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", ipv6_compressed(F.col("v")).alias("c")).collect()
    assert all(r["c"] == ipaddress.ip_address(r["v"]).compressed for r in rows)


def test_verhoeff(spark):
    rows = spark.createDataFrame([("2345 6789 0124", True), ("2345 6789 0125", False), ("2363", True)], "v string, ok boolean")
    assert all(r["g"] == r["ok"] for r in rows.select("ok", verhoeff_valid(F.col("v")).alias("g")).collect())


def test_adjacent_spans_make_two_mappings(spark):
    out = make(spark, [("ORGANIZATION", "The Registrar of Companies,"), ("ORGANIZATION", "Maharashtra")])
    assert len(out) == 2


def test_replay_is_case_blind_and_keeps_ambiguous_values_out(spark):
    maps = spark.createDataFrame(
        [
            (1, "PERSON", "Rashi Patil", "rashi patil", "Asha Rao", 1),
            (1, "PERSON", "Same Name", "same name", "Dev Shah", 1),
            (1, "ORGANIZATION", "same name", "same name", "X 000001 Test Systems Private Limited", 1),
            (1, "PERSON", "Abc", "abc", "Tara Jain", 1),
        ],
        "doc_id long, entity_type string, original string, normalized_original string, replacement string, occurrences long",
    )
    assert [r["key"] for r in replay_dictionary(maps).collect()] == ["rashi patil"]
    texts = spark.createDataFrame([(1, 0, "Director RASHI PATIL signed, rashi patil too.")], "doc_id long, unit_no long, redacted string")
    hits = replay_hits(texts, maps).collect()
    assert sorted((r["start"], r["entity_type"]) for r in hits) == [(9, "PERSON"), (29, "PERSON")]


def test_both_passes(spark):
    text = "Contact Email: alice.w@example.com today.\nwrite ALICE.W@example.com again; DIN: 01234567, later 01234567."
    units = spark.createDataFrame([(1, 0, text), (2, 0, "nothing here"), (3, 0, None)], "doc_id long, unit_no long, text string")
    texts, mappings = redact(units, 17)
    out = {r["doc_id"]: r["redacted"] for r in texts.collect()}
    maps = {r["entity_type"]: r for r in mappings.collect()}
    assert out[2] == "nothing here" and out[3] == ""
    assert "example.com" not in out[1].lower() and "01234567" not in out[1]
    assert maps["EMAIL_ADDRESS"]["occurrences"] == 2 and maps["IN_DIN"]["occurrences"] == 2
    assert out[1].count(maps["IN_DIN"]["replacement"]) == 2


def test_find_all_and_splice_like_python(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab1 é😀") for _ in range(draw.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = find_all(F.col("t"), r"[ab]+1?")
    put = spliced(F.col("t"), F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit("<x>").alias("value"))))
    for r in df.select("t", hits.alias("h"), put.alias("p")).collect():
        assert [(h["start"], h["end"], h["value"]) for h in r["h"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[ab]+1?", r["t"])]
        assert r["p"] == re.sub(r"[ab]+1?", "<x>", r["t"])


def test_peeking_and_own_generators(spark):
    from cloakwork.operators.pseudonyms import existing_replacements

    spans = spark.createDataFrame([(1, 0, 0, "IN_PAN", "AAAPA1234A"), (1, 0, 20, "IN_PAN", "aaapa1234a")], ROWS)
    own = (("IN_PAN", lambda n, value: F.concat(F.lit("PAN-"), (n % 7).cast("string"), F.lit("-"), F.upper(value))),)
    maps = mapped(spans, 5, overrides=own)
    fake = maps.first()["replacement"]
    assert re.fullmatch(r"PAN-\d-AAAPA1234A", fake) and maps.count() == 1
    assert {r["replacement"] for r in existing_replacements(spans, maps).collect()} == {fake}
    other = spark.createDataFrame([(1, 0, 0, "IN_PAN", "BBBPB1234B")], ROWS)
    with pytest.raises(Exception, match="no mapping"):
        existing_replacements(other, maps).collect()


def test_many_records_are_settled_one_after_another(spark):
    phones = [("PHONE_NUMBER", f"+91 98765 4{k:04d}") for k in range(130)]
    hosts = [("IP_ADDRESS", f"10.0.{k // 250}.{k % 250}") for k in range(300)] + [("IP_ADDRESS", f"2001:db8::{k:x}") for k in range(1, 60)]
    people = [("PERSON", f"Person {k}") for k in range(150)]
    rows = [r for k in range(300) for group in (phones, hosts, people) for r in group[k : k + 1]] + hosts[300:]
    assert len(rows) > BLOCK
    got = {r["original"]: r["replacement"] for r in make(spark, rows).values()}
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, v string")
    tries = df.withColumn("n", normalized(F.col("t"), F.col("v"))).crossJoin(spark.range(MOST_ATTEMPTS).withColumnRenamed("id", "a"))
    fakes = tries.select("k", "n", "a", generated(23, F.col("t"), F.col("n"), F.col("a")).alias("fake"))
    each = fakes.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("a", "fake"))).alias("tries")).orderBy("k").collect()
    used, want = set(), {}
    for row, (_, value) in zip(each, rows, strict=True):
        own = (t["fake"] for t in row["tries"] if t["fake"].lower() not in used | {row["n"]})
        want[value] = next(own, None)
        used |= {want[value].lower()} if want[value] else set()
    assert got == want and list(want.values()).count(None) >= 30 + 46


def test_spaces_hold_every_fake_of_a_type(spark):
    """A space said to be smaller than it is would leave values without fakes."""
    df = spark.range(300_000)
    for name in ("PERSON", "PHONE_NUMBER", "PHYSICAL_ADDRESS", "DATE_OF_BIRTH", "IP_ADDRESS", "IN_PAN", "IN_AADHAAR"):
        fakes = df.select(F.lower(generated(23, F.lit(name), F.lit("x"), F.col("id"))).alias("fake"))
        assert fakes.distinct().count() == SPACES[name], name


def test_an_own_generator_has_no_known_space(spark):
    own = (("PHONE_NUMBER", lambda n, _: F.concat(F.lit("own "), n.cast("string"))),)
    df = spark.createDataFrame([(1, 0, k, "PHONE_NUMBER", f"+91 98765 4{k:04d}") for k in range(150)], ROWS)
    assert mapped(df, 23, overrides=own).where(F.col("replacement").startswith("own ")).count() == 150


def test_thousands_of_values_beyond_a_types_fakes(spark):
    """Each costs one look at a count, not every attempt."""
    value = F.concat(F.lit("+91 9"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("value")
    place = [F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("unit_no"), F.col("id").cast("int").alias("start")]
    rows = spark.range(20_000).select(*place, F.lit("PHONE_NUMBER").alias("entity_type"), value)
    began = time.perf_counter()
    faked = mapped(rows, 17, unicode=False).agg(F.count("*"), F.count("replacement"), F.count_distinct("replacement")).first()
    assert tuple(faked) == (20_000, 100, 100) and time.perf_counter() - began < 60

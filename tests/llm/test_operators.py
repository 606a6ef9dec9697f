"""Operators against brute force, exact properties and held-out rows."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import automaton, decontamination, fingerprints, licenses, mixing, near_dedup, quality, secrets, sharding, url_filters
from cloakwork.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import DOCS, WORDS, prose

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(k, t, "en", (sources or ["a"] * len(texts))[k], len(t or "")) for k, t in enumerate(texts)], DOCS)


# --- secrets -----------------------------------------------------------------


def test_automaton_accepts_what_re_does():
    draw = random.Random(2)
    patterns = ["(ab|a)c*", "a{2,3}b", "[^a]b?c", "(?:ab)+", r"a\x62[b-c]{2}", "a.b".replace(".", "[a-c]")]
    for pattern in patterns:
        for backward in (False, True):
            dfa = automaton.compile_rules([(pattern, False)], False, backward)
            for _ in range(300):
                text = bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 8)))
                state = 0
                for b in reversed(text) if backward else text:
                    state = dfa.step[state * dfa.n_classes + dfa.byte_class[b]]
                assert bool(dfa.accept[state]) == bool(re.fullmatch(pattern.encode(), text)), (pattern, text)


def test_minimal_automaton_is_small():
    dfa = automaton.compile_rules([("(aa|ab|ba|bb)", False), ("(a|b)(a|b)", False)], False)
    assert len(dfa.accept) == 4  # start, one byte, two bytes, dead


def test_secrets_like_regular_expressions(spark):
    draw = random.Random(4)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", '"', " ", "=", ":", "abcdefgh12", "AKIA", "0123456789abcdef" * 2, "é", "xtoken: ", "\n", "A1B2C3D4E5F6G7", "deadbeef", "ſecret=abcdefghij", "=="]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(30))) for _ in range(600)]
    texts += ["secret=xtoken: abcdefgh12", "token=abc", "0" * 31, "0" * 32, "AKIA" * 5, "", None, "a" * 100_000 + " token=abcdefghij"]
    rows = secrets.scanned(docs_of(spark, texts), secrets.BASE_RULES, keep=["doc_id"]).collect()
    for r in rows:
        expected = secrets.spans_by_regex(texts[r["doc_id"]] or "")
        base = re.compile(secrets.BASE_RULES[2].pattern)
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"]] == expected, (texts[r["doc_id"]], base)


def test_more_rules(spark):
    text = "x ghp_" + "Zz1x" * 10 + " -----BEGIN RSA PRIVATE KEY----- eyJabc.eyJdefghijklmnopqrstuvwx.abcdef AIza" + "Qx" * 18
    found = secrets.scanned(docs_of(spark, [text]), keep=["doc_id"]).first()["secrets"]
    assert [s["kind"] for s in found] == ["github", "private_key", "jwt", "google"]


def test_many_rules_stay_small(spark, monkeypatch):
    draw = random.Random(5)
    rules = tuple(secrets.SecretRule(f"k{k}", "".join(draw.choice("abcdefghkmnpqrstuvwxyz") for _ in range(draw.randrange(3, 7))) + draw.choice(["_[A-Za-z0-9_-]+", "[0-9a-f]{20,}", "-[A-Z0-9]{16}", r"\x20*[:=]\x20*[A-Za-z0-9]+"]), 8) for k in range(100))
    began = time.perf_counter()
    scanner = secrets.Scanner.of(rules)
    took = time.perf_counter() - began
    assert len(scanner.combined) == 1 and len(scanner.combined[0][0].accept) < 10_000 and took < 2, took
    assert secrets.Scanner.of(rules) is scanner
    texts = []
    for _ in range(200):
        parts = []
        for r in draw.sample(rules, 3):
            word = re.match("[a-z]+", r.pattern)[0]
            parts += [word, draw.choice(["_", "-", "", " : ", "="]), "".join(draw.choice("0123456789abcdefA") for _ in range(draw.randrange(30))), draw.choice(["", " "])]
        texts.append("".join(parts))
    small = secrets.Scanner.of(rules[:20], 60)
    assert len(small.combined) > 1
    for scan in (scanner, small):
        import pyarrow as pa

        got = dict(scan.scan(pa.array(texts, pa.large_string())))
        for k, t in enumerate(texts):
            assert [f"{kind}:{s}:{e}" for kind, s, e in got.get(k, [])] == secrets.spans_by_regex(t, scan.rules)


# --- near duplicates ---------------------------------------------------------


def brute_components(texts, size):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    home = list(range(len(texts)))

    def top(k):
        while home[k] != k:
            k = home[k]
        return k

    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                home[b] = a
    return [(len(s), top(k)) for k, s in enumerate(sets)]


@pytest.fixture(scope="module")
def near_texts():
    """Chains, hubs with far copies, copies, short texts, and texts that share a passage."""
    draw = random.Random(8)
    texts, passage = [], prose(draw, 40)
    for size in (6, 12, 60, 150):
        base = prose(draw, size).split()
        for _ in range(25):
            own = list(base)
            for _ in range(draw.randrange(0, max(2, size // 12))):
                own[draw.randrange(len(own))] = draw.choice(WORDS) + str(draw.randrange(9))
            texts.append(" ".join(own))
        chain = list(base)
        for k in range(12):
            chain[(7 * k) % len(chain)] = f"step{k}"
            texts.append(" ".join(chain).upper() if k % 2 else "  ".join(chain))
        texts += [" ".join(base)] * 3
    texts += [prose(draw, 10) + " " + passage + " " + prose(draw, 10) for _ in range(60)]
    return texts + ["", None, "one", "one", "One two"]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_like_brute_force(spark, near_texts, size):
    rows = near_dedup.grouped(docs_of(spark, near_texts), size=size).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert [got[k] for k in range(len(near_texts))] == brute_components(near_texts, size)
    kept = {r["doc_id"] for r in near_dedup.deduplicated(docs_of(spark, near_texts), size=size).collect()}
    assert kept == {c for _, c in got.values()}


def test_components_of_a_long_chain(spark):
    names = [bytes([n % 251, n // 251]) for n in range(600)]
    links = spark.createDataFrame(list(zip(names, names[1:])), "a binary, b binary")
    rows = near_dedup.components(links).collect()
    assert len(rows) == 600 and {bytes(r["root"]) for r in rows} == {min(names)}


def test_prefix_filter_loses_nothing(spark, near_texts, monkeypatch):
    """With no link known, the open pairs hold every link around a pivot."""
    monkeypatch.setattr(near_dedup, "components", lambda links: links.limit(0).selectExpr("a as node", "a as root"))
    seen = {}
    real = near_dedup.open_pairs

    def spy(edges, labels, nodes, size):
        seen["edges"], seen["pairs"], seen["nodes"] = edges, real(edges, labels, nodes, size), nodes
        return seen["pairs"]

    monkeypatch.setattr(near_dedup, "open_pairs", spy)
    near_dedup.grouped(docs_of(spark, near_texts)).collect()
    e = seen["edges"].where("node <> pivot")
    every = e.select("pivot", F.col("node").alias("x")).join(e.select("pivot", F.col("node").alias("y")), "pivot").where("x < y")
    links = near_dedup.confirmed(every.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), seen["nodes"])
    assert links.count() > 50 and links.join(seen["pairs"], ["a", "b"], "left_anti").isEmpty()


def test_registers_estimate_jaccard():
    draw = np.random.default_rng(1)
    pool = np.sort(draw.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 6000, dtype=np.uint64))
    one, other = np.sort(pool[:5000]), np.sort(pool[1000:])
    regs = near_dedup.registers(np.concatenate([one, other]), np.repeat([0, 1], 5000), 2)
    estimate, used = near_dedup.estimated_jaccard(regs[:1], regs[1:], np.array([5000.0]), np.array([5000.0]))
    assert used[0] == 256 and abs(estimate[0] - 4000 / 6000) < 0.12
    assert (near_dedup.filled(regs) != 0).all()


# --- mixing and sharding -----------------------------------------------------


def test_targets_and_quotas_like_plain_apportionment(spark):
    draw = random.Random(6)
    for _ in range(4):
        sizes = [draw.choice([0, 3, 50, 400, 5000]) + draw.randrange(50) for _ in range(draw.randrange(1, 9))]
        df = spark.createDataFrame([(f"0{k}", s) for k, s in enumerate(sizes)], "__cw_stratum string, __cw_words long")
        targets = {r["__cw_stratum"]: r["__cw_target"] for r in mixing.source_targets(df).collect()}
        weights, capped = [(5, 2, 1)[k % 3] for k in range(len(sizes))], set()
        while True:
            open_ = [k for k in range(len(sizes)) if k not in capped]
            level = Fraction(sum(sizes) - sum(3 * sizes[k] for k in capped), sum(weights[k] for k in open_) or 1)
            over = {k for k in open_ if weights[k] * level > 3 * sizes[k]}
            if not over:
                break
            capped |= over
        expected = [3 * s if k in capped else float(weights[k] * level) for k, s in enumerate(sizes)]
        assert [targets[f"0{k}"] for k in range(len(sizes))] == pytest.approx(expected)
        block = 16  # at every size
        rows = mixing.block_quotas(mixing.source_targets(df), 16, 5).collect()
        for shard in range(5):
            house = sum(sizes) // block * (shard + 1) // 5
            seats = Counter()
            for _ in range(house):
                seats[max(range(len(sizes)), key=lambda k: (targets[f"0{k}"] / (2 * seats[k] + 1), -k))] += 1
            assert {r["__cw_stratum"]: r["__cw_seats"] for r in rows if r["shard"] == shard} == {f"0{k}": seats[k] for k in range(len(sizes))}
        assert all(r["quota"] >= 0 for r in rows)


def test_mix_meets_its_targets_and_repeats(spark):
    draw = random.Random(9)
    texts = [prose(draw, draw.randrange(1, 120)) for _ in range(400)]
    docs = docs_of(spark, texts, [draw.choice("abcde") for _ in texts])
    one, two = (sorted(map(tuple, mixing.mixed(docs, n_buckets=n).select("doc_id", "taken").collect())) for n in (16, 97))
    assert one == two
    by_source = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["n"] - r["t"]) <= 32 and not r["over"] for r in by_source)
    # Every shard takes its quota of blocks of each source, and together they take what is taken.
    mix = mixing.mixed(docs)
    assert mix.where("taken <> aggregate(shards, 0L, (n, p) -> n + p.words)").isEmpty()
    took = mix.select("source", F.inline("shards")).groupBy("source", "shard").agg(F.sum("words").alias("n")).collect()
    sizes = mix.groupBy(F.concat(F.lit("0"), "source").alias("__cw_stratum")).agg(F.sum("size").alias("__cw_words"))
    targets = mixing.source_targets(sizes)
    quotas = {(r["__cw_stratum"], r["shard"]): r["quota"] * r["__cw_block"] for r in mixing.block_quotas(targets, mixing.BLOCK_WORDS, 8).collect()}
    most = {r["__cw_stratum"]: r["__cw_most"] for r in targets.collect()}
    assert sum(r["n"] for r in took) >= sum(quotas.values()) - 16 * len(most)
    assert all(quotas["0" + r["source"], r["shard"]] - 16 <= r["n"] <= quotas["0" + r["source"], r["shard"]] for r in took) and len(took) == 40
    out = mixing.materialised(mixing.mixed(docs))
    assert out.columns == docs.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_shards_have_the_mixture(spark):
    draw = random.Random(3)
    sources = [draw.choice("aaaabbc") for _ in range(1000)]
    out = sharding.interleaved_shards(docs_of(spark, ["t"] * 1000, sources), n_shards=10)
    rows = out.groupBy("shard", "source").count().collect()
    whole = Counter(sources)
    assert all(abs(r["count"] - whole[r["source"]] / 10) <= 2 for r in rows) and len(rows) == 30
    again = sharding.interleaved_shards(docs_of(spark, ["t"] * 1000, sources), n_shards=10, n_buckets=333)
    assert sorted(map(tuple, out.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, again.select("doc_id", "shard", "slot").collect()))


# --- fingerprints ------------------------------------------------------------


def brute_sketch(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def hashed(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - 2**64 if h >= 2**63 else h

    found = [(hashed(words[k : k + 5]) % 2**64) >> 24 for k in range(max(1, len(words) - 4))] if words else []
    return (1, set(found)) if len(found) <= 64 else (4, {h for h in found if h < 2**38})


def brute_containment(one, other):
    scale = max(one[0], other[0])
    a, b = ({h for h in x[1] if h < 2**40 // scale} for x in (one, other))
    smaller = min(len(a), len(b))
    return 1.0 if one == other else len(a & b) / smaller if smaller else 0.0


def test_fingerprints_like_brute_force(spark):
    draw = random.Random(12)
    texts = [prose(draw, draw.choice([0, 1, 4, 5, 30, 300])) + draw.choice(["", " é😀"]) for _ in range(60)] + [None, "", "same text here", "same text here"]
    # Ids are spread so that several ranges of few rows are made.
    rows = fingerprints.fingerprinted(docs_of(spark, texts), n_rows=20 * fingerprints.ROWS_A_RANGE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        k = r["doc_id"]
        own, following = texts[k] or "", texts[k - 1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = brute_sketch(own), brute_sketch(edited), brute_sketch(following)
        assert r["fingerprint"] == f"{a[0]}:" + "".join(f"{h:010x}" for h in sorted(a[1])) and r["edited_fingerprint"].startswith(f"{b[0]}:")
        assert r["near_edited"] == pytest.approx(brute_containment(a, b)) and r["near_next"] == pytest.approx(brute_containment(a, c))


@pytest.mark.parametrize("n_rows", [10, 40 * fingerprints.ROWS_A_RANGE])
def test_next_document_of_shared_and_missing_ids(spark, monkeypatch, n_rows):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 5 if n_rows > 10 else 2000)
    draw = random.Random(31)
    rows = [(draw.choice([None, 7, 7, 7, 1, 2, 9]), f"text number {k} " + prose(draw, 5)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.fingerprinted(docs, n_rows=n_rows if n_rows > 10 else None).select("text", "edited_sha256").collect()
    ties = {r["text"]: r["t"] for r in docs.select("text", F.xxhash64("text").alias("t")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)]
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in out:
        own, cut = r["text"], len(r["text"]) // 3
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - cut] + following[own][:cut]).encode()).hexdigest()


def test_containment_of_unequal_documents_and_merging(spark):
    draw = random.Random(13)
    part, rest = prose(draw, 2000) + ". ", prose(draw, 8000)
    row = spark.createDataFrame([(part, part + rest, rest)], "p string, w string, r string")
    p, w, r = (fingerprints.sketch(F.col(c)) for c in "pwr")
    got = row.select(fingerprints.containment(p, w).alias("c"), fingerprints.containment(fingerprints.merged(p, r), w).alias("m")).first()
    assert got["c"] > 0.97 and got["m"] > 0.97


def test_short_texts_in_long_ones(spark):
    """Texts of 5 to 40 words, cut from a long one or foreign to it; and sketches that merge to the whole's."""
    draw = random.Random(17)
    whole = prose(draw, 6000).split()
    rows = []
    for n in range(5, 41):
        for _ in range(10):
            at = draw.randrange(len(whole) - n)
            rows.append((n, " ".join(whole[at : at + n]), prose(draw, n), " ".join(whole)))
    df = spark.createDataFrame(rows, "n int, inside string, foreign string, whole string")
    i, f, w = (fingerprints.sketch(F.col(c)) for c in ("inside", "foreign", "whole"))
    out = df.select("n", fingerprints.containment(i, w).alias("i"), fingerprints.containment(f, w).alias("f"), (fingerprints.merged(i, f)["hashes"] == F.array_sort(F.array_union(i["hashes"], f["hashes"]))).alias("m")).collect()
    assert all(r["f"] == 0 and r["m"] and r["i"] in (0.0, 1.0) for r in out)
    found = {low: np.mean([r["i"] for r in out if low <= r["n"] < low + 12]) for low in (5, 17, 29)}
    assert found[5] > 0.5 and found[17] > 0.95 and found[29] > 0.99
    half = len(whole) // 2
    parts = spark.createDataFrame([(" ".join(whole[: half + 4]), " ".join(whole[half:]), " ".join(whole))], "a string, b string, w string")
    a, b, w = (fingerprints.sketch(F.col(c)) for c in "abw")
    assert parts.select(fingerprints.merged(a, b) == w).first()[0]


# --- decontamination ---------------------------------------------------------


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, -1])
def test_benchmark_hits_like_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast_bytes)
    draw = random.Random(14)
    items = [prose(draw, n) for n in (3, 9, 10, 11, 40, 40)] + ["The the the the the the the the the the the", "", None]
    texts = []
    for _ in range(120):
        parts = [prose(draw, draw.randrange(20))]
        for _ in range(draw.randrange(3)):
            w = re.findall(r"\w+", draw.choice(items) or "x")
            a = draw.randrange(len(w))
            parts += [" -- ".join(w[a : a + draw.randrange(1, 30)]).upper(), prose(draw, draw.randrange(5))]
        texts.append(" ".join(parts))
    texts.append("the " * 40)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = [(str(k), tuple(w[i : i + 10])) for k, t in enumerate(items) if (w := words(t)) for i in range(max(1, len(w) - 9))]
    docs = docs_of(spark, texts)
    for r in decontamination.decontaminated(docs, bench).collect():
        w, hit, found = words(r["text"]), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["contaminated"] == bool(hit)


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, -1])
def test_proximity_hits_like_brute_force(spark, monkeypatch, broadcast_bytes):
    """Also where a tile's rarest words stand nowhere, or only elsewhere, in the table."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast_bytes)
    draw = random.Random(15)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [passage, "one two two three three three four five six seven eight nine ten".split(), "red green blue".split(), ["the"] * 10, ["lone"]]
    texts = [["no", "kappa", "here", "the", "the"], ["nothing", "lone"]]
    for item in items:
        for _ in range(25):
            own = list(item)
            for _ in range(draw.randrange(4)):
                k = draw.randrange(len(own))
                own[k : k + draw.randrange(2)] = draw.choice(["x", "x y", "x y z u v w"]).split()
            texts.append(prose(draw, draw.randrange(4)).replace(".", "").replace(",", "").split() + own + ["end"])
    texts.append([w for w in passage if w != "kappa"] + ["changed"])
    texts.append("x alpha gamma beta delta so epsilon zeta eta theta iota kappa".split())
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    out = decontamination.decontaminated(docs_of(spark, [" ".join(t) for t in texts]), bench).collect()
    seen = set()
    for r in out:
        w, found = texts[r["doc_id"]], {}
        for k, item in enumerate(items):
            for at in {max(0, min(a, len(item) - 10)) for a in range(0, len(item), 10)}:
                tile = item[at : at + 10]
                starts = [(p - place, place, p) for place, x in enumerate(tile) for p, y in enumerate(w) if x == y]
                for low, _, _ in starts:
                    near = [s for s in starts if low <= s[0] <= low + decontamination.SLOP]
                    held = min(len({s[1] for s in near}), len({s[2] for s in near}))
                    if held >= (8 if len(tile) == 10 else len(tile)):
                        found[str(k)] = max(found.get(str(k), 0), held / len(tile))
        assert (r["n_near_items"], r["near_contaminated"]) == (len(found), bool(found)), (w, found)
        assert r["near_share"] == pytest.approx(max(found.values(), default=0))
        assert r["near_items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        seen.add((r["contaminated"], r["near_contaminated"]))
    assert {(False, False), (False, True), (True, True)} <= seen
    assert [(r["near_share"], r["contaminated"]) for r in out[-2:]] == [(0.9, False), (1.0, False)]


def test_null_items_are_one(spark):
    bench = spark.createDataFrame([(None, "red green blue"), (None, "green blue"), (7, "blue sky")], "item_id long, text string")
    r = decontamination.decontaminated(docs_of(spark, ["a red green blue sky"]), bench).first()
    assert (r["n_hit"], r["n_items"], r["contaminated"]) == (4, 2, True)
    assert r["items_sha256"] == hashlib.sha256(b"7,null").hexdigest()


def test_clean_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = docs_of(spark, ["a red green blue sky", None, "red", "a red green blue sky"]).withColumn("n_hit", F.lit("other"))
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


# --- quality -----------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op9_pairwise_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() and (rows["predicted"] == rows["quality"]).mean() > 0.95
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()) > 0.97


def test_fit_is_bounded_where_an_id_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, label: seen.append(len(label)))
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('some words ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, None)], "doc_id long, quality int")
    quality.learned(docs, labels)
    usable = [k for k in (0, 1) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert seen == [len(usable)] and usable


def test_cut_is_taken_over_all_labels(spark, monkeypatch):
    """Also beyond the sample; repeated labels and labels of absent documents take no places."""
    monkeypatch.setattr(quality, "SAMPLE", 60)
    draw = random.Random(16)
    texts = [prose(draw, 30) + " #!" * draw.randrange(1 + 6 * (k % 3 == 0)) for k in range(400)]
    docs = docs_of(spark, texts)
    rows = [(k, int(k % 3 != 0)) for k in range(400)] + [(k, 1) for k in (1, 4) for _ in range(300)] + [(k, 0) for k in range(1000, 3000)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    seen, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, label: seen.append(label) or real(x, label))
    model = quality.learned(docs, labels)
    usable = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(seen[0]) == 60 and set(seen[0]) == {0, 1}
    found = {r["doc_id"]: np.array(r["x"]) @ model.weights for r in quality.with_features(docs, ["doc_id"], "text").collect()}
    share = sum(k % 3 == 0 for k in usable) / len(usable)
    assert model.cut == pytest.approx(np.quantile([found[k] for k in usable], share), abs=1e-9)


def test_exact_quantile_like_numpy(spark):
    draw = np.random.default_rng(17)
    for values in (draw.normal(size=301), np.repeat([1.0, 2.0], 50), np.append(draw.normal(size=99) * 1e-9, 1e9)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(1)
        for share in (0.0, 0.3, 0.5, 1.0):
            assert quality.exact_quantile(df, len(values), share, 16) == pytest.approx(np.quantile(values, share), rel=1e-9, abs=1e-15)


def test_features_like_brute_force():
    draw = random.Random(41)
    texts = ["".join(draw.choice("ab AB1.,é#!\n\x01?x y ") for _ in range(draw.randrange(80))) for _ in range(60)] + ["", "w w w", "é" * 9]
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = quality.features(np.frombuffer(b"".join(data), np.uint8), bounds)
    for k, raw in enumerate(data):
        shares = [0.0] * quality.N_CLASSES
        for b in raw:
            shares[quality.BYTE_CLASS[b]] += 1 / len(raw)
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        n, sizes = max(len(words), 1), [len(w) for w in words]
        more = [len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(sizes) / n, (sum(x * x for x in sizes) / n) ** 0.5, sum(x <= 3 for x in sizes) / n]
        more += [np.log1p(len(words)), np.log1p(len(words)) ** 2 / 10]
        assert got[k] == pytest.approx([*shares, *np.sqrt(shares), *more])


def test_fit_is_at_the_optimum_of_the_pairwise_loss(monkeypatch):
    """Plain gradient descent on the same pairs ends where the fit does."""
    monkeypatch.setattr(quality, "PAIRS", 400)
    noise = np.random.default_rng(1)
    label = (np.arange(200) % 2).astype(int)
    x = noise.normal(size=(200, 3)) + label[:, None] * np.array([0.8, -0.5, 0.0])
    model = quality.fit(x, label)
    scale = x.std(axis=0)
    draw, z = np.random.default_rng(5), x / scale
    diff = z[draw.choice(np.flatnonzero(label == 1), 400)] - z[draw.choice(np.flatnonzero(label == 0), 400)]
    w = np.zeros(3)
    for _ in range(4000):
        w += 0.5 * ((diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) - quality.RIDGE * w)
    assert model.weights * scale == pytest.approx(w, abs=1e-4)
    assert model.cut == pytest.approx(np.quantile(z @ w, 0.5), abs=1e-3)


def test_ranking_learns_an_order():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 4))
    label = (x[:, 0] - 2 * x[:, 1] > 0).astype(int)
    model = quality.fit(x, label)
    assert ((model.score(x) >= quality.KEEP_AT) == label).mean() > 0.97


# --- licences and URLs -------------------------------------------------------


def test_license_texts_survive_layout_and_spelling(spark):
    mit = licenses.LICENSES["MIT"]
    texts = [
        "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("\n", "\r\n   "),
        mit.replace("sublicense", "sublicence").replace(".", " . "),
        mit + " with more",
        "intro\n  Released under the M.I.T. Licence. \nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        "Licensed under the Apache Licence, version 2.0",
    ]
    rows = {r["doc_id"]: r for r in licenses.scanned(docs_of(spark, texts)).collect()}
    assert [rows[k]["license"] for k in range(5)] == ["MIT", "MIT", None, None, "Apache-2.0"]
    assert (rows[3]["notices"], rows[3]["n_notices"]) == ("CC-BY-NC-4.0", 2)
    assert all(rows[k]["text_sha256"] == licenses.digest_of(t) for k, t in enumerate(texts))


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text.replace("\n", " "), width))


def test_published_wrappings_titles_and_odd_line_ends(spark):
    isc, mit = licenses.LICENSES["ISC"], licenses.LICENSES["MIT"]
    cases = [
        ("ISC", "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\nCopyright © 1995 X\n\n" + wrapped(isc, 78)),
        ("MIT", "The MIT License (MIT)\r\n\r\nCopyright (c) 2020 A\r\n\r\n" + wrapped(mit, 72).replace("\n", "\r\n")),
        ("MIT", "MIT License\n\n" + "\n".join(f" * {line}" for line in wrapped(mit, 60).split("\n"))),
        ("BSD-3-Clause", "BSD 3-Clause License\n(c) 2001 B\nAll rights reserved.\n" + re.sub(r"(?m)^(\d)\. ", r"  (\1) ", licenses.LICENSES["BSD-3-Clause"])),
        ("BSD-2-Clause", re.sub(r"(?m)^\d\. ", "* ", licenses.LICENSES["BSD-2-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))),
        ("Unlicense", wrapped(licenses.LICENSES["Unlicense"], 79)),
        (None, "foo\rcopyright 2001 me\rbar"),
        (None, "the licence licence favour favour v2 v2"),
    ]
    assert any(line.startswith("copyright notice") for line in wrapped(isc, 78).split("\n"))
    rows = {r["doc_id"]: r for r in licenses.scanned(docs_of(spark, [t for _, t in cases])).collect()}
    assert [rows[k]["license"] for k in range(len(cases))] == [name for name, _ in cases]
    assert all(rows[k]["text_sha256"] == licenses.digest_of(t) for k, (_, t) in enumerate(cases))
    plain = ["foo copyright 2001 me bar", "the license license favor favor version 2 version 2"]
    assert [rows[k]["text_sha256"] for k in (6, 7)] == [hashlib.sha256(t.encode()).hexdigest() for t in plain]


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="needs the system's own copies of the licences")
@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_digests_of_published_texts(file, name):
    text = (COMMON / file).read_text(encoding="utf-8")
    for version in (text, text.upper(), "\n".join("# " + line for line in text.split("\n"))):
        assert licenses.DIGESTS[licenses.digest_of(version)] == name


def test_url_rules(spark):
    cases = [
        ("http://a.example.com/en/7x", "example.com/en/7", "allow"),
        ("https://a.com/en/8", "com/en/", "block"),
        ("HTTP://A.COM/EN/8", None, "allow"),
        ("http://notexample.com/en/7", "com/en/", "block"),
        ("http://x.example.net/de/8", "example.net/de/8", "block"),
        ("http://net/de/1?q#f", "net/de/", "allow"),
        ("http://example.org/es/1", "org/es/", "block"),
        ("http://spam-farm.example.org/fr/", None, "block"),
        ("http://spam-farm.example.net/de/1", "net/de/", "allow"),
        ("http://x.org/setup.exe?x", None, "block"),
        ("http://spamfarm.org/", None, "allow"),
        ("http://x.org/a/calendar/2031/4", None, "block"),
        ("http://x.org/mycalendar/2031/4", None, "allow"),
        ("http://x.org/a;jsessionid=0aF?x", None, "block"),
        ("http://x.org/Tag/red/Page/3", None, "block"),
        ("http://x.org/research", None, "allow"),
        ("http://x.org/search.php?q=1", None, "block"),
        ("http://10.0.0.1:80/a", None, "block"),
        ("http://a.best-poker24.io", None, "block"),
        ("http://x.org/poker.html", None, "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
        ("", None, "allow"),
        ("x://?://com/en/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(cases)], "page_id long, url string")
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    assert [rows[k] for k in range(len(cases))] == [c[1:] for c in cases]


@pytest.mark.parametrize("literal_rules", [url_filters.LITERAL_RULES, 0])
def test_index_finds_what_all_rules_would(spark, monkeypatch, literal_rules):
    monkeypatch.setattr(url_filters, "LITERAL_RULES", literal_rules)
    draw = random.Random(21)
    words = ["alpha", "beta", "gamma", "delta", "x1"]
    rules = [url_filters.path_rule(draw.choice(["allow", "block"]), f"{draw.choice(words)}.com/{draw.choice(words)}/{draw.choice(words)[:3]}") for _ in range(60)]
    patterns = [url_filters.Rule(f"p{k}", "block", (w := draw.choice(words),), rf"/{w}/[{draw.choice('abgdx')}][a-z0-9]+$") for k in range(30)]
    urls = [f"http://{draw.choice(['', 'www.'])}{draw.choice(words)}.com/{draw.choice(words)}/{draw.choice(words)}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for r in url_filters.filter_urls(pages, tuple(rules), tuple(patterns)).collect():
        fit = [x.name for x in rules if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.prefix)]
        assert r["rule"] == (max(fit, key=lambda n: (len(n), n)) if fit else None)
        found = [x.name for x in patterns if re.search(x.regex, r["host"] + r["path"])]
        assert r["pattern_rule"] == (min(found) if found else None)


# --- queries -----------------------------------------------------------------


def test_queries_and_oracles_agree_by_name():
    assert set(ORACLES) <= set(QUERIES) and {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))


def test_native_queries_run_no_python(spark):
    for n in (3, 4, 6, 7, 8, 10):
        name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan), name

"""Secret scans: all rules in one byte pass of a combined deterministic automaton.

The combined automaton marks the bytes where some rule's head ends, the bounded part that
each of its matches begins with. Texts of a batch run through it side by side (one table lookup a
step for all of them), and the long tail of the longest ones one byte after another. At a mark the
rule's backward automaton finds where the head starts, and its own automaton follows the match
from there to its end: the leftmost start at or after the end of that rule's match before, and
the longest end. A pack whose combined automaton would outgrow MOST_STATES is halved, and its
halves scan one after the other. Memory is bounded by STEP_BYTES of text at a time (or one
text, of which a few bytes a byte are held), whatever the batch.

Defined results: null counts as empty; empty texts have no spans; rows are judged one by one, so
repeated rows and ids repeat their result; an empty table gives no rows. Spans are in code
points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.automaton import Dfa, TooManyStates, compile_trees, head_of, tree_of
from cloakwork.llm.common import table, without

STEP_BYTES = 16 << 20
STRETCH = 1 << 16  # bytes of a long text that are taken into a list at a time
FEW = 64  # texts at a time below which one byte after another is faster
MOST_STATES = 20_000


@dataclass(frozen=True)
class SecretRule:
    """``least`` is the fewest bytes of ``part`` (a group of the pattern; 0 is the whole match)."""

    kind: str
    pattern: str
    least: int
    part: int = 0
    any_case: bool = False


# Fixed values.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        part=2,
        any_case=True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 16),
    SecretRule("hex", r"[0-9a-f]+", 32),
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    SecretRule("google", r"AIza[0-9A-Za-z_-]+", 39),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    SecretRule("stripe", r"[rs]k_live_[0-9a-zA-Z]+", 32),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    SecretRule("npm", r"npm_[A-Za-z0-9]+", 40),
    SecretRule("pypi", r"pypi-[A-Za-z0-9_-]+", 50),
    SecretRule("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    SecretRule("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]+", 38),
    SecretRule("square", r"sq0(atp|csp|idp)-[0-9A-Za-z_-]+", 29),
    SecretRule("digitalocean", r"do[opr]_v1_[0-9a-f]+", 71),
    SecretRule("huggingface", r"hf_[A-Za-z0-9]+", 37),
    SecretRule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", 60),
    SecretRule("azure_key", r"AccountKey=[A-Za-z0-9+/=]+", 99),
)


@dataclass(frozen=True)
class Scanner:
    """``combined`` holds (automaton, number of its first rule): one, unless the pack is too large."""

    rules: tuple[SecretRule, ...]
    combined: tuple[tuple[Dfa, int], ...]
    heads: tuple[Dfa, ...]
    whole: tuple[Dfa, ...]

    @staticmethod
    @lru_cache(maxsize=16)
    def of(rules: tuple[SecretRule, ...], most_states: int = MOST_STATES) -> Scanner:
        trees = [tree_of(r.pattern, r.any_case) for r in rules]
        heads = [head_of(tree, 0 if r.part else r.least) for tree, r in zip(trees, rules, strict=True)]

        def together(first: int, past: int) -> tuple[tuple[Dfa, int], ...]:
            try:
                return ((compile_trees(heads[first:past], True, most_states=most_states if past - first > 1 else 1 << 30), first),)
            except TooManyStates:
                middle = (first + past) // 2
                return together(first, middle) + together(middle, past)

        combined = together(0, len(rules)) if rules else ()
        return Scanner(rules, combined, tuple(compile_trees([h], False, True) for h in heads), tuple(compile_trees([t], False) for t in trees))

    def marks(self, dfa: Dfa, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which some head ends, and the number of the rules' set, over texts in ``data``."""
        n = dfa.n_classes
        step = dfa.step * n  # states are kept as row offsets
        accept = np.repeat(dfa.accept, n)
        order = np.argsort(starts - ends, kind="stable")
        at, size = starts[order].copy(), (ends - starts)[order]
        state = np.zeros(len(order), np.int32)
        where, sets = [], []
        t, active = 0, int(np.searchsorted(-size, 0, "left"))
        while active >= FEW:
            state = step[state[:active] + dfa.byte_class[data[at[:active]]]]
            at = at[:active] + 1
            hit = np.flatnonzero(accept[state])
            if len(hit):
                where.append(at[hit])
                sets.append(accept[state[hit]])
            t += 1
            active = int(np.searchsorted(-size, -t, "left"))
        slow_step, slow_accept = step.tolist(), accept.tolist()
        found, found_sets = [], []
        for k in range(active):
            s, past = int(state[k]), int(ends[order[k]])
            for first in range(int(at[k]), past, STRETCH):
                for i, c in enumerate(dfa.byte_class[data[first : min(first + STRETCH, past)]].tolist(), first + 1):
                    s = slow_step[s + c]
                    if slow_accept[s]:
                        found.append(i)
                        found_sets.append(slow_accept[s])
        where.append(np.array(found, np.int64))
        sets.append(np.array(found_sets, np.int32))
        where, sets = np.concatenate(where), np.concatenate(sets)
        by_place = np.argsort(where, kind="stable")
        return where[by_place], sets[by_place]

    def starts_of(self, rule: int, data: bytes, end: int, least: int) -> list[int]:
        """Where heads of a rule that end at ``end`` start, at or after ``least``, in order."""
        dfa, state, found = self.heads[rule], 0, []
        n = dfa.n_classes
        for i in range(end - 1, least - 1, -1):
            state = dfa.step[state * n + dfa.byte_class[data[i]]]
            if state == dfa.dead:
                break
            if dfa.accept[state]:
                found.append(i)
        return found[::-1]

    def end_of(self, rule: int, data: bytes, start: int) -> int:
        """The end of the longest match from ``start``; -1 if there is none."""
        dfa, state, found = self.whole[rule], 0, -1
        n = dfa.n_classes
        for i in range(start, len(data)):
            state = dfa.step[state * n + dfa.byte_class[data[i]]]
            if state == dfa.dead:
                break
            if dfa.accept[state]:
                found = i + 1
        return found

    def matches(self, rule: int, data: bytes, ends: list[int], exact: list) -> Iterator[tuple[int, int, int]]:
        """(start, rule, end) of a rule in one text, from the ends of its heads."""
        spec, last, tried = self.rules[rule], 0, -1
        for head_end in ends:
            if head_end <= last:
                continue  # within the match before
            for start in self.starts_of(rule, data, head_end, max(last, tried + 1)):
                tried = start
                end = self.end_of(rule, data, start)
                if end < 0:
                    continue
                last = end
                part = data[start:end]
                if spec.part:
                    part = exact[rule].fullmatch(part)[spec.part]
                if len(part) >= spec.least:
                    yield start, rule, end
                break

    def spans(self, data: bytes, marks: list[tuple[Dfa, int, np.ndarray, np.ndarray]], exact: list) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, from the marks (automaton, first rule, places, sets) of one text."""
        ends: dict[int, list[int]] = {}
        for dfa, first, where, sets in marks:
            for place, number in zip(where.tolist(), sets.tolist(), strict=True):
                for rule in dfa.ends[number]:
                    ends.setdefault(first + rule, []).append(place)
        return sorted(x for rule, own in ends.items() for x in self.matches(rule, data, own, exact))

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
        """(row, spans) for the rows of ``texts`` that have any, in code points."""
        exact = [re.compile(r.pattern.encode(), re.IGNORECASE * r.any_case) for r in self.rules]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1)
            low, high = int(offsets[first]), int(offsets[past])
            block, bounds = data[low:high], offsets[first : past + 1] - low
            found = []
            for dfa, rule in self.combined:
                where, sets = self.marks(dfa, block, bounds[:-1], bounds[1:])
                found.append((dfa, rule, where, sets, np.searchsorted(bounds, where, "left") - 1))
            for k in sorted({k for *_, row in found for k in np.unique(row).tolist()}):
                own = block[bounds[k] : bounds[k + 1]].tobytes()
                marks = []
                for dfa, rule, where, sets, row in found:
                    a, b = np.searchsorted(row, [k, k + 1])
                    marks.append((dfa, rule, where[a:b] - bounds[k], sets[a:b]))
                spans = self.spans(own, marks, exact)
                if spans:
                    yield first + k, _in_code_points(own, [(self.rules[r].kind, s, e) for s, r, e in spans])
            first = past


def _in_code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if data.isascii():
        return spans
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(starts[s]), int(starts[e])) for kind, s, e in spans]


def scanned(
    docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, keep: list[str] | None = None, text_col: str = "text"
) -> DataFrame:
    """``keep`` columns (all but the text by default) and ``secrets``: array of kind, start, end."""
    keep = [c for c in docs.columns if c != text_col and c.lower() != "secrets"] if keep is None else keep
    scanner = Scanner.of(rules)  # compiled once, on the driver
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            texts = batch.column(0)
            texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
            found = dict(scanner.scan(texts))
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, ())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(spans, shape), *batch.columns[1:]], ["secrets", *batch.schema.names[1:]])

    source = docs.select(F.col(text_col).alias("__cw_text"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in without(source, "__cw_text").schema.fields)
    spans = "secrets array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(scan, f"{spans}, {kept}" if kept else spans)


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = tuple(r.kind for r in BASE_RULES)
    counts = [F.size(of_kinds(F.col("secrets"), (k,))).cast("bigint").alias(f"n_{k}") for k in base]
    return spans.select(
        "doc_id", *counts, F.sha2(joined(of_kinds(F.col("secrets"), base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def spans_by_regex(text: str, rules: tuple[SecretRule, ...] = BASE_RULES) -> list[str]:
    """The same spans by regular expressions, one rule at a time: the brute force of the tests."""
    found = []
    for order, r in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        for m in re.finditer(r.pattern, text, flags):
            if len(m[r.part].encode()) >= r.least:
                found.append((m.start(), order, f"{r.kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]

"""Secrets in whole texts: a trigram index chooses the documents that each rule's regex must read.

From each rule's regex a Boolean query of trigrams follows: an OR of ANDs of trigrams that every match
has in lower case. The index holds postings (trigram, document) for the trigrams that rules ask for.
A rule's candidates are the documents whose postings satisfy its query; a rule without a mandatory trigram reads
all. Candidates are verified by the regex itself. The postings are combined by their documents, so that
a trigram that most documents hold is no hot key.

A null or empty text has no spans. Rows with equal doc_id share candidates and are verified each by itself.
Rows with a null doc_id are read by every rule. Only DataFrame functions are used. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as kind, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.workspace import materialize

MAX_STRINGS = 64  # of a part of a regex that are followed one by one
BLOCK = 64  # matches
Clauses = list[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """A regex, and what the text of `group` must have at least. `base` rules are counted by name."""

    name: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    base: bool = False


RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, min_chars=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=20, base=True),
    Rule("hex", r"[0-9a-f]+", min_chars=24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", min_chars=40),
]


def _trigrams(strings: set[str]) -> Clauses:
    """OR over the strings of the AND of their trigrams; nothing is known if one is too short."""
    if any(len(s) < 3 for s in strings):
        return []
    return [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]


def _better(a: Clauses, b: Clauses) -> Clauses:
    """Both hold; a query with longer ANDs lets fewer documents through."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda c: min(map(len, c)))


def _walk(nodes) -> tuple[set[str] | None, Clauses]:
    """The strings that a part matches, if they are few, and the trigrams that each match has."""
    strings: set[str] = {""}
    exact, best = True, []

    def cut() -> None:
        nonlocal strings, exact, best
        best, strings, exact = _better(best, _trigrams(strings)), {""}, False

    for op, value in nodes:
        part, inner = None, []
        if op is kind.LITERAL:
            part = {chr(value).lower()}
        elif op is kind.SUBPATTERN:
            part, inner = _walk(value[-1])
        elif op is kind.BRANCH:
            branches = [_walk(branch) for branch in value[1]]
            if all(b[0] is not None for b in branches):
                part = set().union(*(b[0] for b in branches))
            elif all(b[1] for b in branches):
                inner = [clause for b in branches for clause in b[1]]
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
            low, high, body = value
            one, inner = _walk(body)
            if one is not None and high <= 2:
                part = reduce(lambda a, n: a | {x + y for x in a for y in one} if n >= low else
                              {x + y for x in a for y in one}, range(high), {""})
            inner = inner if low else []
        elif op is kind.IN and len(value) <= 8 and all(o is kind.LITERAL for o, _ in value):
            part = {chr(v).lower() for _, v in value}
        best = _better(best, inner)
        if part is None:
            cut()
        elif len(joined := {x + y for x in strings for y in part}) > MAX_STRINGS:
            cut()
            strings = part
        else:
            strings = joined
    if exact:
        return strings, best
    return None, _better(best, _trigrams(strings))


def trigram_query(pattern: str) -> Clauses:
    """OR of ANDs of trigrams in lower case; empty if no trigram is mandatory."""
    strings, clauses = _walk(parser.parse(pattern))
    if strings is not None:
        clauses = _better(clauses, _trigrams(strings))
    return sorted({c for c in clauses if not any(other < c for other in clauses)}, key=sorted)


def trigram_index(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, stored."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return materialize(documents.filter(F.col("doc_id").isNotNull()).select(F.explode(held).alias("trigram"),
                                                                            "doc_id"), "postings")


def candidates(postings: DataFrame, rules: list[Rule], trigrams: list[str]) -> DataFrame:
    """doc_id and the bits of the rules whose Boolean query its postings satisfy."""
    bit = {t: 1 << i for i, t in enumerate(trigrams)}
    number = F.create_map(*[F.lit(x) for t in trigrams for x in (t, bit[t])])
    held = postings.groupBy("doc_id").agg(F.bit_or(number[F.col("trigram")]).alias("held"))

    def passes(rule: Rule) -> Column:
        masks = [sum(bit[t] for t in clause) for clause in trigram_query(rule.pattern)]
        return reduce(Column.__or__, [F.col("held").bitwiseAND(F.lit(m)) == F.lit(m) for m in masks], F.lit(False))

    bits = sum((F.when(passes(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules)), F.lit(0))
    return held.select("doc_id", bits.alias("rule_bits")).filter(F.col("rule_bits") != 0)


def _in_turn(items: Column, length: Callable[[Column], Column], place: Callable[[Column, Column], Column],
             kind: str) -> Column:
    """(at, out): the sum of the items' lengths, and each item placed at the sum before it."""
    return F.aggregate(items, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
                       lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"),
                                               F.concat(acc["out"], F.array(place(acc["at"], x))).alias("out")))


def _placed(sizes: Column) -> Column:
    """Array of (start, stop) from one of (gap, size).

    Appending to an array copies it, so sums run inside blocks of `BLOCK` items, and then over the blocks.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")),
                         lambda b: _in_turn(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)),
                                            lambda p: p["gap"] + p["size"],
                                            lambda at, p: F.struct((at + p["gap"]).alias("start"),
                                                                   (at + p["gap"] + p["size"]).alias("stop")),
                                            "struct<start:int,stop:int>"))
    return F.transform(F.array(blocks), lambda held: F.flatten(F.zip_with(
        held, _in_turn(held, lambda b: b["at"], lambda at, b: at, "int")["out"],
        lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"),
                                                               (s["stop"] + at).alias("stop"))))))[0]


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rule, end) of the rule's matches, leftmost and non-overlapping, in code points."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # The text is what lies between the matches and the matches in turn; running sums give their places.
    sizes = F.zip_with(found, between, lambda m, gap: F.struct(
        F.coalesce(F.char_length(gap), F.lit(0)).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("size")))
    placed = F.transform(F.array(sizes), _placed)[0]
    good = F.filter(F.zip_with(F.slice(placed, 1, F.size(found)), tested, lambda s, t: F.struct(
        s["start"].alias("start"), F.lit(order).alias("kind"), s["stop"].alias("stop"),
        F.char_length(t).alias("size"))), lambda s: s["size"] >= rule.min_chars)
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                s["stop"].alias("stop")))


def find_secrets(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and `found`: the spans of all rules as (start, kind, stop), by start, then kind."""
    rules = rules or RULES
    trigrams = sorted({t for rule in rules for clause in trigram_query(rule.pattern) for t in clause})
    if len(trigrams) > 63:
        raise ValueError("at most 63 trigrams: give the rules in several calls")
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = candidates(trigram_index(docs, trigrams), rules, trigrams)
    bits = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.coalesce("rule_bits", F.lit(0)))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    parts = []
    for i, rule in enumerate(rules):
        found = spans(F.col("text"), _shorter(rule), i)
        indexed = bool(trigram_query(rule.pattern))
        parts.append(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, found).otherwise(none) if indexed else found)
    # The candidates grow with the documents: one plan at every size, no broadcast while they are few.
    return (docs.hint("merge").join(chosen, "doc_id", "left").select("doc_id", "text", bits.alias("bits"))
            .select("doc_id", F.array_sort(F.concat(*parts)).alias("found")))


def _shorter(rule: Rule) -> Rule:
    """A rule whose last class must be long enough for the whole match asks so in its regex.

    Only where plain characters of that class come before it: a match then ends where a run of the class does, and
    one that is too short leaves no room for a later one in its run. Other rules are left as they are.
    """
    if rule.group or not rule.pattern.endswith("]+") or rule.min_chars < 2:
        return rule
    head, last = rule.pattern[:rule.pattern.rindex("[")], rule.pattern[rule.pattern.rindex("["):-1]
    if re.fullmatch(r"[A-Za-z0-9]*", head) is None or re.fullmatch(f"{last}*", head) is None:
        return rule
    return Rule(rule.name, f"{head}{last}{{{rule.min_chars - len(head)},}}", 0, rule.min_chars, rule.base)

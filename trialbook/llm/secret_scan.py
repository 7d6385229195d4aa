"""Secrets in documents by a trigram inverted index, in DataFrame expressions only.

From each rule's regular expression a Boolean query over trigrams is derived: what every
match must contain. The index lists, for each trigram, the texts that hold it (upper and
lower case alike; equal texts are one entry). The postings of a rule's trigrams are
intersected and united by the query, and only texts that satisfy it are searched with the
expression. A rule whose matches must contain no trigram searches every text.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` (0: all of it) has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The base rules, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Public formats of two more kinds of keys.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)

#: Alternatives of literal text that are followed in one piece; beyond, the piece is cut.
ALTERNATIVES = 64

Query = frozenset  # of frozensets of trigrams: one of them must be present whole; empty: anything


def _any_of(*queries: Query) -> Query:
    return frozenset() if not all(queries) else _slim(frozenset().union(*queries))


def _all_of(a: Query, b: Query) -> Query:
    if not a or not b:
        return a or b
    return _slim(frozenset(x | y for x, y in product(a, b)))


def _slim(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _texts(strings: set[str]) -> Query:
    grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return frozenset() if not all(grams) else _slim(frozenset(grams))


def _exact(op, value) -> set[str] | None:
    """All texts an element can match, in lower case, if they are few."""
    if op is parser.LITERAL:
        return {chr(value).lower()}
    if op is parser.IN:
        found = set()
        for kind, what in value:
            if kind is parser.LITERAL:
                found.add(chr(what).lower())
            elif kind is parser.RANGE and what[1] - what[0] < 8:
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is parser.SUBPATTERN:
        return _exact_all(value[3])
    if op is parser.BRANCH:
        parts = [_exact_all(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is parser.MAX_REPEAT and value[1] <= 4:
        part = _exact_all(value[2])
        if part is None:
            return None
        return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)}
    return None


def _exact_all(elements) -> set[str] | None:
    found = {""}
    for op, value in elements:
        part = _exact(op, value)
        if part is None or len(found) * len(part) > ALTERNATIVES:
            return None
        found = {a + b for a in found for b in part}
    return found


def _query(elements) -> Query:
    found, piece = frozenset(), {""}
    for op, value in elements:
        part = _exact(op, value)
        if part is not None and len(piece) * len(part) <= ALTERNATIVES:
            piece = {a + b for a in piece for b in part}
            continue
        found, piece = _all_of(found, _texts(piece)), part or {""}
        if part is None:
            if op is parser.SUBPATTERN:
                found = _all_of(found, _query(value[3]))
            elif op is parser.BRANCH:
                found = _all_of(found, _any_of(*map(_query, value[1])))
            elif op is parser.MAX_REPEAT and value[0] > 0:
                found = _all_of(found, _query(value[2]))
    return _all_of(found, _texts(piece))


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` contains, in lower case; empty: nothing certain."""
    return _query(parser.parse(pattern))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The index: (trigram, h1, h2), a row for each text that holds the trigram. h1 and h2
    name a text. ``trigrams`` are those that any query asks for."""
    value = F.coalesce(F.col(text), F.lit(""))
    held = F.transform(
        F.array(F.lower(value)), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    )
    return docs.select(F.explode(F.element_at(held, 1)).alias("trigram"), *_keys(value))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(h1, h2, rules): texts that satisfy the trigram query of at least one rule."""
    grams = sorted({t for q in queries.values() for a in q for t in a})
    place = {t: divmod(i, 62) for i, t in enumerate(grams)}
    words = range(len(grams) // 62 + 1)

    def bits(wanted, word: int) -> int:
        return sum(1 << b for t in wanted for w, b in [place[t]] if w == word)

    found = reduce(lambda c, t: c.when(F.col("trigram") == t, F.lit(place[t][1])), grams, F.when(F.lit(False), F.lit(0)))
    of_word = reduce(lambda c, t: c.when(F.col("trigram") == t, F.lit(place[t][0])), grams, F.when(F.lit(False), F.lit(0)))
    rows = index.select("h1", "h2", found.alias("bit"), of_word.alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    masks = rows.groupBy("h1", "h2").agg(*(F.bit_or(F.when(F.col("word") == w, one).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words))

    def holds(query: Query) -> Column:
        ways = [
            reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(b).cast("long")) == F.lit(b).cast("long") for w in words for b in [bits(a, w)] if b])
            for a in sorted(query, key=sorted)
        ]
        return reduce(Column.__or__, ways)

    rules = F.filter(F.array(*(F.when(holds(q), F.lit(kind)) for kind, q in queries.items())), F.isnotnull)
    return masks.select("h1", "h2", rules.alias("rules")).where(F.size("rules") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the rule's matches that count, in code points.

    The text between matches and the matches themselves give the positions by their lengths.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def placed(p: Column) -> Column:
        lengths = F.transform(p["all"], F.length)
        gaps = F.transform(p["between"], F.length)
        ends = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n"), (g + n).alias("step")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        walked = F.aggregate(
            F.filter(ends, lambda e: e["n"].isNotNull()), start,
            lambda s, e: F.struct((s["at"] + e["step"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + e["g"]).alias("start"), (s["at"] + e["step"]).alias("end"))).alias("out")),
        )["out"]
        both = F.zip_with(walked, p["value"], lambda s, v: F.when(F.length(v) >= rule.least, F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))))
        return F.filter(both, F.isnotnull)

    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return _let(parts, lambda p: F.when(F.size(p["all"]) > 0, placed(p)).otherwise(none))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Per row: key, n_<kind> for each rule, base_sha256 and spans.

    Spans are kind:start:end in code points by start, then rule order, comma-joined; the
    digest covers the base rules. Null and empty texts have none. Repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    rows = docs.select(F.col(key).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    if indexed:
        grams = sorted({t for q in indexed.values() for a in q for t in a})
        found = candidates(postings(rows, grams, "value"), indexed)
        rows = attach(rows.select("row_key", "value", *_keys(F.col("value"))), found, ["h1", "h2"])
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    for order, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) if rule.kind in indexed else F.lit(True)
        rows = rows.withColumn(f"of_{order}", F.when(wanted, spans(F.col("value"), _quick(rule), order)).otherwise(none))
    base = F.array_sort(F.flatten(F.array(*(F.col(f"of_{i}") for i, r in enumerate(rules) if r in BASE)))) if any(r in BASE for r in rules) else none
    every = F.array_sort(F.flatten(F.array(*(F.col(f"of_{i}") for i in range(len(rules))))))
    return rows.select(
        F.col("row_key").alias(key),
        *(F.size(f"of_{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def _quick(rule: Rule) -> Rule:
    """A rule that is one repeated class asks for its least length in the expression itself:
    runs are maximal, so the same matches are left, and short runs are never listed."""
    tree = list(parser.parse(rule.pattern))
    if len(tree) == 1 and tree[0][0] is parser.MAX_REPEAT and rule.group == 0 and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule

"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus-signs, digits, scheme
marks and account cues. A parser per kind expands its anchors to both sides, character class
by character class, and validates the result. Each parser follows its kind from left to
right and never starts before the end of its last expansion, so the spans equal those of the
leftmost, non-overlapping matches of the kind's grammar.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = frozenset("0123456789")
LOCAL = frozenset(LETTERS + "0123456789._%+-")
LABEL = frozenset(LETTERS + "0123456789-")
PHONE = frozenset(" ().0123456789-")
#: Schemes and cues are looked for in the text with A-Z lower-cased, which keeps all places.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "a/c")
ALNUM = frozenset(LETTERS + "0123456789")
URL = frozenset(LETTERS + "0123456789-._~:/?#[]@!$&'()*+,;=%")
KINDS = ("email", "ip", "card", "phone", "url", "account")

#: What may stand between a cue and its number.
_gap = re.compile(r"[\s:=#.()-]*(?:(?:no|nr|num|number|code)(?![a-z0-9])[\s:=#.()-]*)?", re.IGNORECASE)
#: Runs of a class from a position on; only used to step over characters of that class.
_label, _digits, _phone, _chain = (
    re.compile(p) for p in (r"[A-Za-z0-9-]+", r"[0-9]+", r"[ ().0-9-]+", r"(?:[ -]?[0-9])*")
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in sorted(DIGITS))]:
        found.add_word(anchor, (kind, 1))
    for anchor in SCHEMES:
        found.add_word(anchor, ("scheme", len(anchor)))
    for anchor in CUES:
        found.add_word(anchor, ("cue", len(anchor)))
    found.make_automaton()
    return found


def _end(pattern: re.Pattern, text: str, at: int) -> int:
    found = pattern.match(text, at)
    return found.end() if found else at


def email_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign, if its name and at least two labels are there."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    end = _end(_label, text, at + 1)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = _end(_label, text, end + 1)
        dots += 1
    return (start, end) if dots else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def dotted_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Four dotted numbers from a run of digits on: start, end and whether each fits a byte."""
    end, parts = at, []
    for k in range(4):
        if k:
            if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
                return None
            end += 1
        start, end = end, _end(_digits, text, end)
        parts.append(text[start:end])
    return at, end, all(map(_small, parts))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """A number from a plus-sign on: digit, then phone characters up to the last digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _end(_phone, text, at + 2)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def url_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A link from its scheme on; closing punctuation is not part of it."""
    from_ = end
    while end < len(text) and text[end] in URL:
        end += 1
    while end > from_ and text[end - 1] in ".,;:!?)]'":
        end -= 1
    return (start, end) if end > from_ else None


def account_at(text: str, end: int) -> tuple[int, int] | None:
    """The account number after a cue: country, check digits, 11 to 30 more, checked mod 97."""
    end = _end(_gap, text, end)
    start, taken = end, []
    while end < len(text) and len(taken) < 34:
        if text[end] in ALNUM:
            taken.append(text[end].upper())
            end += 1
        elif text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM:
            end += 1
        else:
            break
    for size in range(len(taken), 14, -1):
        if taken[0].isalpha() and taken[1].isalpha() and taken[2] in DIGITS and taken[3] in DIGITS:
            turned = taken[4:size] + taken[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                stop, left = start, size
                while left:
                    left -= text[stop] != " "
                    stop += 1
                return start, stop
    return None


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end) by kind as listed, then start; end is exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = chain = phone = url = account = 0  # where each kind may start again
    run_end = 0
    for last, (anchor, size) in automaton().iter(text.encode().lower().decode()):
        if anchor == "digit":
            if last >= chain:
                end = _end(_chain, text, last + 1)
                chain = end
                if end > last + 1:
                    digits = text[last:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((last, end))
            if last >= ip and last >= run_end:
                run_end = _end(_digits, text, last + 1)
                if run_end < len(text) and text[run_end] == "." and (dotted := dotted_at(text, last)):
                    ip = dotted[1]
                    if dotted[2]:
                        found["ip"].append(dotted[:2])
        elif anchor == "at":
            if (span := email_at(text, last, email)) is not None:
                found["email"].append(span)
                email = span[1]
        elif anchor == "plus":
            if last >= phone and (span := phone_at(text, last)) is not None:
                phone = span[1]
                if 8 <= sum(c in DIGITS for c in text[last : span[1]]) <= 15:
                    found["phone"].append(span)
        elif anchor == "scheme":
            if last >= url and (span := url_at(text, last - size + 1, last + 1)) is not None:
                found["url"].append(span)
                url = span[1]
        elif last >= account and (span := account_at(text, last + 1)) is not None:
            found["account"].append(span)
            account = span[1]
    return [(kind, *span) for kind in KINDS for span in found[kind]]


BASE = KINDS[:4]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the number of spans of each kind, base_sha256 and spans.

    Spans are kind:start:end in code points, comma-joined. Base kinds are email, ip, card and
    phone; url and account come on top. Null and empty texts have none. Repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in slices(batches):
            found = [spans_of(t or "") for t in batch.column(1).to_pylist()]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in found]
            base = [",".join(f"{k}:{a}:{b}" for k, a, b in s if k in BASE) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(k == kind for k, *_ in s) for s in found], pa.int64()) for kind in KINDS),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    pa.array(joined, pa.string()),
                ],
                names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return narrow.mapInArrow(run, f"`{key}` {kind}, {counts}, base_sha256 string, spans string")

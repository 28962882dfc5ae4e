"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the text: at-signs, URL schemes, identifier cues, plus signs
before a digit, digits beside a dot, and pairs of digits with at most one blank or hyphen between. A local
parser expands each anchor to the left and right and validates what it finds. The parsers are deterministic
and give, for e-mail addresses, IPv4 addresses, payment cards and phone numbers, the leftmost
non-overlapping matches of these expressions, of which those that fail their test are dropped:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)         every part at most 255
    card   [0-9]([\\x20-]?[0-9])+                         12 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                    9 to 15 digits

Schemes and cues add ``url`` (scheme and host, up to a blank, quote or bracket, without closing punctuation)
and ``account`` (the identifier that follows a cue such as "iban", "account" or "user": 4 to 34 letters,
digits, dots, dashes or underscores, at least one digit among them).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
HOST = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | set("._%+-")
PHONE = DIGITS | set(" ().-")
NAME = LETTERS | DIGITS | set("._-")
STOP = frozenset(" \t\n\r\x0b\x0c\"'<>()[]{}|\\^`")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "s3://")
CUES = ("iban", "account", "acct", "ssn", "passport", "user", "username", "customer id", "member id", "licence", "license no")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """One payload letter per anchor: e-mail, ip, card, phone, url, account."""
    out = ahocorasick.Automaton()
    out.add_word("@", ("e", 1))
    for a in "0123456789":
        out.add_word("+" + a, ("p", 2))
        for b in "0123456789":
            out.add_word(f"{a}.{b}", ("i", 3))
            for gap in ("", " ", "-"):
                out.add_word(a + gap + b, ("c", 2 + len(gap)))
    for word in SCHEMES:
        out.add_word(word, ("u", len(word)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(form, ("a", len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = sign
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, sign + 1, HOST)
    if start == sign or end == sign + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, HOST)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def _chain(text: str, at: int, floor: int, gaps: str) -> tuple[int, int]:
    """The digits around position ``at`` (a digit) with single characters of ``gaps`` between, not before ``floor``."""
    start = at
    while start > floor:
        if text[start - 1] in DIGITS:
            start -= 1
        elif start - 1 > floor and text[start - 1] in gaps and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in gaps and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def _quads(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The chain of dotted numbers cut into groups of four from the left."""
    parts, at = [], start
    for part in text[start:end].split("."):
        parts.append((at, at + len(part)))
        at += len(part) + 1
    return [(parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4)]


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def _url(text: str, start: int, host: int) -> tuple[int, int] | None:
    end, n = host, len(text)
    if host == n or text[host] not in HOST:
        return None
    while end < n and text[end] not in STOP:
        end += 1
    while end > host and text[end - 1] in ".,;:!?":
        end -= 1
    return start, end


def _account(text: str, start: int, after: int) -> tuple[int, int] | None:
    if start and text[start - 1] in LETTERS:
        return None
    at = after
    while at < len(text) and at < after + 4 and text[at] in " :=#":
        at += 1
    if at == after:
        return None
    end, look = at, at  # closing punctuation does not count
    while look < len(text) and text[look] in NAME:
        look += 1
        if text[look - 1] not in "._-":
            end = look
            if end - at > 34:
                return None
    return (at, end) if end - at >= 4 and any(c in DIGITS for c in text[at:end]) else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed; ends are exclusive."""
    found = []
    past_email = past_chain = past_dots = past_url = past_account = 0
    for last, (anchor, size) in _automaton().iter(text):
        first = last + 1 - size
        if anchor == "c":
            if first >= past_chain:
                start, end = _chain(text, first, past_chain, " -")
                past_chain = end
                digits = text[start:end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((start, end, "card"))
        elif anchor == "i":
            if first >= past_dots:
                start, end = _chain(text, first, past_dots, ".")
                past_dots = end
                found += [(a, b, "ip") for a, b in _quads(text, start, end) if all(len(q) < 4 and int(q or "0") <= 255 for p in text[a:b].split(".") for q in [p.lstrip("0")])]
        elif anchor == "e":
            if (hit := _email(text, first, past_email)) is not None:
                past_email = hit[1]
                found.append((*hit, "email"))
        elif anchor == "p":
            if (hit := _phone(text, first)) is not None and 9 <= sum(c in DIGITS for c in text[hit[0] : hit[1]]) <= 15:
                found.append((*hit, "phone"))
        elif anchor == "u":
            if first >= past_url and (hit := _url(text, first, last + 1)) is not None:
                past_url = hit[1]
                found.append((*hit, "url"))
        elif first >= past_account and (hit := _account(text, first, last + 1)) is not None:
            past_account = hit[1]
            found.append((*hit, "account"))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    ``spans`` is kind:start:end of all spans, comma-joined; ``base_sha256`` is the digest of the same string
    of the four base kinds. A null text is empty and has no spans; rows are independent of each other, so
    repeated rows and null ids each get their own. Other columns are ignored; an empty table gives no rows. A text of any
    length is worked on whole in one task, in time proportional to its length.
    """

    def run(batches):
        for batch in X.chunks(batches):
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for text in batch.column("text").to_pylist():
                found = find_spans(text) if text else []
                kinds = [k for _, _, k in found]
                for k in BASE:
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found if k in BASE).encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

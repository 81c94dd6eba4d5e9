"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers grow and check them.

Anchors are at-signs (email), plus signs (phone), digit-dot-digit (IPv4), adjacent or singly
separated digit pairs (card), URL schemes, and cue words for accounts and secrets. Each parser
grows its anchor to the span's boundaries, linear in the text, and validates it. Per kind, spans
are leftmost and don't overlap; a failing match is dropped without a retry.

Base kinds: email, ip, card, phone. Added kinds: url, account (cue word, then an identifier with
six digits or more), secret (cue word, separator, value of six characters or more).

Defined cases: null is an empty text, with no spans; offsets are code points, end exclusive;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import in_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_REST = re.compile(r"\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`]+")
_ACCOUNT = re.compile(r"(?:[\x20\t]*(?:[:=#]|no\.?|number|nr\.?))*[\x20\t]*([A-Za-z]{0,2}[0-9](?:[\x20-]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"',;<>]{6,})")
#: Cue words and schemes that anchor the added kinds.
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")


def _left(text: str, at: int, floor: int, allowed: frozenset[str]) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    start = _left(text, at, floor, _LOCAL)
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return m and ((start, m.end()), True)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _ip(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    start = _left(text, at + 1, floor, _DIGITS)
    m = _IP_REST.match(text, at + 1) if start <= at else None
    return m and ((start, m.end()), all(map(_octet, (text[start : at + 1], *m.groups()))))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    m = _CARD.match(text, at)
    if not m:
        return None
    ok = m.end() - at <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits)
    return m.span(), ok


def _phone(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    m = _PHONE.match(text, at)
    return m and (m.span(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)


def _url(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    m = _URL_REST.match(text, at)
    if not m:
        return None
    url = m[0].rstrip(".,;:!?)]}")
    host = url.partition("://")[2]
    return (at, at + len(url)), bool(host) and host[0].isalnum()


def _account(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    m = _ACCOUNT.match(text, at)
    return m and (m.span(1), sum(c in _DIGITS for c in m[1]) >= 6)


def _secret(text: str, at: int, floor: int) -> tuple[Span, bool] | None:
    m = _SECRET.match(text, at)
    return m and (m.span(1), True)


_PARSERS: dict[str, Callable[[str, int, int], tuple[Span, bool] | None]] = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account, "secret": _secret,
}


@lru_cache(maxsize=1)
def _anchors():
    """Automaton whose hits carry (kind, pattern length, whether the parser starts behind the pattern)."""
    import ahocorasick

    uses: dict[str, list[tuple[str, int]]] = {"@": [("email", 1)], "+": [("phone", 1)]}
    for a in "0123456789":
        for b in "0123456789":
            uses.setdefault(f"{a}.{b}", []).append(("ip", 3))
            for gap in ("", " ", "-"):
                uses.setdefault(f"{a}{gap}{b}", []).append(("card", 2 + len(gap)))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                uses.setdefault(form, []).append((kind, len(form) if kind == "url" else 0))
    automaton = ahocorasick.Automaton()
    for pattern, found in uses.items():
        automaton.add_word(pattern, found)
    automaton.make_automaton()
    return automaton


def spans_of(text: str | None) -> dict[str, list[Span]]:
    """Spans by kind, each list in order of start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    floor = dict.fromkeys(KINDS, 0)
    for last, found in _anchors().iter(text):
        for kind, back in found:
            at = last + 1 - back
            if at < floor[kind]:
                continue
            hit = _PARSERS[kind](text, at, floor[kind])
            if hit and hit[0][0] >= floor[kind]:
                floor[kind] = hit[0][1]
                if hit[1]:
                    out[kind].append(hit[0])
    return out


def spans_text(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per document."""
    schema = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string".format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t) for t in batch.column(1).to_pylist()]
            columns = [[len(s[k]) for s in found] for k in BASE_KINDS]
            base = [hashlib.sha256(spans_text(s, BASE_KINDS).encode()).hexdigest() for s in found]
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(base, pa.string()), pa.array([spans_text(s, KINDS) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str | None) -> str | None:
    """``text`` with each run of overlapping spans replaced by its first kind in brackets."""
    spans = sorted((a, b, k) for k, found in spans_of(text).items() for a, b in found)
    if not spans:
        return text
    out, end, last = [], 0, 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[end:a], f"[{kind.upper()}]"]
        last = end = max(last, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by kind markers; ``n_chars``, where present, follows."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at).to_pylist()
            new = [redacted(t) for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                counts = [c if a is b else len(b) for a, b, c in zip(old, new, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
            yield batch

    return in_batches(docs).mapInArrow(run, schema)

"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release

#: In the order in which spans of one start are listed. The first four are the base kinds; the others only add spans.
KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "us_ssn")
BASE_KINDS = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]")

#: Score of a confirmed span without any context word, by kind; a base span is kept whatever its score.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "national_phone": 0.35, "us_ssn": 0.35}
#: Words that speak for a kind, or against one, within NEAR characters before or AFTER behind it.
FOR = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact"),
    "us_ssn": ("ssn", "social security", "social-security"),
}
AGAINST = {"ip": ("version", "release", "v."), "card": ("isbn", "order", "serial", "tracking"), "phone": ("isbn", "version"), "national_phone": ("isbn", "serial", "order"), "us_ssn": ("serial", "part no", "order")}
NEAR, AFTER, STEP, LEAST = 48, 16, 0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN, blanks removed, leaves 1."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} \0 {text[end : end + AFTER]}".lower()
    score = PRIOR[kind]
    if any(re.search(rf"\b{re.escape(w)}", around) for w in FOR[kind]):
        score += STEP
    if any(re.search(rf"\b{re.escape(w)}", around) for w in AGAINST.get(kind, ())):
        score -= STEP
    return round(min(1.0, max(0.0, score)), 3)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @: a local part holds none, so no character is walked twice."""
    at = text.find("@")
    free = 0
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers: of a longer run of them each four in turn."""
    for m in _DOTTED.finditer(text):
        if (parts := m.group().split("."))[3:]:
            at = m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                end = at + sum(map(len, own)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                    yield at, end
                at = end + 1


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text in code points, end exclusive, by start, then kind as in KINDS."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    found += [("email", *x) for x in _emails(text)]
    if "." in text:
        found += [("ip", *x) for x in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    base = list(found)
    # ends[i]: how far the base spans reach that are among the first i + 1
    starts = sorted(s for _, s, _ in base)
    ends = list(accumulate((e for _, _, e in sorted(base, key=lambda x: x[1])), max))
    more: list[tuple[str, int, int]] = []
    for kind, pattern in (("iban", _IBAN), ("national_phone", _NATIONAL), ("us_ssn", _SSN)):
        for m in pattern.finditer(text):
            if kind == "iban" and not mod97(m.group().replace(" ", "")):
                continue
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                more.append((kind, *m.span()))
    spans = [(k, s, e, _score(k, text, s, e)) for k, s, e in [*base, *more]]
    spans = [x for x in spans if x[0] in BASE_KINDS or x[3] >= LEAST]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with <KIND> in place of each span; of spans that overlap the union is replaced, named by the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def annotate(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", clean_col: str | None = "pii_clean_text") -> DataFrame:
    """docs with spans_col array<struct<kind, start, end, score>> and, unless it is None, clean_col, the text with spans replaced by <KIND>.

    Rows and other columns stay; columns with these two names are replaced. Null texts have no
    spans and stay null. Spans are code points, end exclusive; a long text is searched whole.
    Base kinds (email, ip, card, phone) are leftmost matches that pass their checks; iban,
    national_phone and us_ssn are only added where they overlap no base span and score LEAST or more.
    """
    rest = [c for c in docs.columns if c not in (spans_col, clean_col)]
    own = docs.select(*rest)
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema)
    at, added = rest.index(text_col), [clean_col] if clean_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [find_spans(t) for t in texts]
            spans = pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in f] for f in found], pa.list_(_SPAN))
            clean = [pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string())] if clean_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, *clean], [*rest, spans_col, *added])
        release()

    return own.mapInArrow(run, f"{kinds}, `{spans_col}` array<struct<kind string, start long, end long, score double>>" + (f", `{clean_col}` string" if clean_col else ""))


def span_list(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

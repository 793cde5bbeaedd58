"""Operator 1: personal data. Patterns propose spans, checksums confirm them, context moves scores.

Every kind has a prior score; a passed checksum (Luhn, mod-97) and a telling word shortly before
the span add to it (``CONTEXT``); secrets of a known form need neither. Spans of the base kinds (email, ip, card, phone) that pass their own test are
always kept. The other kinds are kept at ``threshold`` or more, so for most of them a checksum or
a context word has to agree with the pattern.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows give
repeated rows; other columns are ignored. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "account", "national_id", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

#: Score of a bare pattern match, what a checksum adds, what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "account": 0.2, "national_id": 0.4, "secret": 0.4}
#: Score of a secret that shows by its form.
FORM_PRIOR = 0.8
CHECKSUM_BONUS = 0.4
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
THRESHOLD = 0.7
CONTEXT = {
    "email": re.compile(r"mail|contact|write|schreib|écri|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adress", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llam", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "account": re.compile(r"card|visa|amex|account|konto|compte|cuenta", re.I),
    "national_id": re.compile(r"ssn|social security|national id|tax id", re.I),
    "secret": re.compile(r"token|secret|passw|api.?key|bearer", re.I),
}

_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
#: Characters of an account number by country. Fixed by the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SECRET_WORDS = ("token", "secret", "passw", "api_key", "apikey", "api-key", "api key", "bearer")
_SECRET = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|bearer)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?([A-Za-z0-9_+/.-]{16,})", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9_+/.=-])[A-Za-z0-9_+/-]{20,}+=*+")
#: Secrets that show by their own form, each with a string that stands in it.
_FORMS = tuple((word, re.compile(pattern)) for word, pattern in (
    ("AKIA", r"\bAKIA[0-9A-Z]{16}\b"), ("ASIA", r"\bASIA[0-9A-Z]{16}\b"), ("gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"), ("github_pat_", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("xox", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"), ("AIza", r"\bAIza[0-9A-Za-z_-]{35}"), ("_live_", r"\b[rs]k_live_[0-9A-Za-z]{16,}\b"), ("glpat-", r"\bglpat-[0-9A-Za-z_-]{20,}"),
))


_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11,}+)\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_SIGNED_HEAD = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}")
_KEY_BEGIN, _KEY_END = (re.compile(rf"-----{word} (?:[A-Z]{{1,20}} ){{0,3}}PRIVATE KEY-----") for word in ("BEGIN", "END"))
_NO_KEY = re.compile(r"[^A-Za-z0-9+/=\s:,-]")


def _signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens of three parts, of any length: a run of token characters in which the first part begins, and two more."""
    at = 0
    while match := _SIGNED.search(text, at):
        head = _SIGNED_HEAD.search(match[1])
        if head:
            yield match.start() + head.start(), match.end()
        at = match.end() if head else match.end(1) + 1


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Private keys of any length, from each beginning to the first end after it; ends and foreign characters are looked for once."""
    end, bad, done, length = None, -1, 0, len(text)
    for begin in _KEY_BEGIN.finditer(text):
        if begin.start() < done:
            continue
        if end is None or end.start() < begin.end():
            end = _KEY_END.search(text, begin.end())
            if end is None:
                return
        if bad < begin.end():
            foreign = _NO_KEY.search(text, begin.end())
            bad = foreign.start() if foreign else length
        if bad >= end.start():
            yield begin.start(), end.end()
            done = end.end()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (digit * 2 - 9 if digit > 4 else digit * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: the local part cannot hold an @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            yield start, floor
        at = text.find("@", floor)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length that pass mod-97; a failed place is tried again from the next one on."""
    at = 0
    while match := _IBAN.search(text, at):
        start, at = match.start(), match.start() + 1
        wanted, seen = IBAN_LENGTHS.get(match[0][:2], 0), 0
        for n, c in enumerate(match[0]):
            seen += c not in " -"
            if seen == wanted:
                end = start + n + 1
                after = text[end : end + 1]
                if not (after.isalnum() and after.isascii()) and mod97(match[0][: n + 1].replace(" ", "").replace("-", "")):
                    yield start, end
                    at = end
                break


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text as (kind, start, end, score, base), by kind as listed, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[str, int, int, float, bool]]] = {kind: [] for kind in KINDS}

    def add(kind: str, start: int, end: int, checked: bool, base: bool, prior: float | None = None) -> None:
        context = bool(CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start))
        score = min(1.0, (PRIOR[kind] if prior is None else prior) + CHECKSUM_BONUS * checked + CONTEXT_BONUS * context)
        if base or score >= threshold:
            found[kind].append((kind, start, end, round(score, 2), base))

    for start, end in _emails(text):
        add("email", start, end, False, True)
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            add("ip", *match.span(), True, True)
    for match in _DIGIT_RUN.finditer(text):
        length = match.end() - match.start()
        if length < 11:
            continue
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            if luhn(digits):
                add("card", *match.span(), True, True)
        elif 12 <= len(digits) <= 15:
            if luhn(digits):
                add("account", *match.span(), True, False)
        elif length == 11 and _NATIONAL_ID.fullmatch(match[0]):
            add("national_id", *match.span(), False, False)
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in match[0]) <= 15:
                add("phone", *match.span(), False, True)
    for start, end in _ibans(text):
        add("iban", start, end, True, False)
    secrets = [(*m.span(), FORM_PRIOR) for word, form in _FORMS if word in text for m in form.finditer(text)]
    secrets += [(*span, FORM_PRIOR) for word, scan in (("eyJ", _signed_tokens), ("PRIVATE KEY-----", _private_keys)) if word in text for span in scan(text)]
    lowered = text.lower()
    if any(word in lowered for word in _SECRET_WORDS):
        values = [(m.span(1), m[1]) for m in _SECRET.finditer(text)] + [(m.span(), m[0]) for m in _LONG.finditer(text)]
        secrets += [(*span, PRIOR["secret"]) for span, value in values if any(map(str.isdigit, value)) and any(map(str.isalpha, value))]
    done = 0
    for start, end, prior in sorted(secrets, key=lambda s: (s[0], -s[1], -s[2])):
        if start >= done:
            add("secret", start, end, False, False, prior=prior)
            done = end if found["secret"] and found["secret"][-1][1] == start else done
    return [span for kind in KINDS for span in found[kind]]


def redact_text(text: str, spans: Iterable[tuple[str, int, int, float, bool]]) -> str:
    """Replaces each span by its kind in brackets; overlapping spans become one replacement."""
    out, done = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= done:
            out += (text[done:start], f"[{kind.upper()}]")
        done = max(done, end)
    return "".join(out) + text[done:]


def find_pii(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row the id and ``spans``, an array of (kind, start, end, score, base) in code points."""
    prepare(df.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score", "base")
        for batch in batches:
            spans = [[dict(zip(names, s, strict=True)) for s in find_spans(text, threshold)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=[id_column, "spans"])

    rows = df.select(id_column, F.col(text_column).alias("__text"))
    return rows.mapInArrow(scan, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, spans {SPAN_TYPE}")


def redact(df: DataFrame, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with every found span replaced; a null text stays null."""
    prepare(df.sparkSession)
    place = df.columns.index(text_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact_text(t, find_spans(t, threshold)) for t in batch.column(place).to_pylist()]
            columns = batch.columns
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(scan, df.schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``find_pii``."""

    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"

    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        id_column,
        *counts,
        F.expr(f"sha2({joined('filter(spans, s -> s.base)')}, 256)").alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
        F.expr("array_join(transform(spans, s -> cast(s.score as string)), ',')").alias("scores"),
    )

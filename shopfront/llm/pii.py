"""Personal data: base patterns, and further spans that boosted trees pick among candidates.

Base kinds are exact: e-mail addresses, IP addresses, payment cards and phone numbers by pattern and
check. Beyond them, generators of high recall propose overlapping spans of looser form; trees over
format and context give each a calibrated probability, and those above the threshold that touch no
base span are added, the likeliest first.

The trees learn, from a bounded sample, from candidates that can come out, as they touch no base span:
those whose form or context says what they are, and base spans masked so that no base pattern finds
them, against the other candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm import boosting
from shopfront.llm.common import by_batch, by_row, documents, let_go, position, slices

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "number", "secret", "spelled")
ORDER = {kind: at for at, kind in enumerate(KINDS + ADDED)}
#: The sample the trees learn from, and the share of added spans that must be right on its held part.
SAMPLE_DOCS, SAMPLE_SPANS, PRECISION = 4000, 20_000, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the plain pattern finds them: a match starts at the first local character before ``@`` that
    no earlier match has used. Every character is looked at a few times at most."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            used = found.end()
            yield "email", start, used
        else:
            used = max(used, at + 1)
        at = text.find("@", used)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                    found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# --- candidates ---------------------------------------------------------------------------
_NUMBER = re.compile(r"(?<![\w+(.])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9])++")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
_SPELLED = re.compile(
    r"(?i)(?<![\w.+-])[\w.+-]++\s?(?:\(at\)|\[at\]|\bat\b)\s?[\w-]++(?:\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[\w-]++)+"
)
_SPELLED_HINT = re.compile(r"(?i)[\[( ]dot[\]) ]")
#: Words before a span that tell what it may be; fixed values.
CONTEXT = (
    re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|dial)\W{0,3}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|debit|account|iban|bank)\W{0,3}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:ssn|social security|passport|licen[cs]e|national id|tax id)\W{0,3}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api.?key|access.?key|private.?key|bearer)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$"),
    re.compile(r"(?i)(?:email|e-mail|mail|contact|write)\W{0,3}(?:\w+\W{1,3}){0,2}$"),
)
_ASSIGNED = CONTEXT[3]
_AT = re.compile(r"(?i)\s?(?:\(at\)|\[at\]|\bat\b)\s?")
_DOT = re.compile(r"(?i)\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?")
_ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev example test".split())


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping as they come."""
    found = []
    if _DIGIT.search(text):
        for kind, pattern in (("iban", _IBAN), ("number", _NUMBER), ("secret", _SECRET)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
        found = [s for s in found if s[0] != "number" or sum(c.isdigit() for c in text[s[1] : s[2]]) >= 7]
    if _SPELLED_HINT.search(text):
        found += [("spelled", *m.span()) for m in _SPELLED.finditer(text)]
    return found


def iban(value: str) -> bool:
    """Whether the check digits are right: the first four characters at the end, letters as 10 to 35."""
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def resolves(value: str) -> bool:
    """Whether a spelled address ends in a domain: a common ending, or in brackets any of two letters."""
    ending = _DOT.split(_AT.split(value)[-1])[-1].lower()
    return ending in _ENDINGS or (value[-len(ending) - 2 :].strip()[:1] in (")", "]") and len(ending) == 2 and ending.isalpha())


def checked(text: str, span: Span) -> bool:
    """Whether the form alone tells that an IBAN or a spelled address is one."""
    kind, start, end = span
    return (kind == "iban" and iban(text[start:end])) or (kind == "spelled" and resolves(text[start:end]))


def told(text: str, span: Span) -> bool:
    """Whether form or context says that a candidate is personal data."""
    before = text[max(0, span[1] - 40) : span[1]]
    if span[0] == "number":
        return CONTEXT[0].search(before) is not None or CONTEXT[2].search(before) is not None
    return checked(text, span) or (span[0] == "secret" and _ASSIGNED.search(before) is not None)


def masked(text: str, base: list[Span]) -> Iterator[tuple[str, Span]]:
    """Base spans in a form that no base pattern finds, with the text around them: phones without plus,
    cards cut by dots, addresses spelled out."""
    for kind, start, end in base:
        value = text[start:end]
        if kind == "phone":
            value = value[1:]
        elif kind == "card":
            value = ".".join(re.findall("[0-9]{1,4}", _NO_DIGIT.sub("", value)))
        elif kind == "email":
            user, domain = value.split("@")
            value = f"{user} (at) {domain.replace('.', ' (dot) ')}"
        else:
            continue
        left = text[max(0, start - 60) : start]
        around = left + value + text[end : end + 60]
        place = ("", len(left), len(left) + len(value))
        others = base_spans(around)
        for span in candidates(around):
            if span[1] <= place[1] + 1 and span[2] >= place[2] and not any(_touches(span, b) for b in others):
                yield around, span
                break


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    kind, start, end = span
    value = text[start:end]
    digits = _NO_DIGIT.sub("", value)
    before = text[max(0, start - 40) : start]
    size = len(value)
    parts = value.split(".")
    shares = np.bincount(np.frombuffer(value.encode("utf-32-le"), "<u4") % 128, minlength=128) / size
    shares = shares[shares > 0]
    return [
        ORDER[kind], size, len(digits), len(digits) / size, sum(c.isupper() for c in value) / size,
        sum(c in "0123456789abcdefABCDEF" for c in value) / size, sum(not c.isalnum() for c in value),
        value.count("-"), value.count(" "), value.count("."), value.startswith("+"), "(" in value,
        14 <= len(digits) <= 19 and luhn(digits),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        len(set(digits)), float(-(shares * np.log2(shares)).sum()),
        before[-1:].isspace() or not before, text[end : end + 1].isspace() or end == len(text),
        *(pattern.search(before) is not None for pattern in CONTEXT), checked(text, span),
    ]


def _touches(a: Span, b: Span) -> bool:
    return a[1] < b[2] and b[1] < a[2]


def added_spans(texts: list[str], base: list[list[Span]], model: boosting.Boosted) -> list[list[Span]]:
    """For each text the candidates that pass the threshold and touch neither a base span nor a
    likelier one."""
    places, rows = [], []
    for at, text in enumerate(texts):
        for span in candidates(text):
            places.append((at, span))
            rows.append(features(text, span))
    out: list[list[Span]] = [[] for _ in texts]
    if not rows:
        return out
    sure = model.probability(np.array(rows, dtype=np.float64))
    ranked = sorted(range(len(places)), key=lambda i: (places[i][0], -sure[i], -(places[i][1][2] - places[i][1][1]), places[i][1][1], i))
    taken: set[int] = set()
    last = -1
    for i in ranked:
        at, span = places[i]
        if at != last:
            last = at
            taken = {c for s in base[at] for c in range(s[1], s[2])}
        if sure[i] >= model.threshold and taken.isdisjoint(range(span[1], span[2])):
            out[at].append(span)
            taken.update(range(span[1], span[2]))
    return out


def training_spans(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates, and of masked base spans, in at most ``SAMPLE_DOCS`` documents, those first whose ids
    have the smallest hashes, among the documents with any candidate."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        let_go()
        out = {"doc_id": [], "x": [], "y": []}
        for doc, text in zip(rows["doc_id"], rows["text"]):
            base = base_spans(text)
            free = [s for s in candidates(text) if not any(_touches(s, b) for b in base)]
            known = [(text, span, told(text, span)) for span in free]
            known += [(around, span, True) for around, span in masked(text, base)]
            for around, span, right in known:
                out["doc_id"].append(doc)
                out["x"].append(features(around, span))
                out["y"].append(int(right))
        return out

    hinted = docs.where("doc_id IS NOT NULL AND text RLIKE '[0-9@]|(?i)[ (\\\\[]dot[ )\\\\]]'").select("doc_id")
    chosen = hinted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    few = docs.join(F.broadcast(chosen.distinct()), "doc_id")  # at most SAMPLE_DOCS ids
    rows = by_batch(few, "doc_id bigint, x array<double>, y int", work).orderBy(
        F.xxhash64("doc_id"), "doc_id", "x"
    ).limit(SAMPLE_SPANS).collect()
    return np.array([r["x"] for r in rows], dtype=np.float64), np.array([r["y"] for r in rows], dtype=np.float64)


def fit(docs: DataFrame) -> boosting.Boosted:
    return boosting.fit(*training_spans(documents(docs)), precision=PRECISION)


def written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def find(docs: DataFrame, model: boosting.Boosted) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Counts and digest are of the base spans; ``spans`` has the added ones too. Offsets are code
    points, ends exclusive. A null or empty text has no spans; a null ``doc_id`` stays null;
    repeated rows come out repeated; columns other than ``doc_id`` and ``text`` are not read.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        let_go()
        base = [base_spans(text) for text in rows["text"]]
        added = added_spans(rows["text"], base, model)
        out = {"doc_id": rows["doc_id"]}
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(s[0] == kind for s in spans) for spans in base]
        out["base_sha256"] = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
        out["spans"] = [written(b + a) for b, a in zip(base, added)]
        return out

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return by_batch(documents(docs), f"doc_id bigint, {counts}, base_sha256 string, spans string", work)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, merged where they overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: boosting.Boosted) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all columns stay as they are, but
    ``n_chars``, if there is one, counts the new text where it has changed."""
    at, names = position(docs, "text"), docs.columns
    sized = names.index("n_chars") if "n_chars" in names else -1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                full = [t or "" for t in texts]
                base = [base_spans(t) for t in full]
                added = added_spans(full, base, model)
                new = [redacted(t, b + a) if b or a else o for t, o, b, a in zip(full, texts, base, added)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if sized >= 0:
                    old = columns[sized].to_pylist()
                    counts = [len(n) if n != o else c for n, o, c in zip(new, texts, old)]
                    columns[sized] = pa.array(counts, part.schema.field(sized).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return by_row(docs, walk)

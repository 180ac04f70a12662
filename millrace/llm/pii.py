"""Personal data by anchor expansion.

One Aho-Corasick pass finds cues: at-signs, plus signs, digits, URL schemes and words that announce an account or
identity number. From each cue a local deterministic parser grows left and right, checks the boundaries and
validates. A parser looks at the run of characters around its cue only once, so texts of any length take linear
time.

Kinds of the base rules: email, ip, card, phone; each leftmost and non-overlapping within its kind, matches that
fail a check dropped without a retry. Added by the cues: url (a scheme and host, or mailto), iban (mod-97
checked) and account (digits after a word such as "account" or "ssn").

Defined cases: a null text is empty; an empty table gives an empty result; spans of different kinds may overlap.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
#: Cue words of the added kinds (fixed values).
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport")

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_URL = re.compile(r"[A-Za-z0-9\[][^\s<>\"'{}|\\^`]*+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country (fixed values).
IBAN_LENGTHS = {
    country: int(size)
    for country, size in (
        x.split(":")
        for x in (
            "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 "
            "GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 "
            "NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
        ).split()
    )
}
_GAP = re.compile(r"[^A-Za-z0-9]{0,3}")
_NUMBER = re.compile(r"[ \t]*+(?:number|no\.?|nr\.?)?+[ \t]*+[:#=]?+[ \t]*+([0-9](?:[ -]?[0-9]){5,18})(?![0-9])", re.IGNORECASE)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """Where an IBAN that starts at ``at`` ends by its country's length, single spaces let pass; None if there is none."""
    m = _IBAN.match(text, at)
    if m is None:
        return None
    left, end = IBAN_LENGTHS.get(m[0][:2]), at
    if left is None:
        end = m.end()
    while left:
        if end >= m.end():
            return None
        left -= text[end] != " "
        end += 1
    if end < len(text) and text[end].isascii() and text[end].isalnum():
        return None
    return end if mod97(text[at:end].replace(" ", "")) else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue in ("@", "+", *SCHEMES, *CUES, *sorted(_DIGITS)):
        found.add_word(cue, cue)
    found.make_automaton()
    return found


_AUTOMATON: ahocorasick.Automaton | None = None


def parse(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind in the order of BASE and ADDED."""
    global _AUTOMATON
    if not text:
        return []
    if _AUTOMATON is None:
        _AUTOMATON = automaton()
    spans: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = mail_end = 0
    lowered = text.lower()
    folded = lowered if len(lowered) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)
    for last, cue in _AUTOMATON.iter(folded):
        if cue in _DIGITS:
            if last and text[last - 1] in _DIGITS:
                continue  # the run's first digit has been its anchor
            if last >= ip_end and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                    spans.append(("ip", last, ip_end))
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = digits_of(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", last, card_end))
        elif cue == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif cue == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                end = m.end()
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - last >= 4:  # a digit, then one character or more, then a digit
                    phone_end = end
                    if 9 <= len(digits_of(text[last:end])) <= 15:
                        spans.append(("phone", last, end))
        elif cue in SCHEMES:
            start = last + 1 - len(cue)
            if start >= max(url_end, mail_end * (cue == "mailto:")) and (m := _URL.match(text, last + 1)):
                end = m.end()
                if cue == "mailto:":
                    mail_end = end  # a run without an at-sign after its first mailto has none after a later one
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                if cue != "mailto:" or "@" in text[last + 1 : end]:
                    url_end = end
                    spans.append(("url", start, end))
        elif cue == "iban":
            if m := _GAP.match(text, last + 1):
                if end := iban_end(text, m.end()):
                    spans.append(("iban", m.end(), end))
        elif m := _NUMBER.match(text, last + 1):
            spans.append(("account", m.start(1), m.end(1)))
    place = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each stretch of overlapping spans replaced by the kind of its first span, as <EMAIL>."""
    if not text or not spans:
        return text
    out, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end), redacted text) of every row."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [parse(t) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())], ["doc_id", "spans", "redacted"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>, redacted string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_chars``, if there, counted again."""
    prepare(docs.sparkSession)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, parse(t)) for t in batch.column("text").to_pylist()]
            columns = [pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(each, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the rendered spans of every row."""
    listed = F.col("spans")
    base = F.filter(listed, lambda s: s["kind"].isin(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.filter(listed, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return find(docs).select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(listed).alias("spans"))

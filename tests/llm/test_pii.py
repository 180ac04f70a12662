"""Op 4 against the plain patterns, leftmost and without retries."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii
from tests.llm.helpers import clashing, docs, odd_docs


def slow_luhn(text):
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def plain(text):
    out = []
    n = lambda s: sum(c in "0123456789" for c in s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= n(m[0]) <= 19 and slow_luhn(m[0]) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= n(m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [s for s in pii.parse(text) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1209@.+-() %é\n", max_size=60))
def test_like_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "1.2.3.4", "4539578763621486", "+1 (234) 555-7890", "300.1.1.1", "@", "+", ".", " ", "-", "x", "0", "İ", "@d.e-f"]), max_size=9).map("".join))
def test_like_the_patterns_from_pieces(text):
    assert base(text) == plain(text)


def test_added_kinds():
    text = "See https://a.example/x?y=1. Mail mailto:a@b.co now. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678"
    kinds = {k: text[a:b] for k, a, b in pii.parse(text)}
    assert kinds["url"] == "mailto:a@b.co" and kinds["email"] == "a@b.co"
    assert text[pii.parse(text)[0][1] : pii.parse(text)[0][2]] == "https://a.example/x?y=1"
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["account"] == "12345678"
    assert all(k != "iban" for k, *_ in pii.parse("IBAN: DE88 3704 0044 0532 0130 00"))


def test_redaction():
    text = "write to a@b.co or +1 234 555 7890!"
    assert pii.redact(text, pii.parse(text)) == "write to <EMAIL> or <PHONE>!"
    assert pii.redact(None, []) is None and pii.redact("x", []) == "x"


def test_digest(spark):
    texts = ["a@b.c 1.2.3.4", None, "😀 a@b.c", "+12345678901"]
    got = {r.doc_id: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in plain(t or "")) for k in pii.BASE)
    assert got[2].spans == "email:2:7"


def test_odd_and_empty(spark):
    odd = clashing(odd_docs(spark))
    assert pii.digest(odd).count() == odd.count()
    assert pii.digest(odd.limit(0)).count() == 0
    clean = pii.redact_documents(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r.doc_id: r.n_chars for r in clean.collect()}[6] == 360_000
    for text in ("1" * 200_000, "@" * 200_000, "a@" * 100_000, "+1" * 100_000, "1.2." * 50_000, "a." * 100_000 + "@"):
        assert base(text) is not None  # in linear time


def test_long_runs():
    zeros = "0" * 6000
    assert base(f"{zeros}1.2.3.4 {zeros}.0.0.{zeros}") == [("ip", 0, 6007), ("ip", 6008, 6008 + 2 * 6000 + 5)]
    assert pii.parse("account" + " " * 100_000 + "x") == []
    assert pii.parse("mailto:" * 30_000 + "x") == []


def test_iban_by_the_length_of_its_country():
    for text, found in [
        ("IBAN DE89 3704 0044 0532 0130 00 AND more", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: DE89 3704 0044 0532 0130 00 12 units", "DE89 3704 0044 0532 0130 00"),
        ("iban GB82WEST12345698765432, thanks", "GB82WEST12345698765432"),
        ("IBAN DE89 3704 0044 0532 0130 01", None),
        ("IBAN DE89 3704 0044 0532 0130", None),
        ("IBAN GB82WEST123456987654321", None),
    ]:
        assert [text[a:b] for k, a, b in pii.parse(text) if k == "iban"] == ([found] if found else [])

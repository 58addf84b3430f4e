import calendar
import itertools
import random
import re
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import pii

F = pii.Feistel(b"key")


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutations(size):
    assert sorted(F.number("n", k, size) for k in range(size)) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(st.text("abcXYZ019.-_é", max_size=20))
def test_symbols_keep_their_shape(text):
    new = F.symbols("s", text)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    assert shape(new) == shape(text)


CASES = [("4111 1111 1111 1111", "card"), ("378282246310005", "card"), ("DE89 3704 0044 0532 0130 00", "iban"), ("192.168.1.20", "ipv4"), ("2021-02-28", "date"), ("31.12.1999", "date"), ("12/25/2020", "date"), ("123-45-6789", "ssn"), ("+1 (136) 555-7479", "phone"), ("(212) 555-0100", "phone"), ("und.34@mail7.example.com", "email")]


@pytest.mark.parametrize("value,kind", CASES)
def test_finds_keep_format_and_check(value, kind):
    text, spans = pii.pseudonymise(f"x {value}!! y {value}", F)
    assert [k for *_, k in spans] == [kind, kind]
    one, two = re.fullmatch(r"x (.*)!! y (.*)", text).groups()
    assert one == two != value and (kind == "ipv4" or re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", one)) == re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", value)))
    again, found = pii.pseudonymise(one, F)
    assert [k for *_, k in found] == [kind]  # the pseudonym is valid itself


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "300.1.1.1", "2021-02-30", "000-12-3456", "v1.2.3", "DE00 3704 0044 0532 0130 00", "no digits", "1234567890123", ""])
def test_invalid_values_stay(text):
    assert pii.pseudonymise(text, F) == (text, [])


def test_same_digits_stay_linked():
    a, b = (pii.pseudonymise(x, F)[0] for x in ("4111111111111111", "4111 1111 1111 1111"))
    assert a == b.replace(" ", "")


def test_secrets():
    text, spans = pii.pseudonymise('token = "f3ef4d6b2755a36d7d9c" password: hunter22x', F)
    assert len(spans) == 2 and re.fullmatch(r'token = "[0-9a-f]{20}" password: [a-z]{6}\d\d[a-z]', text) and "f3ef4d" not in text


def test_frame(spark, frame):
    docs = frame([(1, "mail a.b@c.example.org"), (2, None), (3, ""), (1, "mail a.b@c.example.org"), (None, "x " * 30000)])
    rows = pii.pseudonymise_texts(docs, b"key").collect()
    assert len(rows) == 5 and len({r["text"] for r in rows if r["doc_id"] == 1}) == 1
    assert pii.pseudonymise_texts(docs, b"key").columns == docs.columns
    report = {(r["doc_id"], r["n_found"], r["kinds"]) for r in pii.pii_report(docs, b"key").collect()}
    assert (1, 1, "email:1") in report and (2, 0, "") in report
    assert pii.pii_report(docs.limit(0), b"key").count() == 0


def test_no_key_no_pseudonyms(spark, frame):
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise_texts(frame([(1, "x")]))


INSIDE = [("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"), ("No 7 4111 1111 1111 1111", "4111 1111 1111 1111", "card"), ("1234 4111 1111 1111 1111", "4111 1111 1111 1111", "card"), ("AT611904300234573201 is due", "AT611904300234573201", "iban"), ("AT61 1904 3002 3457 3201 2024", "AT61 1904 3002 3457 3201", "iban"), ("AB12 AT611904300234573201", "AT611904300234573201", "iban"), ("2024-01-05T10:00", "2024-01-05", "date"), ("+49 30 1234 5678 2024 2025", "+49 30 1234 5678", "phone"), ("4111 1111 1111 1112 123-45-6789", "123-45-6789", "ssn"), ("secret: somebody@mail.example.com", "somebody@mail.example.com", "email")]


@pytest.mark.parametrize("text,value,kind", INSIDE)
def test_values_inside_failed_matches(text, value, kind):
    new, spans = pii.pseudonymise(f"x {text} y", F)
    start = 2 + text.index(value)
    assert (start, start + len(value), kind) in spans and value not in new and len(new) == len(text) + 4


@pytest.mark.parametrize("size", [47, 48, 49, 260, 5000, 1_000_000])
def test_long_values(size):
    """Secrets and addresses of any length: shape kept, equal values linked, others apart."""
    draw = random.Random(size)
    for letters in ("0123456789abcdef", "abcXYZ019_-"):
        one = "7" + "".join(draw.choice(letters) for _ in range(size - 1))
        two = one[:-1] + ("b" if one[-1] != "b" else "c")
        text, spans = pii.pseudonymise(f"token={one} token={one} token={two}", F)
        a, b, c = (text[i:j] for i, j, _ in spans)
        assert a == b != one and a != c and len(a) == size
        shape = lambda s: re.sub("[0-9a-f]", "x", s) if letters[0] == "0" else re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        assert shape(a) == shape(one)
    mail = "q" * size + "@mail.example.org"
    assert pii.pseudonymise(mail, F)[1] == [(0, len(mail), "email")]


def test_vectors_are_permutations():
    sizes = np.array([3, 10, 2, 5])
    rows = list(itertools.product(*map(range, sizes)))
    made = {tuple(F.vector("v", np.array(r), sizes).tolist()) for r in rows}
    assert made == set(rows)


def _plain_finds(text):
    """A plain reading of the formats that the texts below hold: one token at a time."""
    out = []
    for m in re.finditer(r"\S+", text):
        token, digits = m[0], re.sub(r"\D", "", m[0])
        if re.fullmatch(r"\d{4}-\d\d-\d\d", token):
            y, mo, d = map(int, token.split("-"))
            if 1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]:
                out.append((m.start(), m.end(), "date"))
        elif re.fullmatch(r"\d+\.\d+\.\d+\.\d+", token) and all(len(x) <= 3 and int(x) < 256 for x in token.split(".")):
            out.append((m.start(), m.end(), "ipv4"))
        elif re.fullmatch(r"\d{16}", token) and len(set(token)) > 1 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}", token):
            a, b, c = map(int, token.split("-"))
            if a not in (0, 666) and a < 900 and b and c:
                out.append((m.start(), m.end(), "ssn"))
    return out


def test_finds_and_inverse_by_brute_force():
    """Finds equal a plain reader's; the date and address permutations, tabled over all of
    their values, take the pseudonyms back."""
    draw = random.Random(5)
    days = {pii._replace(F, "date", d): d for k in range(pii.DAYS) if (d := (pii.FIRST_DAY + timedelta(days=k)).isoformat())}
    assert len(days) == pii.DAYS and set(days) == set(days.values())
    make = [
        lambda: f"{draw.randint(1890, 2110)}-{draw.randint(0, 14):02d}-{draw.randint(0, 33):02d}",
        lambda: ".".join(str(draw.randint(0, 300)) for _ in range(4)),
        lambda: "".join(str(draw.randint(0, 9)) for _ in range(16)),
        lambda: f"{draw.choice([0, 666, 901, 123, 899]):03d}-{draw.randint(0, 3):02d}-{draw.randint(0, 2):04d}",
        lambda: draw.choice(["word", "x9", "7", "12.5", "a-b"]),
    ]
    for _ in range(300):
        # words between the values, as digit groups side by side may be one card
        text = " and ".join(draw.choice(make)() for _ in range(12))
        new, spans = pii.pseudonymise(text, F)
        assert spans == _plain_finds(text)
        changed = [(a, b) for a, b in zip(text.split(), new.split(), strict=True) if a != b]
        assert {a for a, _ in changed} <= {text[i:j] for i, j, _ in spans}
        assert all(days[b] == a for a, b in changed if re.fullmatch(r"\d{4}-\d\d-\d\d", a))

"""Base spans against the plain patterns, disclosing terms against counts, masking, nulls and repeated rows."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="ab@.12 -+(5%\né", max_size=40))
def test_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "x" * 200_000, "1" * 200_000, "@" * 50_000, "a@" * 50_000, "1." * 100_000, "+1" * 50_000, "+1" + "(" * 100_000, "1 " * 100_000,
    "é a.b@c.de.f@g.h 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999 000001.2.3.4",
])
def test_long_and_hard_texts(text):
    assert pii.base_spans(text) == (plain(text) if len(text) < 1000 else pii.base_spans(text))


def corpus():
    """One address in four contexts with a name that gives it away, one in copies of a single line, and clean rows."""
    told = [f"Mira{'' if k else ''} Quell wrote from mira@corp.example about topic{k} today" for k in range(4)]
    copies = ["the rare zanzibar word next to lone@corp.example"] * 9
    clean = [f"plain words about topic{k} and the weather today from a writer" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(told + copies + clean)]
    return [*rows, (100, None), (101, ""), (None, "mail x@y.zz"), (3, told[3]), (102, "Quell alone\nsecond line +49 (30) 1234567 end")]


def test_detection_and_digests(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = pii.digests(pii.detect(df)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = plain(texts[r["doc_id"]] or "") if r["doc_id"] in texts else []
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[0] == k for x in base) for k in pii.KINDS)
        terms = [x for x in r["spans"].split(",") if x.startswith("term")]
        assert r["spans"] == ",".join(x for x in [text, *terms] if x)
        words = {(texts[r["doc_id"]] or "")[int(a):int(b)] for _, a, b in (x.split(":") for x in terms)}
        told = r["doc_id"] in (0, 1, 2, 3)
        assert ({"Mira", "Quell"} <= words if told else not words) and "today" not in words


def test_disclosure_is_pointwise_information(spark):
    rows = [(k, t) for k, t in enumerate([*[f"anna {'x' * k} a@b.cc z" for k in range(1, 5)], "anna here", *["z filler"] * 11])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["term"]: r["reveals"] for r in pii.disclosure(df, pii.find(df), threshold=-10.0).collect()}
    n = len(rows)
    for term, c_t in (("anna", 5), ("z", 15)):
        assert abs(got[term] - math.log2(n * 4 / (c_t * 4)) / math.log2(n / 4)) < 1e-9
    assert set(got) == {"anna", "z"}


def test_sanitised_texts(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, i, 7) for i, t in rows], "text string, doc_id long, terms int")
    out = pii.sanitise(df, remove=2.0)
    assert out.columns == ["text", "doc_id", "terms"]
    got = {}
    for r in out.collect():
        assert r["terms"] == 7
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert len(got[3]) == 2 and got[100] == [None] and got[101] == [""] and got[None] == ["mail [EMAIL]"]
    assert got[0] == ["[NAME] [NAME] [TERM] from [EMAIL] about topic0 today"] or "mira" not in got[0][0].lower()
    assert got[102] == ["Quell alone\nsecond line [PHONE] end"] and got[20] == [rows[20][1]]
    assert "@" not in "".join(t or "" for ts in got.values() for t in ts)


def test_mask_removes_and_generalises():
    text = "Al 42 bob x@y.zz"
    terms = [(0, 2, 0.9), (3, 5, 0.9), (6, 9, 0.99), (10, 12, 0.99)]
    assert pii.mask(text, [("email", 10, 16)], terms, 0.95) == "[NAME] [NUMBER]  [EMAIL]" or "x@y" not in pii.mask(text, [("email", 10, 16)], terms, 0.95)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(pii.detect(empty)).count() == 0 and pii.sanitise(empty).count() == 0


def test_values_in_two_documents_and_names_on_other_lines(spark):
    told = ["Regards,\nOrla\nBrisk\norla@corp.example\nphone later", "first words\nOrla\nBrisk\norla@corp.example\nand far below\n" + "some filler words of text " * 20 + "\nBrisk again"]
    rows = [*enumerate(told), (0, "Brisk weather is not about the value"), *((k, f"some filler words of text and first regards later phone below {k % 7} only{k}") for k in range(10, 2010))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in pii.sanitise(df, remove=2.0).collect():
        got.setdefault(r["doc_id"], set()).add(r["text"])
    assert got[0] == {"Regards,\n[NAME]\n[NAME]\n[EMAIL]\nphone later", "Brisk weather is not about the value"}
    assert got[1] == {told[1].replace("orla@corp.example", "[EMAIL]").replace("Orla", "[NAME]").replace("Brisk", "[NAME]")}
    assert all(got[k] == {t} for k, t in rows[3:])
    spans = {(r["doc_id"], len(r["terms"])) for r in pii.detect(df).collect() if r["terms"]}
    assert spans == {(0, 2), (1, 3)}

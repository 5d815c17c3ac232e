import hashlib
import random
import re

from wayfold.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def rows():
    r = random.Random(5)
    atoms = ["a@b.c", "@", ".", "..", "x_y", "1.2.3.4", "256.1.1.1", "001.002.3.4", "4041894974608795", "4041 8949 7460 8795", " ", "-", "+1 (988) 555-2485", "+12", "é", "\U0001f600", "a@b.c_d@e.f", "GB82 WEST 1234 5698 7654 32", "iban ", "tel 555-123-4567", "7", "\n", "%", "("]
    out = ["".join(r.choice(atoms) for _ in range(r.randint(0, 14))) for _ in range(400)]
    return [None, "", "1 " * 8000, "a@" + "b." * 8000 + "c", "9" * 20000, "a" * 20000, " a@b.cc 4041894974608795" * 400, *out, out[0]]


def test_base_spans_equal_brute_force(spark):
    texts = rows()
    got = pii.digest(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


def test_checksums_and_context(spark):
    cases = {"As I tell you, 123 456 7890 apples": "", "a recall 123 456 7890 of": "", "calls: 123 456 7890": "phone_local", "iban GB82 WEST 1234 5698 7654 32.": "iban", "iban GB83 WEST 1234 5698 7654 32.": "", "tel 555-123-4567": "phone_local", "order 555-123-4567": "", "ssn 078-05-1120": "national_id", "part 078-05-1120": "", "order by phone 555-123-4567": "", "ssn on invoice 078-05-1120": "", "tel 030 1234 5678": "phone_local", "Tel. 08-12 34 56 78": "phone_local", "code 030 1234 5678": "", "invoice for a@b.cc": "email", "order 4041894974608795": "card", "order GB82 WEST 1234 5698 7654 32": "iban"}
    got = pii.digest(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    for r in got:
        assert r.spans.split(":")[0] == list(cases.values())[r.doc_id], list(cases)[r.doc_id]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4!", 18, "k"), (2, None, 0, "k"), (3, "clean", 5, "k"), (4, "a@b.c_d@e.f", 11, "k")], "doc_id long, text string, n_chars long, __pii_spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert got[1].text == "é <EMAIL>, <IP>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and got[4].text == "<EMAIL><EMAIL>" and got[1]["__pii_spans"] == "k"


def test_empty_and_native(spark, no_docs, docs, capsys):
    assert pii.digest(no_docs).count() == 0 and pii.redact(no_docs).count() == 0
    pii.redact(docs).explain()
    assert "Python" not in capsys.readouterr().out


def test_an_iban_ends_where_its_number_ends(spark):
    german, british, unknown = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "ZZ14 ABCD 1234 5678 9012"
    assert int("".join(str(int(c, 36)) for c in (unknown[4:] + unknown[:4]).replace(" ", ""))) % 97 == 1
    tails = ["", " Thanks", " THANKS", " 12345", " and", ".", " X", f" {german}"]
    cases = [(x, x + t) for x in (german, british, unknown) for t in tails]
    got = pii.digest(spark.createDataFrame([(i, f"iban {t}") for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()
    for r in got:
        x, t = cases[r.doc_id]
        assert f"iban:5:{5 + len(x)}" in r.spans.split(","), t
        if t.endswith(german) and not t.startswith("ZZ"):
            assert f"iban:{5 + len(t) - len(german)}:{5 + len(t)}" in r.spans.split(","), t
    red = pii.redact(spark.createDataFrame([(1, f"iban {german} THANKS")], "doc_id long, text string")).first()
    assert red.text == "iban <IBAN> THANKS"

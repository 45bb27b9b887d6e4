"""The Java patterns against Python's own regular expressions on hostile text."""

import hashlib
import random
import re

from prosa import params as P
from prosa.operators import silver as S
from fixtures import by

PY = {
    "cpf": re.compile(r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"),
    "email": re.compile(r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", re.I),
    "cep": re.compile(r"\b\d{5}-?\d{3}\b"),
    "plate": re.compile(r"\b[A-Z]{3}\d[A-Z0-9]\d{2}\b", re.I),
    "phone": re.compile(r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}\b"),
    "competitor": re.compile(r"\b(?:" + "|".join(P.COMPETITORS) + r")\b", re.I),
}
PIECES = ["383.182.856-05", "38318285605", "08617-986", "08617986", "a@b.com", "josé+x@loja.com.br", "x.y@z-w.co1",
          "SYL8V26", "abc1d23", "(11) 98123-4012", "11981234012", "11 8123-4012", "Porto Seguro", "ITAÚ SEGUROS",
          "itaú seguros", "hdi  seguros", "HDI Seguroſ", "AZUL SEGURO", "bradesco seguros", "mapfre", "SUHAİ"]
GLUE = [" ", "", "-", ".", "_", "é", "1", "a", "@", ",", " ", "　", "٣", "́", "\n", "K", "ſ", "٣٣"]


def texts(n=3000, seed=3):
    rng = random.Random(seed)
    made = ["", "é383.182.856-05", "383.182.856-05é", "383.182.856-05 38318285605", "_08617-986", "08617-986-", "a@b.com.br"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            piece = rng.choice(PIECES)
            if rng.random() < 0.3:
                cut = rng.randrange(len(piece))
                piece = piece[:cut] + rng.choice(GLUE) + piece[cut + 1:]
            parts += [piece, rng.choice(GLUE)]
        made.append(rng.choice(GLUE) + "".join(parts))
    return made


def h16(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_same_matches_as_python(spark):
    bodies = texts()
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").repartition(8)
    rows = by(S.with_mask(S.extract(df, "body"), "body", "masked"), "i")
    for i, body in enumerate(bodies):
        found = {k: (m.group(0) if (m := p.search(body)) else None) for k, p in PY.items()}
        row = rows[i]
        assert row["extracted_cpf_hash"] == (found["cpf"] and h16(found["cpf"])), repr(body)
        assert row["extracted_email_hash"] == (found["email"] and h16(found["email"].lower())), repr(body)
        assert row["extracted_cep"] == (found["cep"] and re.sub(r"[^\d]", "", found["cep"])), repr(body)
        assert row["extracted_plate"] == (found["plate"] and found["plate"].upper()), repr(body)
        assert row["extracted_competitor"] == (found["competitor"] and found["competitor"].lower()), repr(body)
        assert row["pii_phone_found"] == bool(found["phone"]), repr(body)
        masked = body
        for kind in ("cpf", "email", "cep", "phone"):
            masked = PY[kind].sub(f"[{kind.upper()}_MASKED]", masked)
        assert row["masked"] == masked, repr(body)


def test_null_body(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "i int, body string")
    for row in S.with_mask(S.extract(df, "body"), "body", "masked").collect():
        assert row["extracted_cpf_hash"] is None and row["extracted_plate"] is None
        assert not (row["pii_cpf_found"] or row["pii_email_found"] or row["pii_cep_found"] or row["pii_phone_found"])
        assert row["masked"] == row["body"]


def test_all_matches_as_python(spark):
    bodies = texts(1500, seed=5)
    patterns = {
        "extracted_ceps": (re.compile(r"\b\d{5}-?\d{3}\b"), False, False),
        "extracted_plates": (re.compile(r"\b[A-Z]{3}\d[A-Z0-9]\d{2}\b"), True, False),
        "extracted_cpfs": (re.compile(r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"), False, True),
        "extracted_emails": (re.compile(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"), False, True),
        "extracted_phones": (re.compile(r"\b(?:\+55\s?)?\(?\d{2}\)?\s?\d{4,5}-?\d{4}\b"), False, True),
    }
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").repartition(8)
    rows = by(S.extract_all(df, "body"), "i")
    for i, body in enumerate(bodies):
        for name, (pattern, upper, hashed) in patterns.items():
            expected = set(pattern.findall(body.upper() if upper else body))
            expected = {h16(e) for e in expected} if hashed else expected
            assert set(rows[i][name]) == expected, (name, repr(body))
        assert rows[i]["extracted_competitors"] == [c for c in P.NOTEBOOK_COMPETITORS if c in body.lower()], repr(body)

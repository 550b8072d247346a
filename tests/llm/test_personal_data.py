import random
import re

import pytest
from pyspark.sql import functions as F

from consensa.llm import personal_data as p

#: The kinds as stated, without the forms that make them linear.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if holds(k, m.group())]


def found(spark, texts, **columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in columns.items()})
    return [[(s.kind, s.start, s.end) for s in r.spans] for r in p.find_personal_data(df).orderBy("doc_id").collect()]


def card(rng, n):
    s = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(s + c for c in "0123456789" if luhn(s + c))


def noise(rng):
    parts = ["@", ".", "+", "-", " ", "(", ")", "a", "é", "\U0001F600", "7", "1", "0", "x@y.z", "1.2.3.4", "256.1.1.1", "00012.0.0.255",
             "+1 (555) 123-4567", "a.b@c-d.e.f+g@h.i", "\n", "..", "@@", "1.2.3.4.5.6.7.8.9", "%_", "+49.30 (1)"]
    out = [rng.choice(parts) for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 3)):
        out.insert(rng.randint(0, len(out)), " ".join(re.findall(".{1,4}", card(rng, rng.randint(12, 20)))) if rng.random() < 0.5
                   else card(rng, rng.randint(12, 20)))
    return "".join(out)


def test_base_kinds_against_the_plain_expressions(spark):
    rng = random.Random(2)
    texts = [noise(rng) for _ in range(1500)] + [None, "", " ", "é" * 50 + "a@b.c"]
    got = found(spark, texts)
    assert [[s for s in g if s[0] in p.BASE] for g in got] == [base(t) for t in texts]
    assert sum(map(len, got)) > 1500


def iban(country, account):
    plain = account + country + "00"
    rest = int("".join(str(int(c, 36)) for c in plain)) % 97
    return f"{country}{98 - rest:02d}{account}"


def test_context_and_checksums_decide_the_other_kinds(spark):
    good = iban("DE", "370400440532013000")
    grouped = " ".join(re.findall(".{1,4}", good))
    cases = {
        f"pay to {good} now": [("iban", 7, 29)], f"pay to {grouped} NOW": [("iban", 7, 34)],
        f"pay to {good[:-1]}1 now": [], f"x{good}": [], f"{good}7": [], f"iban {good[:-1]}1": [],
        "SSN 123-45-6789.": [("ssn", 4, 15)], "part 123-45-6789.": [], "ssn 000-45-6789": [], "Social: 1123-45-6789": [],
        "(743) 555-3824": [("local_phone", 0, 14)], "743-555-3824": [], "call 743-555-3824!": [("local_phone", 5, 17)],
        "invoice (743) 555-3824": [], "+1 (743) 555-3824": [("phone", 0, 17)], "call 11 743-555-3824": [],
        "amex 3782 822463 10005": [("short_card", 5, 22)], "nr 3782 822463 10005": [], "card 3782 822463 10006": [],
        "version 1.2.3.4": [("ip", 8, 15)],
    }
    assert dict(zip(cases, found(spark, cases), strict=True)) == cases


def test_scores(spark):
    df = spark.createDataFrame([("mail a@b.c",), ("serial 1.2.3.4",), ("4111 1111 1111 1111 visa",)], "text string")
    assert [r.spans[0].score for r in p.find_personal_data(df).collect()] == [80, p.THRESHOLD, 100]


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5, "x")], "doc_id long, text string, spans int, kind string")
    out = p.find_personal_data(df)
    assert sorted(out.columns) == ["doc_id", "kind", "spans", "text"] and [s.kind for s in out.first().spans] == ["email"]
    assert p.find_personal_data(df.limit(0)).collect() == []
    twice = p.find_personal_data(df.unionAll(df)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("text, kinds", [
    ("a" * 2_000_000, {}), ("1" * 2_000_000, {}), ("1.2." * 300_000, {"ip": 150_000}), ("a@" + "b." * 400_000 + "c", {"email": 1}),
    ("+1" + "(" * 1_000_000, {}), ("a@b.c " * 60_000, {"email": 60_000}), ("+" * 1_000_000, {}), ("A1" * 500_000, {})])
def test_very_long_texts(spark, text, kinds):
    spans = p.find_personal_data(spark.createDataFrame([(text,)], "text string"))
    got = {r.kind: (r["n"], r["last"]) for r in spans.select(F.inline("spans")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("end").alias("last")).collect()}
    want = {k: [m.end() for m in re.finditer(PLAIN[k], text)] for k in kinds}
    assert got == {k: (kinds[k], want[k][-1]) for k in kinds} and all(len(want[k]) == n for k, n in kinds.items())

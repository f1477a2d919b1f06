"""Pseudonyms: what is found, that formats hold, and that the permutations are one to one."""
import datetime
import re

from pyspark.sql import functions as F

from notecoder.llm.pseudonyms import permuted, pseudonymised


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", s))):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def run(spark, texts, key="k"):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return [r.asDict() for r in pseudonymised(spark.createDataFrame(rows, "doc_id int, text string, n_card string"), key).orderBy("doc_id").collect()]


def test_each_kind_keeps_its_format(spark):
    out = run(spark, [
        "card 4111 1111 1111 1111, again 4111-1111-1111-1111.", "bad 4111111111111112 stays", "ip 10.20.30.40 and 256.1.1.1 and 1.2.3.4.5",
        "call +1 (984) 555-2485 4041894974608795", "born 1990-02-28, 28.02.1990, 2/28/1990, not 1990-02-30 or 31.04.2001", "ssn 123-45-6789 or 666-45-6789",
        "mail A.b@x-y.example.com, a.B@X-Y.EXAMPLE.com", 'token = "24be64439e3e49cf46b2d7c90f"', "Version 2.0 of 4.0. and 123", None, "", "x" * 50_000])
    card = re.findall(r"\d{4}(?:[ -]\d{4}){3}", out[0]["text"])
    assert luhn(card[0]) and re.sub(r"\D", "", card[0]) == re.sub(r"\D", "", card[1]) != "4" + "1" * 15 and out[0]["n_card"] == 2
    assert out[1]["text"] == "bad 4111111111111112 stays" and out[1]["n_replaced"] == 0
    assert out[2]["n_ip"] == 1 and "256.1.1.1 and 1.2.3.4.5" in out[2]["text"] and "10.20.30.40" not in out[2]["text"]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} \d{16}", out[3]["text"]) and (out[3]["n_phone"], out[3]["n_card"]) == (1, 1) and "555-2485" not in out[3]["text"]
    iso, dotted, us = re.match(r"born (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}), (\d+/\d\d/\d{4}), not 1990-02-30 or 31\.04\.2001", out[4]["text"]).groups()
    day = datetime.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and us == f"{day.month}/{day.day:02d}/{day.year}" and day != datetime.date(1990, 2, 28)
    assert out[5]["n_ssn"] == 1 and "666-45-6789" in out[5]["text"] and "123-45" not in out[5]["text"]
    a, b = re.findall(r"\S+@\S+\.invalid", out[6]["text"])
    assert a == b and out[6]["n_email"] == 2
    assert re.fullmatch(r'token = "[0-9a-f]{26}"', out[7]["text"]) and "24be64" not in out[7]["text"]
    assert [r["text"] for r in out[8:]] == ["Version 2.0 of 4.0. and 123", None, "", "x" * 50_000] and not any(r["n_replaced"] for r in out[8:])
    assert run(spark, ["card 4111 1111 1111 1111, again"], "other")[0]["text"] != out[0]["text"][:30]


def test_permutations_are_one_to_one(spark):
    p = permuted(F.floor(F.col("id") / 773), F.lit(189), F.col("id") % 773, F.lit(773), "k", "date")
    n = spark.range(146_097).select(p.alias("p")).select((F.col("p.a") * 773 + F.col("p.b")).alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(n) == (146_097, 0, 146_096)


def test_empty_table(spark):
    assert pseudonymised(spark.createDataFrame([], "doc_id int, text string"), "k").count() == 0


def test_cards_beside_other_numbers(spark):
    one, two = "4111111111111111", "5500000000000004"
    forms = ["{a}", "{a} 12/27", "{a} 123", "{s} 123", "123 {a}", "7 {s}", "{a} 12 27 123", "12 34 56 78 90 {s}", "{a} {b}", "{s}-{b} 99",
             "{a} 10.20.30.40", "{a} 1990-02-28", "{a} 28.02.1990", "{a} 123-45-6789", "{s} 984-555-2485", "{a} 12@x.example.com", "{a} 12ab", "1 " * 3000 + "{a}x"]
    shown = lambda f, a, b: f.format(a=a, b=b, s=" ".join(a[i:i + 4] for i in range(0, 16, 4)))
    out = run(spark, [shown(f, one, two) for f in forms] + [two])
    new, other = out[0]["text"], out[-1]["text"]
    assert luhn(new) and luhn(other) and new != one and other != two
    for f, r in list(zip(forms, out))[:10]:
        assert r["text"] == shown(f, new, other) and r["n_card"] == r["n_replaced"] == f.count("{")
    for f, r, kind in zip(forms[10:16], out[10:16], ("ip", "date", "date", "ssn", "phone", "email")):
        head = shown(f, new, other).split()
        n = 4 if "{s}" in f else 1
        assert r["text"].split()[:n] == head[:n] and r["text"].split()[n] != head[n] and (r["n_card"], r[f"n_{kind}"], r["n_replaced"]) == (1, 1, 2)
    assert out[16]["text"] == shown(forms[16], new, other) and one in out[17]["text"]

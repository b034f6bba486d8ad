import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clusterlens.llm import pii

KEY = "k"
SCHEMA = "doc_id long, text string, new string, parts int"


def step(tag, r, x, m):
    return int(hashlib.sha256(f"{KEY}|{tag}|{r}|{x}".encode()).hexdigest()[:15], 16) % m


def feistel(tag, left, right, a, b):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            left = (left + step(tag, r, right, a)) % a
        else:
            right = (right + step(tag, r, left, b)) % b
    return left, right


def digits(tag, d):
    h = len(d) // 2
    left, right = feistel(f"{tag}|{len(d)}", int(d[:h] or 0), int(d[h:]), 10 ** h, 10 ** (len(d) - h))
    return (f"{left:0{h}d}" if h else "") + f"{right:0{len(d) - h}d}"


def luhn(body):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], SCHEMA)
    out = pii.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "pii"]
    return [(r.text, r.pii.asDict()) for r in out.orderBy("doc_id").collect()]


def test_cards_equal_brute_force_and_stay_linked(spark):
    rnd = random.Random(1)
    cards = []
    for _ in range(40):
        body = "".join(rnd.choice("0123456789") for _ in range(rnd.choice([12, 14, 15, 18])))
        cards.append(body + luhn(body))
    got = [t for t, _ in run(spark, [f"pay {c}, now" for c in cards])]
    for c, t in zip(cards, got, strict=True):
        body = digits("card", c[:-1])
        assert t == f"pay {body}{luhn(body)}, now"
    plain, spaced, dashed = (x[0] for x in run(spark, ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]))
    assert plain == re.sub("[ -]", "", spaced) == re.sub("[ -]", "", dashed) != "4111111111111111"
    assert [spaced[i] for i in (4, 9, 14)] == [" "] * 3


def test_dates(spark):
    def new(day):
        left, right = feistel("date", *divmod((day - datetime.date(1800, 1, 1)).days, 5411), 27, 5411)
        return datetime.date(1800, 1, 1) + datetime.timedelta(left * 5411 + right)

    d = new(datetime.date(2000, 2, 29))
    got = run(spark, ["2000-02-29", "29.02.2000", "02/29/2000", "29/02/2000", "2/29/2000"])
    assert [t for t, _ in got] == [f"{d}", f"{d:%d.%m.%Y}", f"{d:%m/%d/%Y}", f"{d:%d/%m/%Y}", f"{d.month}/{d.day}/{d.year}"]
    kept = ["2001-02-29", "31.04.2020", "13/13/2000", "1799-12-31", "2200-01-01", "12.13.14.15.16", "1-2000-02-29"]
    assert [t for t, _ in run(spark, kept)] == kept


def test_permutations_are_one_to_one(spark):
    short = spark.range(1000).select(F.format_string("%03d", "id").alias("d"))
    out = [r.p for r in short.select(pii.permuted_string(KEY, F.lit("t"), F.col("d"), 10).alias("p")).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch("[0-9]{3}", x) for x in out)
    assert set(out) == {digits("t", f"{i:03d}") for i in range(1000)}
    whole = spark.range(146097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    assert whole.select(pii._date(KEY, F.col("d")).alias("p")).distinct().count() == 146097


def test_other_kinds_stay_valid(spark):
    (t, n), = run(spark, ["Bob.Smith+x9@mail.example.com 10.20.30.40 +1 (626) 555-5759 123-45-6789 DE89 3704 0044 0532 0130 00"])
    assert n == {"email": 1, "iban": 1, "ip": 1, "date": 0, "ssn": 1, "phone": 1, "card": 0}
    m = re.fullmatch(r"([a-z0-9]{3}\.[a-z0-9]{5}\+[a-z0-9]{2})@mail\.example\.com (\d+\.\d+\.\d+\.\d+) \+1 \(\d{3}\) \d{3}-\d{4} "
                     r"(\d{3}-\d{2}-\d{4}) (DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2})", t)
    assert m and m[1] != "bob.smith+x9"
    assert all(int(x) < 256 for x in m[2].split("."))
    assert not re.match("000|666|9", m[3]) and m[3][4:6] != "00" and m[3][7:] != "0000"
    plain = m[4].replace(" ", "")
    assert int(re.sub("[A-Z]", lambda x: str(ord(x[0]) - 55), plain[4:] + plain[:4])) % 97 == 1


def test_left_alone(spark):
    texts = [None, "", "no numbers here", "4111111111111112", "999.1.1.1", "000-12-3456", "DE00370400440532013000",
             "a" * 300_000, "1" * 300_000]
    got = run(spark, texts)
    assert [t for t, _ in got] == texts
    assert all(not any(n.values()) for _, n in got)


def test_empty_table_repeats_and_taken_name(spark):
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA), KEY).count() == 0
    (a, _), (b, _) = run(spark, ["call +49 30 1234567"] * 2)
    assert a == b != "call +49 30 1234567"
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([("x", 1)], "text string, pii int"), KEY)


def test_groups_behind_a_number_stay(spark):
    def one(text):
        (new, n), = run(spark, [text])
        return new, {k: v for k, v in n.items() if v}

    card, _ = one("4111 1111 1111 1111")
    for tail in [" 12/27", " 123", " 12/27 123"]:
        assert one("4111 1111 1111 1111" + tail) == (card + tail, {"card": 1})
    assert one("4111-1111-1111-1111-123") == (card.replace(" ", "-") + "-123", {"card": 1})
    for behind, kind in [("12/27/2027", "date"), ("10.20.30.40", "ip"), ("123-45-6789", "ssn"), ("12a@b.org", "email")]:
        assert one(f"4111 1111 1111 1111 {behind}") == (f"{card} {one(behind)[0]}", {"card": 1, kind: 1})
    for iban in ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201"]:
        new, _ = one(iban)
        assert new != iban
        for tail in [" BIC CAIXESBB", " USD 5", " CODE ABCD"]:
            assert one(iban + tail) == (new + tail, {"iban": 1})
        assert one(f"{iban} 4111 1111 1111 1111") == (f"{new} {card}", {"iban": 1, "card": 1})
    long, _ = one("ZZ12 1904 3002 3457 3201")
    assert one("ZZ12 1904 3002 3457 3201 USD 5") == (long + " USD 5", {"iban": 1})


def test_phone_numbers_in_pairs_are_taken_whole(spark):
    for grouped, plain in (("+33 6 12 34 56 78", "+33612345678"), ("+49 30 12 34 56 78", "+493012345678")):
        docs = spark.createDataFrame([(1, f"call {grouped} now"), (2, f"call {plain} now")], "doc_id long, text string")
        a, b = (r.text for r in pii.pseudonymise(docs, KEY).orderBy("doc_id").collect())
        digits = lambda t: "".join(c for c in t if c.isdigit())
        assert digits(a) == digits(b) != digits(plain) and len(a) == len(f"call {grouped} now")

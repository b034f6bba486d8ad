"""Format-preserving Feistel pseudonyms for personal numbers and dates (operator 2, native).

Matches that pass their kind's validation are permuted under a key within
their own format: digits stay digits, separators stay where they are, check
digits are made right again, dates stay dates. The permutation is one-to-one
and depends on nothing but key, kind and value, so equal values stay equal
over all documents and different ones stay different.

A value is split into a pair (left, right) of numbers below two moduli A and B,
and eight rounds add keyed hashes of the one half to the other, modulo A and B
in turn. Every domain is exactly A * B large, so no value ever leaves it:

- ``date``: the day of the 400-year cycle from 1800, 146097 = 27 * 5411 days;
- ``ssn``: 898 areas with 99 groups, and 9999 serials;
- ``ip``: two halves of 16 bits;
- ``card``, ``iban``, ``phone``: the free digits, halved; cards keep a right
  Luhn digit, IBANs their country, letters and right check digits, phone
  numbers their country code;
- ``email``: letters and digits before the @, in base 36, in runs of at most
  20 characters; case is lost, marks and the host stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import text_or_empty

ROUNDS = 8
#: Stands in for a secret of the caller's in the registered query.
DEFAULT_KEY = "example key"

#: Lengths of IBANs by country; other countries' end where the longest valid group does.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    fixed = "|".join(
        f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
        + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    return (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{fixed}"
            r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))")


_DATE = (r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
         r"|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])")
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,8}[A-Za-z]{2,}"
#: The last group of a card number of 17 to 19 digits, unless another value starts there.
_TAIL = f"(?!{_DATE}|{_IP}|{_SSN}|{_EMAIL})[0-9]{{1,3}}"

#: The kinds with their patterns, in order of precedence.
PATTERNS = {
    "email": _EMAIL,
    "iban": _iban_pattern(),
    "ip": _IP,
    "date": _DATE,
    "ssn": _SSN,
    "phone": r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
             r"|[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})){2,7})(?![0-9])",
    "card": r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: " + _TAIL + r")?|[0-9]{4}(?:-[0-9]{4}){3}"
            r"(?:-" + _TAIL + r")?|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
_ANY = "|".join(PATTERNS.values())
_FIRST_DAY = "1800-01-01"


def _keyed(key: str, tag: Column, r: Column, x: Column, modulus: Column) -> Column:
    word = F.sha2(F.concat_ws("|", F.lit(key), tag, r, x), 256)
    return F.pmod(F.conv(F.substring(word, 1, 15), 16, 10).cast("long"), modulus)


def feistel(key: str, tag: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the keyed permutation of the pair, left below ``a`` and right below ``b``."""
    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _keyed(key, tag, r, s["r"], a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _keyed(key, tag, r, s["l"], b), b)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("long")


def permuted_string(key: str, tag: Column, value: Column, base: int) -> Column:
    """A string of up to 20 digits of the base (up to 36), permuted among those of its length."""
    n = F.char_length(value)
    half = F.floor(n / 2).cast("int")
    short = F.substring(value, F.lit(1), half)
    left = F.when(half > 0, F.conv(short, base, 10)).otherwise(F.lit("0"))
    right = F.conv(F.substring(value, half + 1, n), base, 10)
    out = feistel(key, F.concat_ws("|", tag, n), left, right, _power(base, half), _power(base, n - half))
    return F.when(n == 0, value).otherwise(_once(out, lambda s: F.concat(
        F.when(half > 0, F.lower(F.lpad(F.conv(s["l"].cast("string"), 10, base), half, "0"))).otherwise(F.lit("")),
        F.lower(F.lpad(F.conv(s["r"].cast("string"), 10, base), n - half, "0")))))


def _refilled(shape: Column, pattern: str, values: Column) -> Column:
    """``shape`` with its characters of the pattern replaced, in order, by those of ``values``."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        free = c.rlike(pattern)
        return F.struct(
            F.concat(s["done"], F.when(free, F.substring(values, s["k"], F.lit(1))).otherwise(c)).alias("done"),
            (s["k"] + F.when(free, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, put)["done"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_digit(body: Column) -> Column:
    """The check digit behind ``body``."""
    chars = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    worth = F.transform(chars, lambda c, i: F.when(
        i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + (c.cast("int") * 2) % 10).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(worth, F.lit(0), lambda s, x: s + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _mod97(x: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals (A is 10, Z is 35)."""
    def step(s: Column, c: Column) -> Column:
        number = c.rlike("[0-9]")
        return F.when(number, (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), step)


def _iban_plain(x: Column) -> Column:
    return F.regexp_replace(x, " ", "")


def _month_first(x: Column) -> Column:
    """Whether a match has the month in front: with slashes, unless that number is over 12."""
    return F.contains(x, F.lit("/")) & (F.substring_index(x, "/", 1).cast("int") <= 12)


def _day(x: Column) -> Column:
    """The date of a match in any of the written orders, null where there is none."""
    part = F.split(x, "[-/.]")
    year_first = F.char_length(part[0]) == 4
    month = F.when(_month_first(x), part[0]).otherwise(part[1])
    day = F.when(year_first, part[2]).when(_month_first(x), part[1]).otherwise(part[0])
    year = F.when(year_first, part[0]).otherwise(part[2])
    made = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    found = F.try_to_date(made, "yyyy-MM-dd")
    return F.when(year.cast("int").between(1800, 2199), found)


def _whole(kind: str, x: Column) -> Column:
    return x.rlike(f"^(?:{PATTERNS[kind]})$")


def _is_iban(x: Column) -> Column:
    plain = _iban_plain(x)
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    return _whole("iban", x) & (_mod97(turned) == 1)


def _is_card(x: Column) -> Column:
    card = _digits(x)
    n = F.char_length(card)
    return _whole("card", x) & (_luhn_digit(F.substring(card, F.lit(1), n - 1)) == F.substring(card, n, F.lit(1)))


def _kind_of(x: Column) -> Column:
    """The kind of a match that passes validation, else null."""
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    return (F.when(_whole("email", x), "email")
            .when(_is_iban(x), "iban")
            .when(_whole("ip", x), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
            .when(_whole("date", x), F.when(_day(x).isNotNull(), "date"))
            .when(_whole("ssn", x), F.when(x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"))
            .when(_whole("phone", x), F.when(F.char_length(_digits(x)).between(8, 15), "phone"))
            .when(_is_card(x), "card"))


def _shortened(x: Column) -> Column:
    """struct(m, kind): the longest run of a match's first groups that is an IBAN or a card by
    itself, for a match that isn't valid with all of its groups; null where there is none."""
    groups = F.split(x, "(?=[ -])")
    shorter = F.transform(F.sequence(F.size(groups) - 1, F.lit(1)), lambda n: F.array_join(F.slice(groups, 1, n), ""))
    valid = F.filter(
        F.transform(shorter, lambda y: F.struct(
            y.alias("m"), F.when(_is_iban(y), "iban").when(_is_card(y), "card").alias("kind"))),
        lambda s: s["kind"].isNotNull())
    able = (F.size(groups) > 2) & (x.rlike("^[A-Z]{2}[0-9]{2}") | x.rlike("^[0-9]{4}[ -]"))
    return F.when(able, F.get(valid, F.lit(0)))


def _email(key: str, x: Column) -> Column:
    local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    free = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(free) - 1, F.lit(0)) / 20).cast("int")),
                       lambda i: permuted_string(key, F.concat(F.lit("email"), i.cast("string")),
                                                 F.substring(free, i * 20 + 1, F.lit(20)), 36))
    return F.concat(_once(F.array_join(runs, ""), lambda v: _refilled(local, "[A-Za-z0-9]", v)), F.lit("@"), host)


def _phone(key: str, x: Column) -> Column:
    d = _digits(x)
    kept = F.when(F.substring(d, 1, 1).isin("1", "7"), 1).otherwise(2)
    free = permuted_string(key, F.lit("phone"), F.substring(d, kept + 1, F.char_length(d)), 10)
    return _once(F.concat(F.substring(d, F.lit(1), kept), free), lambda v: _refilled(x, "[0-9]", v))


def _card(key: str, x: Column) -> Column:
    d = _digits(x)
    body = permuted_string(key, F.lit("card"), F.substring(d, F.lit(1), F.char_length(d) - 1), 10)
    return _once(_once(body, lambda b: F.concat(b, _luhn_digit(b))), lambda v: _refilled(x, "[0-9]", v))


def _iban(key: str, x: Column) -> Column:
    plain = _iban_plain(x)
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.char_length(plain))
    d = _digits(body)
    parts = F.concat(permuted_string(key, F.lit("iban0"), F.substring(d, 1, 20), 10),
                     permuted_string(key, F.lit("iban1"), F.substring(d, F.lit(21), F.char_length(d)), 10))
    new = _once(parts, lambda v: _refilled(body, "[0-9]", v))
    whole = _once(new, lambda b: F.concat(country, F.lpad(
        (F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return _once(whole, lambda v: _refilled(x, "[A-Z0-9]", v))


def _ssn(key: str, x: Column) -> Column:
    d = _digits(x).cast("int")
    area = F.floor(d / 1000000)
    first = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + F.floor(d / 10000) % 100 - 1
    out = feistel(key, F.lit("ssn"), first, d % 10000 - 1, F.lit(898 * 99), F.lit(9999))

    def written(s: Column) -> Column:
        area = F.floor(s["l"] / 99) + 1
        return F.format_string("%03d-%02d-%04d", F.when(area >= 666, area + 1).otherwise(area), s["l"] % 99 + 1, s["r"] + 1)

    return _once(out, written)


def _ip(key: str, x: Column) -> Column:
    o = F.transform(F.split(x, r"\."), lambda v: v.cast("long"))
    out = feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return _once(out, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))


def _date(key: str, x: Column) -> Column:
    day = F.datediff(_day(x), F.lit(_FIRST_DAY).cast("date"))
    out = feistel(key, F.lit("date"), F.floor(day / 5411), day % 5411, F.lit(27), F.lit(5411))

    def written(s: Column) -> Column:
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["l"] * 5411 + s["r"]).cast("int"))
        # two-digit days and months unless they were written with one
        wide = x.rlike("^[0-9]{2}[/.][0-9]{2}[/.]")
        month = F.when(wide, F.date_format(new, "MM")).otherwise(F.date_format(new, "M"))
        day = F.when(wide, F.date_format(new, "dd")).otherwise(F.date_format(new, "d"))
        return (F.when(F.contains(x, F.lit("-")), F.date_format(new, "yyyy-MM-dd"))
                .when(_month_first(x), F.concat_ws("/", month, day, F.date_format(new, "yyyy")))
                .when(F.contains(x, F.lit("/")), F.concat_ws("/", day, month, F.date_format(new, "yyyy")))
                .otherwise(F.concat_ws(".", day, month, F.date_format(new, "yyyy"))))

    return _once(out, written)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with validated personal values in the text replaced by their
    pseudonyms, and a struct column ``pii`` with the number of values of each kind.

    Null text stays null and counts nothing, empty text stays empty, texts of
    any length are read whole. Values that fail validation stay as they are;
    of IBANs and cards with more groups behind them, those that fail with the
    number stay.
    A column named ``pii`` raises; others may have any name. Repeated rows are
    treated alike, an empty table gives no rows. The key is part of the
    query's plan: give access to plans and event logs accordingly.
    """
    if "pii" in docs.columns:
        raise ValueError("the column name 'pii' is taken by the result")
    t = text_or_empty(text)
    own = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}

    def replaced(m: Column, kind: Column) -> Column:
        out = F.when(kind.isNull(), m)
        for k in KINDS:
            out = out.when(kind == k, own[k](key, m))
        return out

    def decided(m: Column) -> Column:
        kind = _kind_of(m)
        return _once(F.struct(m.alias("m"), kind.alias("kind")), lambda x: F.when(
            x["kind"].isNull(), F.coalesce(_shortened(x["m"]), x)).otherwise(x))

    matches = F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))
    found = F.transform(matches, lambda m: F.struct(decided(m).alias("x"), m.alias("all")))
    new = F.transform(found, lambda f: F.struct(
        F.concat(replaced(f["x"]["m"], f["x"]["kind"]),
                 F.substring(f["all"], F.char_length(f["x"]["m"]) + 1, F.char_length(f["all"]))).alias("new"),
        f["x"]["kind"].alias("kind")))
    parts = F.split(t, _ANY, -1)
    rows = docs.withColumn("pii", F.struct(
        F.when(t.rlike(_ANY), parts).alias("parts"), F.when(t.rlike(_ANY), new).alias("new")))
    joined = F.array_join(F.transform(
        F.arrays_zip(F.col("pii.parts").alias("p"), F.col("pii.new").alias("n")),
        lambda x: F.concat(x["p"], F.coalesce(x["n"]["new"], F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("pii.new", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")

    return (rows.withColumn(text, F.coalesce(joined, F.col(text)))
            .withColumn("pii", F.struct(*[
                F.when(F.col("pii.new").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(k) for k in KINDS])))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, DEFAULT_KEY)
    return out.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS])

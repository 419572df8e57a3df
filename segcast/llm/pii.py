"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Validated numbers and dates are permuted within their format by a keyed Feistel network:
payment cards (Luhn), phone numbers, IPv4 addresses, US social security numbers, calendar
dates and cloud access keys.  A value's numeral is held as a pair (l, r) in Z_a x Z_b;
each round adds a keyed hash of one part to the other, which is a bijection whatever the
hash.  So different values stay different, a valid value stays valid, and equal values
get equal pseudonyms in every document.  Mail addresses and secrets have no validity to keep
and may not be reversible: they are replaced by keyed digests (80 bits for an address).
Whoever has the key can undo the permutations, so the caller gives it and keeps it.

One pattern finds all kinds; the text between matches is kept as it is.

Defined cases: a null text gives an empty text; candidates that fail validation (a card
number with a wrong check digit, 300.1.1.1, 31 February) are left alone; dates outside
1900-01-01 to 2099-11-13 are not taken for personal; so are the forms that are not looked for
(dates other than yyyy-MM-dd, phone numbers without + or 3-3-4 groups, IBANs, secrets of fewer than six
characters or, after a colon, without a digit among the first 256); repeated rows give repeated results;
columns other than doc_id and text are not read by ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import text_or_empty

ROUNDS = 10
KEY = "change me: secret of the corpus owner"

#: Repeated groups are possessive: Java walks them in a loop, where others recurse once per label. A match takes all labels;
#: the address ends with the last one that starts with two letters, and there must be one.
EMAIL = (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9\-]++(?:\.(?![A-Za-z]{2})[A-Za-z0-9\-]++)*+\.[A-Za-z]{2})"
         r"[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++")
ADDRESS = r"^(.*\.[A-Za-z]{2,})"
#: After a colon a value must hold a digit among its first 256 characters, so that prose is left alone and the look stays short.
SECRET = (r"(?i:password|passwd|secret|token|api_?key)[ \t]*+(?:=|:(?=[ \t]{0,64}+\"?[^\s\"]{0,256}?\d))[ \t]*+"
          r"(?:\"[^\"\s]{6,}+\"|[^\s\"]{6,}+)")
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
DATE = r"(?<![\d.\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
SSN = r"(?<![\d.\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?<!\d\.)(?:\d{13,19}+|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
PHONE = (r"(?:(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
         r"|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d))")
KINDS = ("email", "secret", "access_key", "date", "ssn", "ipv4", "card", "phone")
PATTERN = "|".join((EMAIL, SECRET, ACCESS_KEY, DATE, SSN, IPV4, CARD, PHONE))

_FIRST_DAY, _DAYS = "1900-01-01", (250, 292)  # 250 * 292 days


def _digest(key: str, tweak: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: str, key: str = KEY) -> Column:
    """Keyed permutation of Z_a x Z_b as struct (l, r) of longs."""
    def added(x: Column, other: Column, i: Column, modulus: Column) -> Column:
        mask = F.conv(F.substring(_digest(key, tweak, i, a, b, other), 1, 15), 16, 10).cast("long")
        return (x + F.pmod(mask, modulus)) % modulus

    def round_(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, added(acc["l"], acc["r"], i, a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(added(acc["r"], acc["l"], i, b)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _let(value: Column, then) -> Column:
    """``then`` applied to ``value``, which is worked out once."""
    return F.transform(F.array(value), then)[0]


def _number(digits: Column) -> Column:
    return F.coalesce(F.when(digits != "", digits).cast("long"), F.lit(0).cast("long"))


def permute_digits(digits: Column, tweak: str, key: str = KEY) -> Column:
    """Keyed permutation of the digit strings of one length, up to 36 digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")

    def joined(p: Column) -> Column:
        return F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0"))

    power = lambda m: F.rpad(F.lit("1"), m + 1, "0").cast("long")
    halves = feistel(_number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, n - half)),
                     power(half), power(n - half), tweak, key)
    return _let(halves, joined)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit undoubled."""
    last_first = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(last_first, lambda c, i: _doubled(c, i)), F.lit(0), lambda acc, x: acc + x)


def _doubled(c: Column, i: Column) -> Column:
    d = F.coalesce(F.when(c != "", c).cast("int"), F.lit(0))
    twice = d * 2
    return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _into_shape(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
                        (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(s, ""), start, step, lambda acc: acc["out"])


def _card(s: Column, key: str) -> Column:
    """The first digit stays, the rest before the check digit is permuted, the check digit follows."""
    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), n - 2), "card", key))
        return _let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _let(_digits(s), lambda d: _let(made(d), lambda x: _into_shape(s, x)))


def _phone(s: Column, key: str) -> Column:
    """The last ten digits are permuted, a country code before them stays."""
    def made(d: Column) -> Column:
        kept = F.greatest(F.lit(0), F.length(d) - 10)
        return F.concat(F.substr(d, F.lit(1), kept), permute_digits(F.substr(d, kept + 1, F.lit(10)), "phone", key))

    return _let(_digits(s), lambda d: _let(made(d), lambda x: _into_shape(s, x)))


def _ipv4(s: Column, key: str) -> Column:
    def dotted(p: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for side in ("l", "r")
                                  for x in (F.shiftright(p[side], 8), p[side].bitwiseAND(F.lit(255)))])

    def made(o: Column) -> Column:
        n = [o[i].cast("long") for i in range(4)]
        size = F.lit(1 << 16).cast("long")
        return _let(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], size, size, "ipv4", key), dotted)

    return _let(F.split(s, "\\."), made)


def _ssn(s: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(s, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    left = (area - 1 - (area > 666).cast("int")) * 99 + group - 1

    def written(p: Column) -> Column:
        number = F.floor(p["l"] / 99).cast("long") + 1
        number = number + (number >= 666).cast("int")
        return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return _let(feistel(left, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key), written)


def _day(s: Column) -> Column:
    """Days since the first day; null if there is no such date."""
    return F.datediff(F.try_to_date(s, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))


def _date(s: Column, key: str) -> Column:
    a, b = (F.lit(x).cast("long") for x in _DAYS)

    def written(p: Column) -> Column:
        return F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * b + p["r"]).cast("int")), "yyyy-MM-dd")

    return _let(_day(s), lambda d: _let(feistel(F.floor(d / b), d % b, a, b, "date", key), written))


def _access_key(s: Column, key: str) -> Column:
    """The prefix stays, the sixteen letters and digits after it are permuted."""
    half = [F.conv(F.substr(s, F.lit(at), F.lit(8)), 36, 10).cast("long") for at in (5, 13)]
    size = F.lit(36 ** 8).cast("long")

    def written(p: Column) -> Column:
        return F.concat(F.substr(s, F.lit(1), F.lit(4)), *[F.lpad(F.conv(p[x].cast("string"), 10, 36), 8, "0") for x in ("l", "r")])

    return _let(feistel(*half, size, size, "access_key", key), written)


def _secret(s: Column, key: str) -> Column:
    """The name and sign stay; the value becomes hexadecimal of the same length."""
    name = F.regexp_extract(s, r"^(\w+[ \t]*[=:][ \t]*\"?)", 1)
    value = F.regexp_replace(F.substr(s, F.length(name) + 1), "\"$", "")
    hidden = F.substr(F.repeat(_digest(key, "secret", value), F.floor(F.length(value) / 64).cast("int") + 1), F.lit(1), F.length(value))
    return F.concat(name, hidden, F.when(s.endswith("\""), F.lit("\"")).otherwise(F.lit("")))


def _email(s: Column, key: str) -> Column:
    address = F.regexp_extract(s, ADDRESS, 1)
    low = F.lower(address)
    return F.concat(F.substr(_digest(key, "email", low), F.lit(1), F.lit(20)), F.lit("@"),
                    F.substr(_digest(key, "domain", F.substring_index(low, "@", -1)), F.lit(1), F.lit(20)), F.lit(".invalid"),
                    F.substr(s, F.length(address) + 1))


def _kind(s: Column) -> Column:
    """Kind of a match, null where validation fails. The order is that of the pattern."""
    whole = lambda p: s.rlike(f"^(?:{p})$")
    digits = _digits(s)
    octets = F.forall(F.split(s, "\\."), lambda x: x.cast("int") <= 255)
    area = F.substr(s, F.lit(1), F.lit(3))
    ssn_ok = (area != "000") & (area != "666") & (area < "900") & ~s.rlike("-00-|-0000$")
    day_ok = _day(s).between(0, _DAYS[0] * _DAYS[1] - 1)
    return (
        F.when(s.contains("@") & whole(EMAIL), "email")
        .when(s.rlike("^[A-Za-z_]+[ \t]*[=:]"), "secret")
        .when(s.rlike("^A[KS]IA"), "access_key")
        .when(whole(r"\d{4}-\d{2}-\d{2}"), F.when(day_ok, "date"))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(ssn_ok, "ssn"))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(octets, "ipv4"))
        .when(whole(r"\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}"), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(F.length(digits).between(8, 15), "phone")
    )


def _pseudonym(s: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "secret": _secret, "access_key": _access_key, "date": _date, "ssn": _ssn,
            "ipv4": _ipv4, "card": _card, "phone": _phone}
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(kind == name, made[name](s, key)).otherwise(out)
    return F.coalesce(out, s)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_values, n_<kind>...): each text with its personal data replaced, and what was found."""
    text = text_or_empty().cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # most texts have no digit, @, sign of assignment or start of an access key (its rest may be all letters), so no match either
    found = F.when(F.col("text").rlike("[0-9@=:]|A[KS]IA"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    base = base.withColumn("found", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: s != ""))
    pairs = F.transform("found", lambda s: F.struct(s.alias("s"), _kind(s).alias("kind")))
    base = base.withColumn("found", pairs)
    new = F.transform("found", lambda p: _pseudonym(p["s"], p["kind"], key))
    between = F.split("text", PATTERN)
    woven = F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n_values = F.size(F.filter("found", lambda p: p["kind"].isNotNull())).cast("long").alias("n_values")
    return base.select("doc_id", F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(woven, "")).alias("text"),
                       n_values, *map(count, KINDS))

"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Method: numbers and dates that pass the validation of their kind are permuted by
a keyed Feistel network on exactly the values of that kind and format. A
permutation of a domain maps equal values to equal values and different ones to
different ones, so that mentions of one value stay linked across documents while
the value itself is gone; and a pseudonym passes the validation of its kind, and of
no other.

======= ================================================ =========================
kind    what counts                                      domain that is permuted
======= ================================================ =========================
email   local@domain with a dot in the domain            letters and digits of the
                                                         local part; the domain stays
ipv4    four numbers of at most 255                      32 bits
date    YYYY-MM-DD, DD.MM.YYYY or MM/DD/YYYY that the    the 73,049 days of 1900
        calendar has                                     to 2099
card    13 to 19 digits, alone or in groups of four,     all digits but the last,
        whose Luhn sum is right                          which is computed anew
phone   + and 7 to 15 digits with usual separators, or   the digits after the
        three, three and four digits                     country code
ssn     ddd-dd-dddd with a valid area                    898 areas, six digits
account 13 to 19 digits that are no card                 all digits but the last,
                                                         and which of the nine wrong
                                                         check digits the last one is
======= ================================================ =========================

Digits are put back into the format they were found in. Values that fail the
validation stay. A date beyond the domain stays.

The key never stands in a plan: it is the value of a scalar subquery over a table
of one row, so neither ``explain`` nor the event log shows it.

Defined cases: null text stays null; an empty text stays empty; very long texts are
rewritten whole; repeated rows and extra columns, whatever their names, are
untouched; where two patterns start at one place the first of PATTERN counts; no row
is added or dropped; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ipv4", "date", "card", "phone", "ssn", "account"]
ROUNDS = 8
#: Columns that a text has meanwhile, and the letters of a local part.
MARK, KEY, LETTERS = "__matches_of_pii__", "__key_of_pii__", "0123456789abcdefghijklmnopqrstuvwxyz"
#: One alternation; every branch starts where a run starts, so a scan is linear.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
        r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
        r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
        r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])",
        r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
        r"(?<![0-9A-Za-z(+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    ]
)
#: Days of the domain of dates, and its two factors.
FIRST_DAY, DAYS, FEW, MANY = "1900-01-01", 73_049, 17, 4_297


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the key in the column KEY, from a table of one row."""
    table = docs.sparkSession.sql("SELECT * FROM VALUES (:key) AS t(k)", args={"key": key})
    return docs.withColumn(KEY, table.scalar())


def _digest(kind: Column | str, turn: Column, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("|", F.col(KEY), kind, turn.cast("string"), value.cast("string")), 256)


def feistel(kind: Column | str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A permutation of pairs (left, right) below the sizes, as a struct (l, r).

    Even rounds add a keyed function of right to left, odd ones the other way
    round, so both halves keep their own size.
    """
    # what the rounds need rides along, so that it is made once and not in every round
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_size.cast("long").alias("m"), right_size.cast("long").alias("n"))

    def step(p: Column, turn: Column) -> Column:
        def draw(value: Column, below: Column) -> Column:
            return F.pmod(F.conv(F.substring(_digest(kind, turn, value), 1, 15), 16, 10).cast("long"), below)

        even = turn % 2 == 0
        return F.struct(
            F.when(even, F.pmod(p["l"] + draw(p["r"], p["m"]), p["m"])).otherwise(p["l"]).alias("l"),
            F.when(even, p["r"]).otherwise(F.pmod(p["r"] + draw(p["l"], p["n"]), p["n"])).alias("r"),
            p["m"].alias("m"), p["n"].alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bound(value: Column, use: Callable[[Column], Column], zero: Column | None = None) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.aggregate(F.array(value), F.lit("") if zero is None else zero, lambda _, v: use(v))


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def _pad(number: Column, n: Column) -> Column:
    return F.lpad(number.cast("string"), n, F.lit("0"))


def permute_digits(kind: str, digits: Column, check: int = 1, rest: Column | None = None) -> Column:
    """A string of 1 to 18 digits as another of the same length. With ``check``
    above 1, the number ``rest`` below it is permuted along; the result then ends
    in another such number, as one digit."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    left, right = (F.coalesce(F.nullif(x, F.lit("")).cast("long"), F.lit(0).cast("long")) for x in (F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, b)))
    right = right * check + rest if rest is not None else right
    pair = feistel(F.concat(F.lit(kind), F.length(digits).cast("string")), left, right, _power(a), _power(b) * check)
    back = lambda p: F.concat(F.when(a > 0, _pad(p["l"], a)).otherwise(""), _pad(F.floor(p["r"] / check) if check > 1 else p["r"], b), (p["r"] % check).cast("string") if check > 1 else F.lit(""))
    return _bound(pair, back)


def permute_word(kind: str, word: Column) -> Column:
    """A word of small letters and digits, up to 64, as another of the same length:
    a Feistel network whose halves are words, added character by character."""
    a = F.floor(F.length(word) / 2).cast("int")
    start = F.struct(F.substring(word, F.lit(1), a).alias("l"), F.substring(word, a + 1, F.length(word)).alias("r"))

    def added(half: Column, digest: Column) -> Column:
        def moved(c: Column, i: Column) -> Column:
            drawn = F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.when(c == "", "").otherwise(F.substring(F.lit(LETTERS), F.pmod(F.position(c, F.lit(LETTERS)) - 1 + drawn, F.lit(len(LETTERS))) + 1, F.lit(1)))

        return F.array_join(F.transform(F.split(half, ""), moved), "")

    def step(p: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        drawn = _digest(kind, turn, F.when(even, p["r"]).otherwise(p["l"]))
        other = _bound(drawn, lambda d: added(F.when(even, p["l"]).otherwise(p["r"]), d))
        return F.struct(F.when(even, other).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(other).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["l"], p["r"]))


def luhn_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum from the right; the rightmost digit stands at ``shift``."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((i + shift) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i))


def refill(form: Column, digits: Column, places: str = "[0-9]") -> Column:
    """``form`` with its digits (what ``places`` takes) replaced by ``digits``, in order."""
    # the digits ride along, so that they are made once and not for every character
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"), digits.alias("digits"))

    def step(p: Column, c: Column) -> Column:
        is_digit = c.rlike(places)
        return F.struct(F.concat(p["out"], F.when(is_digit, F.substring(p["digits"], p["next"], F.lit(1))).otherwise(c)).alias("out"), (p["next"] + is_digit.cast("int")).alias("next"), p["digits"].alias("digits"))

    return F.aggregate(F.split(form, ""), start, step, lambda p: p["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(match: Column) -> Column:
    """The kind of a match of PATTERN; null where its validation fails."""
    digits = _digits(match)
    octets = F.forall(F.split(match, r"\."), lambda o: F.length(o).between(1, 3) & (F.try_to_number(o, F.lit("999")) <= 255))
    date = F.coalesce(*(F.try_to_timestamp(match, F.lit(f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"))).cast("date")
    area = F.substring(digits, 1, 3)
    return (
        F.when(match.contains("@"), F.lit("email"))
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, F.lit("ipv4")))
        .when(match.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), F.when(date.between("1900-01-01", "2099-12-31"), F.lit("date")))
        .when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~area.isin("000", "666") & (area < "900"), F.lit("ssn")))
        .when(match.startswith("+"), F.when(F.length(digits).between(7, 15), F.lit("phone")))
        .when(match.rlike(r"^\(?[0-9]{3}[).-] ?[0-9]{3}[.-][0-9]{4}$"), F.lit("phone"))
        .when(F.length(digits).between(13, 19) & (luhn_sum(digits, 0) % 10 == 0), F.lit("card"))
        .when(F.length(digits).between(13, 19), F.lit("account"))
    )


def _ipv4(match: Column) -> Column:
    def permuted(o: Column) -> Column:
        pair = feistel("ipv4", F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536))
        return _bound(pair, lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")))

    return _bound(F.transform(F.split(match, r"\."), lambda x: x.cast("long")), permuted)


def _date(match: Column) -> Column:
    forms = [("^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy")]

    def one(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(match, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        pair = feistel("date", F.floor(day / MANY), day % MANY, F.lit(FEW), F.lit(MANY))
        moved = _bound(pair, lambda p: p["l"] * MANY + p["r"], F.lit(0).cast("long"))
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), form)

    return F.coalesce(*(F.when(match.rlike(start), one(form)) for start, form in forms))


def _check_digit(payload: Column) -> Column:
    """The digit that makes the Luhn sum right."""
    return F.pmod(10 - luhn_sum(payload, 1) % 10, F.lit(10))


def _card(match: Column) -> Column:
    digits = _digits(match)
    payload = permute_digits("card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    return refill(match, _bound(payload, lambda p: F.concat(p, _check_digit(p).cast("string"))))


def _account(match: Column) -> Column:
    """The last digit is off the right check digit by 1 to 9, before and after."""

    def moved(digits: Column) -> Column:
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
        off = F.pmod(F.substring(digits, -1, 1).cast("int") - _check_digit(payload), F.lit(10)) - 1
        made = permute_digits("account", payload, 9, off)
        return _bound(made, lambda p: _bound(F.substring(p, F.lit(1), F.length(p) - 1), lambda q: F.concat(q, F.pmod(_check_digit(q) + 1 + F.substring(p, -1, 1).cast("int"), F.lit(10)).cast("string"))))

    return refill(match, _bound(_digits(match), moved))


def _ssn(match: Column) -> Column:
    digits = _digits(match)
    area = F.substring(digits, 1, 3).cast("int")
    pair = feistel("ssn", area - 1 - (area > 666).cast("int"), F.substring(digits, 4, 6).cast("long"), F.lit(898), F.lit(1_000_000))
    return refill(match, _bound(pair, lambda p: F.concat(_pad(p["l"] + 1 + (p["l"] >= 665).cast("int"), F.lit(3)), _pad(p["r"], F.lit(6)))))


def _phone(match: Column) -> Column:
    """The country code, one to three digits up to a separator, stays."""
    code = F.when(~match.startswith("+"), "").when(match.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.regexp_extract(match, r"^\+([0-9]{1,3})", 1)).otherwise(F.substring(match, 2, 1))
    rest = F.substring(_digits(match), F.length(code) + 1, F.lit(20))
    return refill(match, F.concat(code, permute_digits("phone", rest)))


def _email(match: Column) -> Column:
    """Letters and digits of the local part; its other characters stay in place."""
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    plain = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")
    return F.concat(refill(local, _bound(plain, lambda w: permute_word("email", w)), "[A-Za-z0-9]"), F.lit("@"), domain)


MAKERS = {"email": _email, "ipv4": _ipv4, "date": _date, "card": _card, "phone": _phone, "ssn": _ssn, "account": _account}


def pseudonym(match: Column, kind: Column) -> Column:
    """What replaces a match of PATTERN; the match itself where it isn't valid."""
    return _bound(kind, lambda k: F.coalesce(reduce(lambda c, name: c.when(k == name, MAKERS[name](match)), KINDS[1:], F.when(k == KINDS[0], MAKERS[KINDS[0]](match))), match))


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str, matches_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced. ``matches_col``
    names a further column: an array of (kind, old, new)."""
    columns, docs = docs.columns, keyed(docs, key)
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    told = F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("old")))
    pairs = F.transform(told, lambda t: F.struct(t["kind"].alias("kind"), t["old"].alias("old"), pseudonym(t["old"], t["kind"]).alias("new")))
    possible = text.rlike("[0-9@]") & text.rlike(PATTERN)
    marked = docs.withColumn(MARK, F.when(possible, pairs))
    joined = F.zip_with(F.split(text, PATTERN), MARK, lambda gap, p: F.concat(gap, F.coalesce(p["new"], F.lit(""))))
    changed = F.when(F.col(MARK).isNotNull(), F.array_join(joined, "")).otherwise(text)
    return marked.select(*(changed.alias(c) if c == text_col else docs[c] for c in columns), *([F.col(MARK).alias(matches_col)] if matches_col else []))

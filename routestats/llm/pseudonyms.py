"""Personal numbers, dates and addresses replaced by format-preserving pseudonyms, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 8

_EDGE, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Candidates, in the order in which they are tried at a place; each is validated after it is found.
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z][0-9A-Za-z._%+-]{0,63}+@[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62}){1,8}",
    "card": _EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _END,
    "phone": r"(?<![0-9A-Za-z_+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "address": r"(?<![0-9A-Za-z_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_]|\.[0-9])",
    "date": _EDGE + r"(?:(?:19|20)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})" + _END,
}
#: All in one, written for speed: a run of an address is never gone back into, and at any place that is no digit or
#: plus sign the numbers are out of the question at once.
ANY = PATTERNS["email"] + "|(?=[0-9+])(?:" + "|".join(p for kind, p in PATTERNS.items() if kind != "email") + ")"
#: What every candidate holds.
HINT = "[0-9@]"
_LONGS = "array<long>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _longs(*numbers: int) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in numbers])


def _whole(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind]})$")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _digits(value: Column) -> Column:
    """The characters of a string of digits as numbers."""
    return F.transform(_chars(value), lambda c: c.cast("long"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits, the last one counted once."""

    def total(known: Column) -> Column:
        def term(d: Column, i: Column) -> Column:
            twice = 2 * d
            return F.when((F.size(known) - i) % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.aggregate(F.transform(known, term), F.lit(0).cast("long"), lambda a, b: a + b)

    return _let(digits, total)


def permuted(symbols: Column, sizes: Column, key: str) -> Column:
    """A keyed permutation of all arrays whose i-th number is below the i-th size; two numbers or more.

    An alternating Feistel network: in each round one half's numbers are moved, modulo their sizes, by a keyed hash of
    the other half. Each round can be undone, so different arrays stay different, and the formats stay.
    """

    def network(x: Column) -> Column:
        half = F.floor(F.size(x["sizes"]) / 2)

        def turn(state: Column, number: Column) -> Column:
            left = number % 2 == 0
            other = F.when(left, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))

            def moved(said: Column) -> Column:
                def move(size: Column, i: Column) -> Column:
                    text = F.concat_ws("|", F.lit(key), number.cast("string"), i.cast("string"), said)
                    drawn = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
                    own = F.element_at(state, (i + 1).cast("int"))
                    return F.when((i < half) == left, F.pmod(own + F.pmod(drawn, size), size)).otherwise(own)

                return F.transform(x["sizes"], move)

            return _let(F.array_join(F.transform(other, lambda v: v.cast("string")), ","), moved).cast(_LONGS)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x["symbols"], turn)

    return _let(F.struct(symbols.cast(_LONGS).alias("symbols"), sizes.cast(_LONGS).alias("sizes")), network)


def _refilled(value: Column, symbols: Column, wanted: str) -> Column:
    """``value`` with its characters of the set ``wanted`` replaced in order by the given strings."""

    def filled(x: Column) -> Column:
        rank = lambda i: F.size(F.filter(F.slice(x["chars"], F.lit(1), i + 1), lambda c: c.rlike(wanted)))
        put = F.transform(x["chars"], lambda c, i: F.when(c.rlike(wanted), F.element_at(x["symbols"], rank(i))).otherwise(c))
        return F.array_join(put, "")

    return _let(F.struct(_chars(value).alias("chars"), symbols.alias("symbols")), filled)


def _text(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: n.cast("string"))


def _card(value: Column, key: str) -> Column:
    """The first digit stays, the check digit is computed anew; only numbers that pass the Luhn check change."""

    def changed(digits: Column) -> Column:
        def checked(head: Column) -> Column:
            check = F.pmod(-_luhn(F.concat(head, _longs(0))), F.lit(10).cast("long"))
            return _refilled(value, _text(F.concat(head, F.array(check))), "[0-9]")

        middle = F.slice(digits, F.lit(2), F.size(digits) - 2)
        moved = permuted(middle, F.transform(middle, lambda _: F.lit(10).cast("long")), f"{key}|card")
        return F.when(_luhn(digits) % 10 == 0, _let(F.concat(F.slice(digits, 1, 1), moved), checked)).otherwise(value)

    return _let(_digits(F.regexp_replace(value, "[ -]", "")), changed)


def _phone(value: Column, key: str) -> Column:
    """The country code stays. Area and exchange from 200 keep a first digit from 2 to 9; of other numbers, those with
    such an area keep it and an exchange below 200, and those with an area below 200 one below 200."""

    def changed(digits: Column) -> Column:
        area, exchange = F.element_at(digits, 1) >= 2, F.element_at(digits, 4) >= 2
        low = F.when(~area, _longs(*[0] * 10)).when(exchange, _longs(2, 0, 0, 2, *[0] * 6)).otherwise(_longs(2, *[0] * 9))
        sizes = (
            F.when(~area, _longs(2, *[10] * 9)).when(exchange, _longs(8, 10, 10, 8, *[10] * 6))
            .otherwise(_longs(8, 10, 10, 2, *[10] * 6))
        )
        moved = permuted(F.zip_with(digits, low, lambda d, b: d - b), sizes, f"{key}|phone")
        new = F.zip_with(moved, low, lambda d, b: d + b)
        return F.concat(F.lit("+1"), _refilled(F.substring(value, 3, 100), _text(new), "[0-9]"))

    return _let(_digits(F.regexp_replace(F.substring(value, 3, 100), "[^0-9]", "")), changed)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001; other numbers are not valid and stay."""
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(new: Column) -> Column:
        back = F.when(new[0] >= 665, new[0] + 2).otherwise(new[0] + 1)
        parts = ((back, 3), (new[1] + 1, 2), (new[2] + 1, 4))
        return F.concat_ws("-", *[F.lpad(n.cast("string"), width, "0") for n, width in parts])

    new = permuted(F.array(index, group - 1, serial - 1), _longs(898, 99, 9999), f"{key}|ssn")
    return F.when(valid, _let(new, written)).otherwise(value)


def _address(value: Column, key: str) -> Column:
    """Internet addresses with all parts up to 255; others stay.

    First parts up to 223 and from 224 are permuted among themselves.
    """

    def changed(parts: Column) -> Column:
        first = F.element_at(parts, 1)
        valid = F.forall(parts, lambda p: p <= 255)
        low = F.when(first < 224, 0).otherwise(224).cast("long")
        symbols = F.transform(parts, lambda p, i: F.when(i == 0, p - low).otherwise(p))
        sizes = F.when(first < 224, _longs(224, 256, 256, 256)).otherwise(_longs(32, 256, 256, 256))
        new = permuted(symbols, sizes, f"{key}|address")
        text = F.transform(new, lambda p, i: F.when(i == 0, p + low).otherwise(p).cast("string"))
        return F.when(valid, F.array_join(text, ".")).otherwise(value)

    return _let(F.transform(F.split(value, r"\."), lambda p: p.cast("long")), changed)


def _date(value: Column, key: str) -> Column:
    """Days of 1900 to 2099; the 366th days of leap years are permuted among themselves.

    A day has the same pseudonym however it is written, each time in the form it had. Forms whose
    order of day and month can't be told are not read.
    """
    forms = {"-": "yyyy-MM-dd", "/": "yyyy/MM/dd", ".": "dd.MM.yyyy"}
    read = F.coalesce(*[
        F.when(value.contains(sign), F.try_to_timestamp(value, F.lit(form))) for sign, form in forms.items()
    ]).cast("date")

    def moved(day: Column) -> Column:
        year, of_year = F.year(day).cast("long"), F.dayofyear(day).cast("long")
        common = permuted(F.array(year - 1900, of_year - 1), _longs(200, 365), f"{key}|date")
        leap = permuted(F.array(F.floor((year - 1904) / 28), F.pmod(F.floor((year - 1904) / 4), F.lit(7))), _longs(7, 7), f"{key}|leap")
        return F.when(of_year < 366, _let(common, lambda n: F.date_add(F.make_date(n[0] + 1900, F.lit(1), F.lit(1)), n[1].cast("int")))).otherwise(
            _let(leap, lambda n: F.make_date(1904 + 4 * (7 * n[0] + n[1]), F.lit(12), F.lit(31)))
        )

    def written(day: Column) -> Column:
        return F.coalesce(*[F.when(value.contains(sign), F.date_format(day, form)) for sign, form in forms.items()])

    return _let(read, lambda day: F.when(day.isNull(), value).otherwise(_let(moved(day), written)))


def _email(value: Column, key: str) -> Column:
    """Letters and digits before the @ change within their kind; the domain stays. Equal up to case stay linked."""
    name, domain = F.substring_index(F.lower(value), "@", 1), F.substring_index(value, "@", -1)

    def changed(chars: Column) -> Column:
        base = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 48).otherwise(97).cast("long"))
        sizes = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long"))
        codes = F.zip_with(chars, base, lambda c, b: F.ascii(c) - b)
        # A second symbol for names of one character: a network needs two halves.
        moved = permuted(F.concat(codes, _longs(0)), F.concat(sizes, _longs(1)), f"{key}|email|")
        new = F.zip_with(F.slice(moved, F.lit(1), F.size(chars)), base, lambda n, b: F.char(n + b))
        return F.concat(_refilled(name, new, "[0-9a-z]"), F.lit("@"), domain)

    return _let(F.filter(_chars(name), lambda c: c.rlike("[0-9a-z]")), changed)


_MAKERS = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "address": _address, "date": _date}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    kinds = [(F.when(_whole(value, kind), make(value, key))) for kind, make in _MAKERS.items()]
    return F.coalesce(*kinds, value)


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with every valid number, date and address replaced; null stays null."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)
    new = F.transform(found, lambda value: pseudonym(value, key))
    joined = F.array_join(
        F.zip_with(between, new, lambda part, value: F.concat(part, F.coalesce(value, F.lit("")))), ""
    )
    return F.when(text.rlike(HINT), F.when(F.size(found) > 0, joined).otherwise(text)).otherwise(text)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal values of ``text`` pseudonymised; all other columns as they are.

    Card numbers (Luhn), phone numbers (+1), social security numbers, internet addresses, dates and the local parts of
    e-mail addresses are permuted by a keyed Feistel network within their format: equal values have equal pseudonyms
    in all documents, different values of a kind different ones. Whoever has the key can undo it, so it is asked for.

    A null text stays null, an empty one empty; candidates that fail their check (Luhn sum, calendar, ranges) stay, and so
    do phones without +1 and dates as 02/28/2021.
    The lengths of texts stay, but for internet addresses, whose parts may gain or lose a digit. Rows are taken one
    by one, so repeated rows, hot sources and empty tables need nothing special.
    """
    return docs.withColumn("text", pseudonymised(F.col("text"), key))


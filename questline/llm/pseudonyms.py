"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Personal numbers and dates are found by pattern and validated: cards by their check digit, IP
addresses by range, dates by the calendar, telephone numbers by their grouping. A value is read as
symbols, each with its own base, and permuted by Feistel rounds over the two halves, so the
result has the same format and is valid again (cards get their new check digit). Runs of digits that fail
the check are other numbers and stay. The same value
has the same pseudonym in every document, whatever its separators; the key turns it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "rotate-me"       # production passes its own
FIRST_DAY = "1800-01-01"
DAY_BASES = (189, 773)  # fixed values: 400 Gregorian years have 146097 = 189 * 773 days
DAYS = DAY_BASES[0] * DAY_BASES[1]

# One pattern a kind, tried in this order at each position.
PATTERNS = {
    # A local part has 64 characters at most and a domain 127 labels, which also bounds the search at each place.
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
HINT = "[0-9@]"  # every value holds one of these, so texts without them aren't searched


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(symbols: Column, bases: Column, tweak: Column, key: str, undo: bool = False) -> Column:
    """Keyed permutation of an array of integers, symbol i below base i; ``tweak`` sets kinds apart.

    Round by round one half is shifted by a hash of the other, each symbol modulo its base.
    """
    return let(F.struct(symbols.alias("s"), bases.alias("b"), tweak.alias("t")),
               lambda x: _rounds(x["s"], x["b"], x["t"], key, undo))


def _rounds(symbols: Column, bases: Column, tweak: Column, key: str, undo: bool) -> Column:
    half = F.floor((F.size(symbols) + 1) / 2).cast("int")

    def shifted(part: Column, offset: Column, other: Column, number: Column) -> Column:
        told = F.concat_ws("|", F.lit(key), tweak, number.cast("string"), F.array_join(other.cast("array<string>"), ","))
        sign = -1 if undo else 1

        def one(x: Column, i: Column, seed: Column) -> Column:
            step = F.conv(F.substring(F.sha2(F.concat_ws("#", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
            base = F.element_at(bases, offset + i + 1)
            return F.pmod(x + sign * F.pmod(step, base), base).cast("int")

        return let(told, lambda seed: F.transform(part, lambda x, i: one(x, i, seed)))

    def step(state: Column, number: Column) -> Column:
        left, right = state["l"], state["r"]
        odd = number % 2 == 1
        return F.struct(
            F.when(odd, shifted(left, F.lit(0), right, number)).otherwise(left).alias("l"),
            F.when(odd, right).otherwise(shifted(right, half, left, number)).alias("r"),
        )

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(
        F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, F.size(symbols)).alias("r")
    )
    return F.aggregate(order, start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def _numbers(digits: Column) -> Column:
    return F.transform(_characters(digits), lambda c: c.cast("int"))


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Check sum of a digit string; ``shift`` 1 leaves room for a check digit to come."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when((i + shift) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by those of ``digits``."""

    def one(c: Column, i: Column, new: Column) -> Column:
        place = F.length(_digits(F.substr(value, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substr(new, place, F.lit(1))).otherwise(c)

    return let(digits, lambda new: F.array_join(F.transform(_characters(value), lambda c, i: one(c, i, new)), ""))


def _joined(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), "")


def _same(numbers: Column, base: int) -> Column:
    return F.transform(numbers, lambda _: F.lit(base))


def _plain(value: Column, kind: str, key: str, undo: bool) -> Column:
    """All digits permuted."""
    return let(_numbers(_digits(value)), lambda numbers: _refilled(
        value, _joined(feistel(numbers, _same(numbers, 10), F.lit(kind), key, undo))))


def _card(value: Column, key: str, undo: bool) -> Column:
    digits = _digits(value)
    new = let(_numbers(F.substr(digits, F.lit(1), F.length(digits) - 1)),
              lambda body: _joined(feistel(body, _same(body, 10), F.lit("card"), key, undo)))

    def with_check(body: Column) -> Column:
        return F.concat(body, F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string"))

    return F.when(F.pmod(let(digits, lambda d: _luhn_sum(d, 0)), F.lit(10)) == 0,
                  _refilled(value, let(new, with_check))).otherwise(value)


def _phone(value: Column, key: str, undo: bool) -> Column:
    """The last ten digits; first digits of area and exchange stay within 0-1 or 2-9. The country code stays."""

    def changed(digits: Column) -> Column:
        lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
        numbers = _numbers(F.substr(digits, F.length(digits) - 9, F.lit(10)))

        def of(n: Column) -> Column:
            low = F.transform(n, lambda d, i: F.when(i.isin(0, 3) & (d >= 2), 2).otherwise(0))
            bases = F.transform(n, lambda d, i: F.when(~i.isin(0, 3), 10).when(d >= 2, 8).otherwise(2))
            new = feistel(F.zip_with(n, low, lambda d, x: d - x), bases, F.concat(F.lit("phone"), lead), key, undo)
            return F.concat(lead, _joined(F.zip_with(new, low, lambda d, x: d + x)))

        return let(numbers, of)

    return _refilled(value, let(_digits(value), changed))


def _ip(value: Column, key: str, undo: bool) -> Column:

    def of(n: Column) -> Column:
        new = feistel(n, _same(n, 256), F.lit("ip"), key, undo)
        return F.when(~F.exists(n, lambda x: x > 255), F.array_join(new.cast("array<string>"), ".")).otherwise(value)

    return let(F.transform(F.split(value, "[.]"), lambda x: x.cast("int")), of)


def _date(value: Column, key: str, undo: bool) -> Column:
    """Days of 1800 to 2199 are permuted; what is no day of them stays as it is."""

    def moved(day: Column) -> Column:
        numbers = F.array(F.floor(day / DAY_BASES[1]).cast("int"), (day % DAY_BASES[1]).cast("int"))
        new = feistel(numbers, F.array(*[F.lit(b) for b in DAY_BASES]), F.lit("date"), key, undo)
        return let(new, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), (n[0] * DAY_BASES[1] + n[1]).cast("int")))

    def shown(form: str):
        return lambda day: F.when(day.between(0, DAYS - 1), F.date_format(moved(day), form)).otherwise(value)

    out = value
    for mark, form in (("-", "yyyy-MM-dd"), ("[.]", "dd.MM.yyyy"), ("/", "MM/dd/yyyy")):
        out = F.when(value.rlike(mark), let(
            F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")),
            shown(form),
        )).otherwise(out)
    return out


def _email(value: Column, key: str, undo: bool) -> Column:
    """Letters and digits of the local part, each within its class; the domain stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    def changed(kept: Column) -> Column:
        low = F.transform(kept, lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97))

        def of(x: Column) -> Column:
            bases = F.transform(x, lambda b: F.when(b == 48, 10).otherwise(26))
            numbers = F.zip_with(kept, x, lambda c, b: F.ascii(c) - b)
            new = feistel(numbers, bases, F.concat(F.lit("email"), domain), key, undo)
            return F.array_join(F.zip_with(new, x, lambda n, b: F.chr((n + b).cast("long"))), "")

        return let(low, of)

    def one(c: Column, i: Column, new: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(local, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substr(new, place, F.lit(1))).otherwise(c)

    filled = let(_characters(F.regexp_replace(local, "[^A-Za-z0-9]", "")), changed)
    shown = let(filled, lambda new: F.array_join(F.transform(_characters(local), lambda c, i: one(c, i, new)), ""))
    return F.concat(shown, F.lit("@"), domain)


def pseudonym(value: Column, key: str = KEY, undo: bool = False) -> Column:
    """The pseudonym of one found value; the kind follows from its form."""

    def whole(kind: str) -> Column:
        return value.rlike(f"^(?:{PATTERNS[kind]})$")

    return (
        F.when(whole("email"), _email(value, key, undo)).when(whole("ip"), _ip(value, key, undo))
        .when(whole("date"), _date(value, key, undo)).when(whole("phone"), _phone(value, key, undo))
        .when(whole("ssn"), _plain(value, "ssn", key, undo)).otherwise(_card(value, key, undo))
    )


def found_values(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def pseudonymise(text: Column, key: str = KEY, undo: bool = False) -> Column:
    """``text`` with every found value replaced; ``undo`` with the same key brings the original back.

    Null stays null; a text without such values stays as it is.
    """
    between = F.split(text, ANY, -1)
    new = F.transform(found_values(text), lambda m: pseudonym(m, key, undo))
    glued = F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.rlike(HINT), F.array_join(glued, "")).otherwise(text)


def with_pseudonyms(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the text replaced and n_values, how many it held. Every row stays, in one pass.

    Null and empty texts hold none; repeated rows come out alike; other columns stay as they are,
    but for n_values, which is replaced.
    """
    return docs.withColumn("n_values", F.coalesce(F.size(found_values(F.col(text))), F.lit(0))).withColumn(
        text, pseudonymise(F.col(text), key)
    )

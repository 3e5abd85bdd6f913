"""Personal data replaced by keyed pseudonyms of the same format: a Feistel network permutes each kind's own domain.

Equal values get equal pseudonyms in every document, different ones different pseudonyms, and a pseudonym is valid where
the value was: card numbers keep their check digit, dates stay dates, addresses stay addresses.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import let

ROUNDS = 10
LETTERS = string.ascii_lowercase
POWERS_10 = [10**k for k in range(19)]
POWERS_26 = [26**k for k in range(14)]
#: Dates from 1900-01-01 to 2099-12-31; their number is 17 * 4297, so two coordinates cover them exactly.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def prf(key: str, tweak: str, turn: Column, value: Column) -> Column:
    """52 keyed bits of a round and a value."""
    message = F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(message, 256), 1, 13), 16, 10).cast("long")


def quotient(value: Column, by: Column | int) -> Column:
    """Whole numbers divided as such: `/` would go through doubles, which hold 53 bits."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by).cast("long"))


def feistel(value: Column, low: Column | int, high: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers below low * high (longs): rounds add to one coordinate what the other gives."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    low, high = low.cast("long"), high.cast("long")

    def turn(state: Column, number: Column) -> Column:
        left = F.pmod(state["left"] + prf(key, tweak, number, state["right"]), low)
        right = F.pmod(state["right"] + prf(key, tweak, number, state["left"]), high)
        even = number % 2 == 0
        return F.struct(F.when(even, left).otherwise(state["left"]).alias("left"), F.when(even, state["right"]).otherwise(right).alias("right"))

    start = F.struct(quotient(value, high).alias("left"), F.pmod(value, high).alias("right"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, turn, lambda state: state["left"] * high + state["right"])


def power(base: list[int], exponent: Column) -> Column:
    return F.get(F.array(*(F.lit(x).cast("long") for x in base)), exponent.cast("int"))


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Digits (1 to 18 of them) permuted among the numbers with as many digits."""
    size = F.length(digits)
    half = F.ceil(size / 2).cast("int")
    number = feistel(digits.cast("long"), power(POWERS_10, size - half), power(POWERS_10, half), key, tweak)
    return F.lpad(number.cast("string"), size, "0")


def permuted_letters(letters: Column, key: str, tweak: str) -> Column:
    """Letters a to z (1 to 12 of them) permuted among the strings of as many letters."""
    size = F.length(letters)
    half = F.ceil(size / 2).cast("int")
    number = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + (F.ascii(c) - 97).cast("long"))
    found = feistel(number, power(POWERS_26, size - half), power(POWERS_26, half), key, tweak)
    places = F.transform(F.sequence(F.lit(1), size), lambda k: size - k)
    return let(
        found,
        lambda x: F.array_join(F.transform(places, lambda k: F.substring(F.lit(LETTERS), F.pmod(quotient(x, power(POWERS_26, k)), F.lit(26)).cast("int") + 1, F.lit(1))), ""),
    )


def refill(shape: Column, digits: Column) -> Column:
    """The digits of `shape` replaced by `digits`, in order; everything between them stays."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.array_join(F.transform(gaps, lambda gap, k: F.concat(gap, F.substring(digits, k + 1, F.lit(1)))), "")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The sum of a card number's checksum, with the last digit as the check digit."""

    def worth(digit: Column, place: Column) -> Column:
        number = digit.cast("int")
        doubled = F.when(number > 4, number * 2 - 9).otherwise(number * 2)
        return F.when(place % 2 == 1, doubled).otherwise(number)

    worths = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(worths, F.lit(0), lambda acc, x: acc + x)


def _card(value: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        def checked(body: Column) -> Column:
            check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
            return refill(value, F.concat(body, check.cast("string")))

        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return F.when(luhn_sum(digits) % 10 == 0, let(body, checked))

    return let(digits_of(value), replaced)


def _phone(value: Column, key: str) -> Column:
    """The country code (1, or the first two digits) stays, the rest is permuted."""

    def replaced(digits: Column) -> Column:
        fixed = F.when(~value.startswith("+"), 0).when(digits.startswith("1"), 1).otherwise(2)
        rest = F.substring(digits, fixed + 1, F.length(digits))
        return refill(value, F.concat(F.substring(digits, F.lit(1), fixed), permuted_digits(rest, key, "phone")))

    return let(digits_of(value), replaced)


def _social(value: Column, key: str) -> Column:
    """Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999."""

    def replaced(digits: Column) -> Column:
        area = F.substring(digits, 1, 3).cast("long")
        group, serial = F.substring(digits, 4, 2).cast("long"), F.substring(digits, 6, 4).cast("long")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = area - F.when(area > 666, 2).otherwise(1)
        number = feistel(index * 989901 + (group - 1) * 9999 + serial - 1, 898, 989901, key, "social")

        def written(x: Column) -> Column:
            rest = F.pmod(x, F.lit(989901))
            new_index = ((x - rest) / 989901).cast("long")
            new_area = new_index + F.when(new_index >= 665, 2).otherwise(1)
            new_group, new_serial = ((rest - F.pmod(rest, F.lit(9999))) / 9999).cast("long") + 1, F.pmod(rest, F.lit(9999)) + 1
            parts = ((new_area, 3), (new_group, 2), (new_serial, 4))
            return refill(value, F.concat(*(F.lpad(part.cast("string"), size, "0") for part, size in parts)))

        return F.when(valid, let(number, written))

    return let(digits_of(value), replaced)


def _address(value: Column, key: str) -> Column:
    def replaced(parts: Column) -> Column:
        number = lambda k: F.get(parts, F.lit(k)).cast("long")
        valid = F.forall(parts, lambda p: p.cast("long") <= 255)
        whole = ((number(0) * 256 + number(1)) * 256 + number(2)) * 256 + number(3)

        def written(x: Column) -> Column:
            return F.concat_ws(".", *(F.shiftright(x, 24 - 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in range(4)))

        return F.when(valid, let(feistel(whole, 65536, 65536, key, "address"), written))

    return let(F.split(value, "\\."), replaced)


def _date(value: Column, key: str) -> Column:
    """Year first, day first with dots, month first with slashes (day first where there is no such month)."""

    def replaced(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        year_first = value.rlike("^[0-9]{4}")
        month_first = ~year_first & F.contains(value, F.lit("/")) & (part(0).cast("int") <= 12)
        dated = lambda *order: F.try_to_date(F.concat_ws("-", *(part(k) for k in order)), "yyyy-MM-dd")
        date = F.when(year_first, dated(0, 1, 2)).when(month_first, dated(2, 0, 1)).otherwise(dated(2, 1, 0))
        day = F.datediff(date, F.to_date(F.lit(FIRST_DAY))).cast("long")
        moved = feistel(day, *DAYS, key, "date")

        def written(x: Column) -> Column:
            new = F.date_add(F.to_date(F.lit(FIRST_DAY)), x.cast("int"))
            mark = F.regexp_extract(value, "[^0-9]", 0)
            fields = [F.date_format(new, form) for form in ("yyyy", "MM", "dd")]
            orders = ((year_first, (0, 1, 2)), (month_first, (1, 2, 0)))
            text = F.when(F.lit(False), F.lit(""))
            for case, order in orders:
                text = text.when(case, F.concat_ws("\u0001", *(fields[k] for k in order)))
            return F.replace(text.otherwise(F.concat_ws("\u0001", *(fields[k] for k in (2, 1, 0)))), F.lit("\u0001"), mark)

        return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), let(moved, written))

    return let(F.split(value, "[^0-9]"), replaced)


def _email(value: Column, key: str) -> Column:
    """Runs of letters and of digits before the `@` are permuted among runs of their length; the domain stays."""

    def moved(run: Column) -> Column:
        return F.when(run.rlike("^[a-z]"), permuted_letters(run, key, "email")).when(run.rlike("^[0-9]"), permuted_digits(run, key, "email")).otherwise(run)

    local = F.lower(F.substring_index(value, "@", 1))
    runs = F.regexp_extract_all(local, F.lit("[a-z]{1,12}|[0-9]{1,18}|[^a-z0-9]+"), F.lit(0))
    return F.concat(F.array_join(F.transform(runs, moved), ""), F.lit("@"), F.substring_index(value, "@", -1))


@dataclass(frozen=True)
class Kind:
    """`shape` finds candidates (at its place in the list of kinds); `whole` tells them from those of other kinds."""

    name: str
    shape: str
    whole: str
    replace: Callable[[Column, str], Column]


CARD = "[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}"
DIGIT_EDGE = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
KINDS = (
    Kind("email", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}", "@", _email),
    Kind("address", "(?<![0-9A-Za-z.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\\.[0-9])", "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$", _address),
    Kind("date", f"{DIGIT_EDGE[0]}(?:[0-9]{{4}}([-/.])[0-9]{{2}}\\1[0-9]{{2}}|[0-9]{{2}}([-/.])[0-9]{{2}}\\2[0-9]{{4}}){DIGIT_EDGE[1]}", "^[0-9]{4}([-/.])[0-9]{2}\\1[0-9]{2}$|^[0-9]{2}([-/.])[0-9]{2}\\2[0-9]{4}$", _date),
    Kind("social", f"{DIGIT_EDGE[0]}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{DIGIT_EDGE[1]}", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _social),
    Kind("card", f"{DIGIT_EDGE[0]}(?:{CARD}){DIGIT_EDGE[1]}", f"^({CARD})$", _card),
    Kind("phone", f"(?:\\+[0-9]{{1,3}}[ .-]?)?(?:\\([0-9]{{3}}\\) ?|{DIGIT_EDGE[0]}[0-9]{{3}}[.-])[0-9]{{3}}[ .-][0-9]{{4}}{DIGIT_EDGE[1]}", "^(\\+[0-9]{1,3}[ .-]?)?(\\([0-9]{3}\\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$", _phone),
    Kind("phone", f"(?<![0-9A-Za-z+])\\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,4}}{DIGIT_EDGE[1]}", "^\\+", _phone),
)


def pseudonym(value: Column, key: str) -> Column:
    """A struct of kind and pseudonym of a candidate; null where it isn't valid (and so stays as it is)."""
    found = F.when(F.lit(False), F.lit(None).cast("struct<kind:string,text:string>"))
    for kind in KINDS:
        found = found.when(value.rlike(kind.whole), let(kind.replace(value, key), _named(kind.name)))
    return found


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def with_pseudonyms(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, and how many values of each kind were replaced.

    Emails, IPv4 addresses, dates from 1900 to 2099, social security numbers, card numbers with a right check digit and
    phone numbers are replaced in the whole text; candidates that aren't valid, and all other text, stay. A null text
    stays null and an empty one empty; repeated rows are treated alike; other columns are not read. The key is a
    secret: who has it can undo the pseudonyms.
    """
    shapes = "|".join(_numbered(kind.shape, place) for place, kind in enumerate(KINDS))

    def parts(body: Column) -> Column:
        found = F.regexp_extract_all(body, F.lit(shapes), F.lit(0))
        moved = let(found, lambda values: F.transform(values, lambda v: let(pseudonym(v, key), lambda p: F.struct(v.alias("given"), p.alias("made")))))
        gaps = F.split(body, shapes, -1)

        def joined(values: Column) -> Column:
            new = F.transform(values, lambda v: F.coalesce(v["made"]["text"], v["given"]))
            text = F.array_join(F.transform(gaps, lambda gap, k: F.concat(gap, F.coalesce(F.get(new, k), F.lit("")))), "")
            return F.struct(text.alias("text"), F.transform(values, lambda v: v["made"]["kind"]).alias("kinds"))

        return let(moved, joined)

    body = F.col(text)
    none = F.struct(body.alias("text"), F.array().cast("array<string>").alias("kinds"))
    # a value of any kind has a digit or an @
    replaced = F.when(body.rlike("[0-9@]") & body.rlike(shapes), let(body, parts)).otherwise(none)
    rows = docs.select(F.col(doc_id).alias("doc_id"), replaced.alias("r"))
    names = dict.fromkeys(kind.name for kind in KINDS)
    counts = [F.size(F.array_compact(F.transform("r.kinds", _is(n)))).cast("long").alias(f"n_{n}") for n in names]
    return rows.select("doc_id", F.col("r.text").alias("text"), *counts)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda found: F.when(found == kind, F.lit(True))


def _numbered(shape: str, place: int) -> str:
    """The shape with named groups in place of numbered ones, so that shapes can be joined."""
    for number in (1, 2):
        name = f"g{place}x{number}"
        shape = shape.replace("([-/.])", f"(?<{name}>[-/.])", 1).replace(f"\\{number}", f"\\k<{name}>")
    return shape

"""Money, quantity and number expressions (T12-T17, T23, T25, T27, P8 helpers, V4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staged import let

GSTIN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def money_to_cents(value: Column) -> Column:
    """Strict money to cents, null where the form is wrong."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(value), "(?i)^Rs\\.?\\s*", ""), "[₹,\\s]", "")
    cents = F.regexp_extract(plain, "^([0-9]+)", 1).try_cast("long") * 100 + F.rpad(F.regexp_extract(plain, "\\.([0-9]{1,2})$", 1), 2, "0").try_cast("long")
    return F.when(plain.rlike("^[0-9]+(?:\\.[0-9]{1,2})?$"), cents)


def quantity_to_thousandths(value: Column) -> Column:
    """Strict quantity to thousandths, null where the form is wrong."""
    plain = F.regexp_replace(F.trim(value), ",", "")
    thousandths = F.regexp_extract(plain, "^([0-9]+)", 1).try_cast("long") * 1000 + F.rpad(F.regexp_extract(plain, "\\.([0-9]{1,3})$", 1), 3, "0").try_cast("long")
    return F.when(plain.rlike("^[0-9]+(?:\\.[0-9]{1,3})?$"), thousandths)


def last_money_to_cents(text: Column) -> Column:
    """Cents of the last money token of a noisy text."""
    tokens = F.regexp_extract_all(text, F.lit("([0-9][0-9,]*\\.[0-9]{2})(?![0-9])"))
    return money_to_cents(F.try_element_at(tokens, F.lit(-1)))


def gstins(text: Column) -> Column:
    """Distinct GSTINs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[0-9])(?<![A-Za-z0-9_])({GSTIN})(?![A-Za-z0-9_])")))


def gstin_check_digit(head: Column) -> Column:
    """Check character of the first 14 characters, factors 1 and 2 from the left.

    ``head`` is computed once. A character's place in the string of its factor is what it adds, digits to base 36 summed.
    """
    doubled = "".join(c for _, c in sorted((2 * v // 36 + 2 * v % 36, c) for v, c in enumerate(BASE36)))
    adds = lambda h: sum((F.instr(F.lit(BASE36 if i % 2 else doubled), F.substring(h, i, 1)) - 1 for i in range(2, 15)), F.instr(F.lit(BASE36), F.substring(h, 1, 1)) - 1)
    return let(let(head, adds), lambda total: F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1)))


def gstin_valid(value: Column) -> Column:
    """Form and check digit hold."""
    return let(F.upper(F.trim(value)), lambda up: F.coalesce(up.rlike(f"^{GSTIN}$") & (F.substring(up, 15, 1) == gstin_check_digit(up)), F.lit(False)))


def gstin_state(value: Column) -> Column:
    """State code of a well-formed GSTIN."""
    return F.when(value.rlike(f"^{GSTIN}$"), F.substring(value, 1, 2))


def make_gstin(state: Column, key: Column, entity: int = 1) -> Column:
    """A GSTIN with a right check digit, letters and digits from ``key``; ``entity`` is its 13th character."""
    letters = F.concat(*[F.char(65 + F.pmod(F.floor(key / F.lit(26**i)), F.lit(26))) for i in range(5)])
    head = F.concat(F.lpad(state.cast("string"), 2, "0"), letters, F.lpad(F.pmod(key, F.lit(10000)).cast("string"), 4, "0"), F.char(65 + F.pmod(key, F.lit(26))), F.lit(f"{entity}Z"))
    return let(head, lambda h: F.concat(h, gstin_check_digit(h)))


def format_number(cents: Column) -> Column:
    """Rupees with Indian digit groups and two decimals, of cents that are not negative."""
    whole = F.expr("1").cast("long") * F.floor(cents / 100)
    text = whole.cast("string")
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - 3), "([0-9])(?=([0-9][0-9])+$)", "$1,")
    # Most amounts have at most one comma before the last three digits and need no pattern.
    end, two = F.concat(F.lit(","), F.substring(text, -3, 3)), F.concat(F.lit(","), F.substring(text, -5, 2))
    short = F.length(text)
    grouped = F.when(short <= 3, text).when(short <= 5, F.concat(F.substring(text, F.lit(1), short - 3), end)).when(short <= 7, F.concat(F.substring(text, F.lit(1), short - 5), two, end)).otherwise(F.concat(head, end))
    return F.concat(grouped, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def format_quantity(thousandths: Column) -> Column:
    """A quantity without needless zeros."""
    decimals = F.regexp_replace(F.concat(F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0")), "\\.?0+$", "")
    return F.concat(F.floor(thousandths / 1000).cast("string"), decimals)


def bucket(value: Column, limits: list[float], names: list[str]) -> Column:
    """Name of the first limit above ``value``, else the last name."""
    found = F
    for limit, name in zip(limits, names):
        found = found.when(value < F.lit(limit), name)
    return found.otherwise(names[-1])


# Limits and names of the bucketings.
BUCKETS = {
    "page_right": ([0.3, 0.55, 0.75, 0.9], ["left", "mid", "right", "far_right", "edge"]),
    "page_left": ([0.15, 0.35, 0.55, 0.75], ["left_edge", "left", "middle", "right", "far_right"]),
    "page_vertical": ([0.18, 0.5, 0.82], ["top", "upper_mid", "lower_mid", "bottom"]),
    "gap": ([0.03, 0.08, 0.16], ["tight", "near", "wide", "far"]),
    "width": ([0.05, 0.1, 0.18], ["compact", "medium", "wide", "very_wide"]),
    "line_position": ([0.33, 0.66], ["top", "middle", "bottom"]),
    "word_count": ([4, 9, 17], ["short", "medium", "long", "very_long"]),
    "amount": ([100_000, 1_000_000, 10_000_000, 100_000_000], ["tiny", "small", "medium", "large", "huge"]),
}


def named_bucket(kind: str, value: Column) -> Column:
    return bucket(value, *BUCKETS[kind])


# Indian number words.
NUMBER_WORDS = {w: i for i, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBER_SCALES = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}


def number_words(text: Column) -> Column:
    """An amount in words in hundredths: rupees, and paise after ``and paise`` or before ``paise``; other words are skipped."""
    low = F.lower(text)
    behind = "^(.*?)\\band\\s+paise\\b(.*)$"
    before = "^(.*)\\band\\s+(.*?)\\s+paise\\b.*$"
    form = F.when(low.rlike(behind), 1).when(low.rlike(before), 2).otherwise(0)
    main = F.when(form == 1, F.regexp_extract(low, behind, 1)).when(form == 2, F.regexp_extract(low, before, 1)).otherwise(low)
    paise = F.when(form == 1, F.regexp_extract(low, behind, 2)).when(form == 2, F.regexp_extract(low, before, 2)).otherwise("")
    return _whole_words(main) * 100 + _whole_words(paise)


def _whole_words(text: Column) -> Column:
    words = F.filter(F.split(text, "[^a-z]+"), lambda w: w != "")
    small = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    scales = F.create_map(*[F.lit(x) for w, n in NUMBER_SCALES.items() for x in (w, n)])

    def step(state: Column, word: Column) -> Column:
        value, scale = F.try_element_at(small, word), F.try_element_at(scales, word)
        total, current = state.total, state.current
        return F.struct(
            F.when(scale.isNotNull(), total + F.greatest(current, F.lit(1).cast("long")) * scale).otherwise(total).cast("long").alias("total"),
            F.when(scale.isNotNull(), 0).when(word == "hundred", F.greatest(current, F.lit(1).cast("long")) * 100).when(value.isNotNull(), current + value).otherwise(current).cast("long").alias("current"),
        )

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("current"))
    return F.aggregate(words, start, step, lambda s: s.total + s.current)


def in_words(number: Column) -> Column:
    """A whole number below 1,000 crores in words, with Indian scales; the inverse of :func:`number_words` but for paise."""
    small = F.array(*[F.lit(w) for w in list(NUMBER_WORDS)[:20]])
    tens = F.array(*[F.lit(w) for w in ["", "", *list(NUMBER_WORDS)[20:]]])
    at = lambda names, n: F.get(names, n.cast("int"))

    def below_hundred(n: Column) -> Column:
        unit = F.when(n % 10 > 0, at(small, n % 10))
        return F.when(n == 0, F.lit(None)).when(n < 20, at(small, n)).otherwise(F.concat_ws(" ", at(tens, F.floor(n / 10)), unit))

    parts = [
        *[F.when(n > 0, F.concat_ws(" ", below_hundred(n), F.lit(name))) for n, name in (
            (F.floor(number / 10_000_000), "crore"), (F.floor(number / 100_000) % 100, "lakh"), (F.floor(number / 1_000) % 100, "thousand"), (F.floor(number / 100) % 10, "hundred"),
        )],
        below_hundred(number % 100),
    ]
    return F.when(number == 0, "zero").otherwise(F.concat_ws(" ", *parts))

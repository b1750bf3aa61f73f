"""Numbers in text as column expressions: parsing, tolerance, extraction and provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and words that must be read alike everywhere, in the order in which they are tried.
CURRENCY_SYMBOLS = (("$", "usd"), ("€", "eur"), ("£", "gbp"), ("¥", "jpy"), ("₽", "rub"))
CURRENCY_CODE = r"(?iuU)\b(usd|eur|gbp|jpy|rub|cny)\b"
BASIS_POINTS = r"(?iuU)\b(bps|basis\s+points?)\b"
PERCENTAGE_POINT = r"(?iuU)\b(percentage\s+points?|p\.?p\.?)\b"
SCALE_SUFFIX = r"(?i)(thousands?|millions?|mm|billions?|bn|k|m|b)\s*$"
NUMBER_TOKEN = r"\(?-?\$?\s*\d[\d,]*\.?\d*\s*\)?%?"
TRIVIAL_NUMBERS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 100.0)
SCALE_FACTORS = (1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9, 0.01, 100.0)
RELATIVE_TOLERANCE = 0.001

_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"

#: A letter, or anything beyond ASCII, which may be one.
_WORDY = r"[A-Za-z\x{80}-\x{10FFFF}]"
#: In a text of ASCII alone, a word that is no part of a stated number: neither a currency, unit or scale nor an exponent.
_OTHER_WORD = r"(?s)^(?=\p{ASCII}*$).*?(?<![A-Za-z])(?!(?i:usd|eur|gbp|jpy|rub|cny|bps|basis|points?|percentage|pp?|thousands?|millions?|mm|billions?|bn|k|m|b|e)(?![A-Za-z]))[A-Za-z]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def to_float(x: Column) -> Column:
    """A double where the text is a number as a programming language writes it; else null."""
    return F.when(x.rlike(_FLOAT), F.regexp_replace(x, "_", "").try_cast("double"))


def _cut(text: Column, pattern: str) -> Column:
    """The text without the first match."""
    found = F.regexp_extract(text, pattern, 0)
    at = F.instr(text, found)
    return F.when(found == "", text).otherwise(strip(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text)))))


def parse_number(text: Column, locale: str = "en") -> Column:
    """A struct of a stated number, or null if there is none.

    Fields: ``value`` (scale multiplied in), ``raw``, ``scale`` (factor), ``unit``, ``currency``, ``is_percentage``,
    ``is_basis_points``. Parentheses or a minus make it negative; a percent sign is a unit and divides nothing.
    """
    if locale not in ("en", "eu"):
        raise ValueError(f"locale {locale!r}: neither 'en' nor 'eu'")

    def signed(trimmed: Column) -> Column:
        wrapped = trimmed.rlike(r"(?s)^\(.*\)$") & (F.length(trimmed) > 1)
        inner = F.when(wrapped, strip(F.substring(trimmed, F.lit(2), F.length(trimmed) - 2))).otherwise(trimmed)
        return let(F.struct(inner.alias("t"), wrapped.alias("neg")), lambda s: F.struct(strip(F.regexp_replace(s["t"], r"^[+-]", "")).alias("t"), (s["neg"] | s["t"].startswith("-")).alias("neg")))

    def units(s: Column) -> Column:
        wordy = s["t"].rlike(_WORDY)  # without letters there is no unit, code or scale to look for
        bps = wordy & s["t"].rlike(BASIS_POINTS)
        one = F.when(bps, _cut(s["t"], BASIS_POINTS)).otherwise(s["t"])
        return let(
            F.struct(one.alias("t"), s["neg"].alias("neg"), bps.alias("bps"), wordy.alias("wordy")),
            lambda u: let(
                F.struct(F.when(u["wordy"] & ~u["bps"], _cut(u["t"], PERCENTAGE_POINT)).otherwise(u["t"]).alias("t"), u["neg"].alias("neg"), u["bps"].alias("bps"), (u["wordy"] & ~u["bps"] & u["t"].rlike(PERCENTAGE_POINT)).alias("pp"), u["wordy"].alias("wordy")),
                lambda v: F.struct(strip(F.replace(v["t"], F.lit("%"), F.lit(""))).alias("t"), v["neg"].alias("neg"), v["bps"].alias("bps"), v["pp"].alias("pp"), v["t"].contains("%").alias("pct"), v["wordy"].alias("wordy")),
            ),
        )

    def currency(s: Column) -> Column:
        which = F.coalesce(*(F.when(s["t"].contains(sign), F.lit(sign)) for sign, _ in CURRENCY_SYMBOLS))
        coded = F.when(s["wordy"] & s["t"].rlike(CURRENCY_CODE), F.lower(F.regexp_extract(s["t"], CURRENCY_CODE, 1)))
        name = F.coalesce(*(F.when(s["t"].contains(sign), F.lit(code)) for sign, code in CURRENCY_SYMBOLS), coded)
        rest = F.when(which.isNotNull(), strip(F.replace(s["t"], which, F.lit("")))).when(s["wordy"], _cut(s["t"], CURRENCY_CODE)).otherwise(s["t"])
        return F.struct(rest.alias("t"), name.alias("currency"), s["neg"].alias("neg"), s["bps"].alias("bps"), s["pp"].alias("pp"), s["pct"].alias("pct"), s["wordy"].alias("wordy"))

    def value(s: Column) -> Column:
        word = F.when(s["wordy"], F.lower(F.regexp_extract(s["t"], SCALE_SUFFIX, 1))).otherwise("")
        scale = F.when(word == "", 1.0).when(word.startswith("t") | (word == "k"), 1e3).when(word.startswith("m"), 1e6).otherwise(1e9)
        number = F.when(s["wordy"], strip(F.regexp_replace(s["t"], SCALE_SUFFIX, ""))).otherwise(strip(s["t"]))
        clean = F.regexp_replace(number, "[, ]", "") if locale == "en" else F.replace(F.regexp_replace(number, "[. ]", ""), F.lit(","), F.lit("."))
        raw = to_float(clean)
        return let(F.struct(F.when(s["neg"], -F.abs(raw)).otherwise(raw).alias("raw"), scale.alias("scale")), lambda v: F.when(
            v["raw"].isNotNull(),
            F.struct(
                (v["raw"] * v["scale"]).alias("value"), v["raw"].alias("raw"), v["scale"].alias("scale"),
                F.when(s["bps"], "basis_points").when(s["pp"], "percentage_point").when(s["pct"], "percent").otherwise(s["currency"]).alias("unit"),
                s["currency"].alias("currency"), s["pct"].alias("is_percentage"), s["bps"].alias("is_basis_points"),
            ),
        ))

    def read(t: Column) -> Column:
        return let(signed(t), lambda a: let(units(a), lambda b: let(currency(b), value)))

    # other words stay in what would have to be a number, so such a text is none
    return let(strip(text), lambda t: F.when(~t.rlike(_OTHER_WORD), read(t)))


def numeric_match(predicted: Column, gold: Column, relative: float | None = None, absolute: float | None = None) -> Column:
    """Equal, or within the absolute or the relative tolerance; the relative one does not apply to a gold of 0."""
    out = predicted == gold
    if absolute is not None:
        out = out | (F.abs(predicted - gold) <= absolute)
    if relative is not None:
        out = out | ((gold != 0) & (F.try_divide(F.abs(predicted - gold), F.abs(gold)) <= relative))
    return out


def token_value(token: Column) -> Column:
    """The value of a number token, as ``parse_number`` reads it; null where parentheses do not enclose all of it."""
    plain = strip(token)
    wrapped = F.startswith(plain, F.lit("(")) & F.endswith(plain, F.lit(")"))
    value = F.regexp_replace(plain, "[^0-9.]", "").try_cast("double")
    return F.when(wrapped | ~plain.rlike("[()]"), F.when(wrapped | F.contains(plain, F.lit("-")), -value).otherwise(value))


def numbers_in(text: Column) -> Column:
    """All numbers that a text states, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_TOKEN), F.lit(0))
    return F.filter(F.transform(found, token_value), lambda v: v.isNotNull())


def leading_digits(value: Column, n: int = 3) -> Column:
    """The first n significant digits of a number, of ten that are read, as a number; 0 for 0."""
    size = F.abs(value)
    mantissa = size / F.pow(F.lit(10.0), F.floor(F.log10(size)))
    return F.when(size > 0, F.floor(mantissa * 10.0 ** (n - 1) + 5 * 10.0 ** (n - 12))).otherwise(0)


def first_at(ordered: Column, below: Callable[[Column], Column]) -> Column:
    """The place, from 0, of the first element of a sorted array that is not ``below``, found by halving; the array's size if all are.

    :param below: true of a beginning of the array and of nothing after it.
    """

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        return F.when(s["low"] >= s["high"], s).when(below(F.get(ordered, middle)), right).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int")))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halve)["low"]


def is_among(value: Column, ordered: Column, tolerance: Callable[[Column], Column]) -> Column:
    """Whether a sorted array of doubles has a number within the ``tolerance`` at that number, which grows slower than the numbers do."""
    at = first_at(ordered, lambda y: value - y > tolerance(y))
    return let(F.get(ordered, at), lambda y: F.coalesce(F.abs(value - y) <= tolerance(y), F.lit(False)))


def evidence_index(evidence: Column) -> Column:
    """Evidence made ready for ``supported_by``: ``sizes``, the numbers at all reporting scales without their signs, sorted; ``digits``, the
    different leading digits, at most 900, which no scale changes."""
    factors = F.array(*(F.lit(f) for f in SCALE_FACTORS))
    known = F.filter(F.transform(evidence, F.abs), lambda c: c > 0)

    def made(sizes: Column) -> Column:
        scaled = F.flatten(F.transform(sizes, lambda c: F.transform(factors, lambda f: c * f)))
        return F.struct(F.sort_array(F.filter(F.array_distinct(scaled), lambda y: y > 0)).alias("sizes"), F.array_distinct(F.transform(sizes, lambda c: leading_digits(c))).alias("digits"))

    return let(known, made)


def supported_by(value: Column, index: Column) -> Column:
    """Whether a number is trivial, or some number of the indexed evidence, at some reporting scale and with either sign, lies
    within 0.1 % or has the same three leading digits: one search by halving and one look at the digits, whatever the evidence."""

    def among(stated: Column) -> Column:
        near = is_among(stated["size"], index["sizes"], lambda y: RELATIVE_TOLERANCE * F.greatest(y, F.lit(1e-9)))
        return stated["size"].isin(*TRIVIAL_NUMBERS) | ((stated["digits"] > 0) & F.array_contains(index["digits"], stated["digits"])) | near

    return let(F.struct(F.abs(value).alias("size"), leading_digits(value).alias("digits")), lambda s: F.when(s["size"].isNotNull(), among(s)))


def is_supported(value: Column, evidence: Column) -> Column:
    """``supported_by`` for a single number; null evidence supports only trivial numbers."""
    return let(evidence_index(F.coalesce(evidence, F.array().cast("array<double>"))), lambda index: supported_by(value, index))


def is_incidental(value: Column) -> Column:
    """A year, or a number of at most 12."""
    whole = value == F.floor(value)
    return (whole & (value >= 1900) & (value <= 2099)) | (F.abs(value) <= 12)


def cell_decimal(cell: Column) -> Column:
    """The number of a table cell: thousands separators, dollar signs and enclosing parentheses do not count."""
    plain = F.trim(F.regexp_replace(cell, "[,$]", ""))
    inner = F.when(plain.rlike(r"^\(.*\)$"), F.regexp_replace(plain, r"^\(+|\)+$", "")).otherwise(plain)
    return F.when(inner.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), inner.try_cast("decimal(38,6)"))

"""Text predicates and small text tools as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions.numbers import let, strip

# Phrases of refusal, hedging and direction, in English and Russian.
REFUSAL_PATTERNS = (
    r"\bcannot\s+(?:be\s+)?(?:determine|calculat|comput|answer|convert|provid)",
    r"\bcan(?:'|no)?t\s+(?:be\s+)?(?:determine|calculat|comput|answer|convert)",
    r"\bunable\s+to\s+(?:determine|calculat|comput|answer|convert)",
    r"\b(?:do(?:es)?\s+not|don'?t)\s+(?:contain|include|have|provide|support)\b",
    r"\bno\s+(?:data|information|entries|record|exchange\s+rate|rate)\b.{0,40}\b(?:available|provided|given|found)?",
    r"\binsufficient\s+(?:data|information)\b",
    r"\bnot\s+(?:enough|sufficient)\s+(?:data|information)\b",
    r"\bnot\s+(?:possible|available|determinable)\b",
    r"\bdata\s+does\s+not\s+support\b",
    r"\bthere\s+is\s+no\s+(?:information|data|way\s+to)\b",
    r"\bbeyond\s+the\s+(?:period|data|scope)\b",
    r"\bневозможно\b",
    r"\bне\s+(?:содержат|содержит|позволяют|позволяет|хватает)\b",
    r"\bнет\s+(?:данных|информации|курса)\b",
    r"\bнедостаточно\s+(?:данных|информации)\b",
    r"\bданные\s+не\s+позволяют\b",
    r"\bне\s+могу\s+(?:определить|рассчитать|ответить)\b",
)
HEDGE_PATTERN = (
    r"\b(?:however|but|although|nevertheless|estimat|assum|approximat|roughly|based on trend)"
    r"|\b(?:однако|но\b|примерно|около|приблизительно|оценочно|предположительно|исходя\s+из)"
)
UP_WORDS = r"\b(increase[sd]?|increasing|rose|rise|rising|grew|growth|grow|higher|improve[sd]?|up|stronger|expand(?:ed|ing)?|gain(?:ed|s)?)\b"
DOWN_WORDS = r"\b(decrease[sd]?|decreasing|fell|fall(?:ing)?|declin(?:e|ed|ing)|dropp?(?:ed)?|lower|worsen(?:ed)?|down|weaker|contract(?:ed|ing)?|shrank|shrunk|reduc(?:e|ed|tion))\b"
STOPWORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "for", "on", "at", "by", "is", "are", "was", "were", "be", "been", "as", "that", "this", "it", "its", "with", "from", "we")

_FLAGS = "(?iuU)"
#: A letter, or anything beyond ASCII; without one a text has no phrase of refusal and no hedge.
_WORDED = r"[A-Za-z\x{80}-\x{10FFFF}]"


def states_substantive_number(text: Column) -> Column:
    """Whether a text states a figure that a reader would act on: four digits or more, or above 100, and no year."""

    def substantive(token: Column) -> Column:
        clean = F.replace(F.regexp_replace(token, r"\.+$", ""), F.lit(","), F.lit(""))
        digits = F.length(F.regexp_replace(clean, r"^-+|\.", ""))
        return ~clean.rlike(r"^(19|20)\d{2}$") & ((digits >= 4) | (F.abs(clean.try_cast("double")) > 100))

    return F.coalesce(F.exists(F.regexp_extract_all(text, F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0)), substantive), F.lit(False))


def says_no(text: Column) -> Column:
    """Whether a text has a phrase of refusal."""
    return text.rlike(_WORDED) & text.rlike(_FLAGS + "|".join(f"(?:{p})" for p in REFUSAL_PATTERNS))


def hedges(text: Column) -> Column:
    return text.rlike(_WORDED) & text.rlike(_FLAGS + HEDGE_PATTERN)


def looks_like_refusal(text: Column) -> Column:
    """A phrase of refusal, unless a hedge and a figure of four digits follow it anywhere."""
    figures = F.exists(F.regexp_extract_all(text, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)), lambda n: F.length(F.regexp_replace(n, "[,.]", "")) >= 4)
    return says_no(text) & ~(hedges(text) & figures)


def refusal_outcome(answer: Column, explanation: Column, number: Column, flag: Column, exists: Column) -> Column:
    """What a response did: no_answer, flagged_but_answered, hedged_then_answered, answered or refused.

    A figure counts as an answer whatever else is said; then the flag counts, then the words.
    """

    def of(text: Column) -> Column:
        flagged = F.coalesce(flag, F.lit(False))
        return let(number.isNotNull() | states_substantive_number(text), lambda figure: outcome(text, flagged, figure))

    def outcome(text: Column, flagged: Column, figure: Column) -> Column:
        return (
            F.when(~exists | ((text == "") & number.isNull() & ~flagged), "no_answer")
            .when(figure & flagged, "flagged_but_answered")
            .when(figure & hedges(text) & says_no(text), "hedged_then_answered")
            .when(figure, "answered")
            .when(flagged | looks_like_refusal(text), "refused")
            .otherwise("answered")
        )

    return let(strip(F.concat(F.coalesce(answer, F.lit("")), F.lit(" "), F.coalesce(explanation, F.lit("")))), of)


def direction(text: Column) -> Column:
    """up or down, where a text says one and not the other; else null."""
    up, down = text.rlike(_FLAGS + UP_WORDS), text.rlike(_FLAGS + DOWN_WORDS)
    return F.when(up & ~down, "up").when(down & ~up, "down")


def tokenize(text: Column) -> Column:
    """Lower-case words and numbers without stopwords, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+|\d[\d,.]*"), F.lit(0))
    clean = F.transform(found, lambda t: F.when(t < "a", F.replace(F.rtrim(t, F.lit(".,")), F.lit(","), F.lit(""))).otherwise(t))
    return F.filter(clean, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def program_operands(program: Column) -> Column:
    """The numbers that a program states, as an array; references to steps and constants are none."""
    plain = F.regexp_replace(F.regexp_replace(program, r"const_[\d_]+", ""), r"#\d+", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![#\w.])(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def matching_lines(text: Column, query: Column, most: int = 20) -> Column:
    """The first lines that contain a query, whatever the case."""
    needle = F.lower(strip(query))
    hits = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: F.contains(F.lower(line), needle))
    return F.when(needle != "", F.slice(hits, 1, most))


def table_lookup(rows: Column, query: Column, most: int = 10) -> Column:
    """The first rows of a grid with a query in one of their first two cells."""
    needle = F.lower(strip(query))
    return F.when(needle != "", F.slice(F.filter(rows, lambda r: F.exists(F.slice(r, 1, 2), lambda c: F.contains(F.lower(c), needle))), 1, most))


def parse_answer(content: Column) -> Column:
    """The answer envelope of a model's raw output.

    A fenced JSON object counts first, then the text from the first brace to the last; where neither reads as an
    object with an answer, the whole text is the answer. Empty output gives null.
    """
    schema = "answer string, numeric_value double, unit string, period string, insufficient_information boolean, confidence double, brief_explanation string"
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(fenced != "", fenced).otherwise(braces), schema)

    def fill(p: Column) -> Column:
        whole = F.struct(
            F.coalesce(p["answer"], strip(content)).alias("answer"), p["numeric_value"].alias("numeric_value"), p["unit"].alias("unit"), p["period"].alias("period"),
            F.coalesce(p["insufficient_information"], F.lit(False)).alias("insufficient_information"), p["confidence"].alias("confidence"), p["brief_explanation"].alias("brief_explanation"),
        )
        return F.when(strip(F.coalesce(content, F.lit(""))) != "", whole)

    return let(parsed, fill)

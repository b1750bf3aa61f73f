"""Documents with everything that goes wrong, and some prose."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in house river stone green walk under light cold paper".split(), "de": "der die und zu haus fluss stein grün gehen unter licht kalt papier nicht".split()}


def prose(draw: random.Random, lang: str, n: int) -> str:
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows: prose of two languages, then null and empty texts, ids and sources, ties, repeats and a long text."""
    draw = random.Random(3)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        t = prose(draw, lang, draw.randint(5, 60))
        rows.append((i, t, lang, f"s{i % 4}", len(t)))
    long_text = prose(draw, "en", 30_000)
    rows += [
        (60, None, "en", "s0", None), (61, "", None, "s1", 0), (62, " \t\n ", "de", None, 4), (None, "the river", "en", "s2", 9), (63, rows[0][1], "de", "s0", rows[0][4]), (63, rows[0][1], "de", "s0", rows[0][4]),
        (64, long_text, "en", "s3", len(long_text)), (65, "12 34 !!", None, None, 8), (66, "x", "en", "s1", 1), (67, "naïve café 😀 \U00010437", "en", "s1", 14),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark: SparkSession, corpus) -> DataFrame:
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs: DataFrame) -> DataFrame:
    """The documents with more columns, whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("toxicity", "lang_pred", "mix_size", "mix_part", "kept_id", "part", "fp", "label", "component_id", "score", "bucket", "MIX_key", "identified_rejected", "toxic_score")
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)

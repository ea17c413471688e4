"""Small tables with the cases that every operator must survive."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows and ids."""
    long = prose(1, 6000)
    near = prose(2, 300)
    made = [
        (1, prose(3, 60), "en", "a", 10),
        (2, prose(3, 60), "en", "a", 10),
        (3, near, "en", "b", None),
        (4, near.replace("alpha", "ALPHA", 1), "en", None, 10),
        (5, near + " omega", None, "b", 10),
        (6, None, "en", "a", 10),
        (7, "", "de", "c", 0),
        (8, " \t\n ", "de", "c", 3),
        (9, "one", "de", "c", 3),
        (10, "one two", "de", "c", 3),
        (11, long, "en", "a", 10),
        (12, long[:30000] + " " + prose(4, 50), "en", "a", 10),
        (None, prose(5, 40), "en", "b", 10),
        (None, None, None, None, None),
        (14, prose(6, 20), "en", "b", 10),
        (14, prose(6, 20), "en", "b", 10),
        (15, "Ünïcödé 🦄 тест " * 30, "xx", "d", 10),
        (15, prose(7, 30), "en", "d", 10),
        (-3, prose(8, 25) + " " + prose(3, 30), "en", "d", 10),
        (1 << 60, prose(3, 60), "en", "e", 10),
    ]
    return [*made, *((100 + i, prose(200 + i % 7, 25 + i % 5), "en", "abc"[i % 3], 1) for i in range(40))]


def docs(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), DOCS)
    return with_extra(df) if extra else df


def with_extra(df):
    """More columns, with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "id fp key component_id _id _key _text _hash _keep _groups _number _order _taken _words _size _source _p _host _path host path posterior evidence s_sum s_n bucket place part shard slot position size target taken text_hash _text_hash _bad item windows words hash least n at row _at _range _before _base label url rule verdict _spans base terms spans".split()
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)

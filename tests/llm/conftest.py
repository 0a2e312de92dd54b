import random

import pytest
from pyspark.sql import functions as F

EN = "the of and to in that with for was is house river stone bright window garden".split()
DE = "der die und das nicht mit für straße über schön häuser königin wäre möglich größe".split()
FR = "le la de et que pour dans être fenêtre élève garçon forêt château où été".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    """Three languages, copies, near copies, odd texts, a repeated row and a null id."""
    rng = random.Random(11)
    rows = []
    for i in range(90):
        words = {"en": EN, "de": DE, "fr": FR}[lang := ("en", "de", "fr")[i % 3]]
        text = " ".join(rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(rng.randint(30, 60)))
        rows.append((i, text, lang, "src0" if i % 2 else "src1"))
    base = rows[0][1].split()
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "src0") for k in range(3, 9)]
    rows += [(120 + k, rows[1][1], "de", "src0") for k in range(4)]
    rows += [(130, None, None, None), (131, "", "en", "s"), (132, " \n\t ", "en", "s"), (133, "word", "en", "s"), (134, "Word", "en", "s"), (135, "12 + 34 = 46", None, "s"), (136, "x" * 50_000 + " " + "ab cd " * 9000, "en", "s"), (137, rows[2][1], "fr", "s"), (137, rows[2][1], "fr", "s"), (None, "lost and found in the garden", "en", "s")]
    return [(*r, len(r[1]) if r[1] else 0) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    # Extra columns whose names the operators use themselves.
    df = spark.createDataFrame(corpus(), SCHEMA)
    for c in ("w", "words", "n", "h1", "k", "key", "spans", "rate", "p", "copies", "component_id", "kept", "tokens", "sketch", "item", "span", "m"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()

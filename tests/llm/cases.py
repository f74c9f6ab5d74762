"""Small tables that every operator must stand: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0, vocabulary=40):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(vocabulary // 10)) for _ in range(n))


def texts():
    shared = words(45, 1)
    a, b, c = words(80, 2), words(60, 3), words(400, 4)
    return [
        a,
        a,
        a.replace("alpha1", "omega", 1),
        b + "\n" + shared,
        shared + " tail",
        "x " + shared + " y\t\x0b " + words(30, 5),
        "",
        None,
        "   \n\t ",
        "one",
        "One",
        "two words",
        words(25, 6) * 3,
        c,
        c + " " + words(7, 8),
        "é ü ß 漢字   nbsp 　 wide  double  spaces \n\n lines \r\n end ",
        "don't 'quote' #tag <b> [INST] </s> <|endoftext|> 123,456",
        ("long " * 30000) + words(3000, 9),
    ]


def documents(spark, extra=True):
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators might use themselves
        df = df.withColumns({c: F.lit("clash") for c in ("id", "chunk", "row", "fp", "key", "items", "spans", "n_words", "bucket", "words", "score", "label", "h", "n")})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)

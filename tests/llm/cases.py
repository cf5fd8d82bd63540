"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "se", "ra") for b in ("n", "st", "r", "l") for c in ("a", "en", "ing", "or", "ity")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[50] = "changed"
    out = [
        (0, base), (1, base), (2, " ".join(near)), (3, prose(2, 300)), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "One TWO three"),
        (9, prose(3, 40) + " " + base), (10, prose(4, 20_000)), (11, "x" * 200_000), (12, "naïve 東京 — “quoted” 123,456   end"), (13, base.upper()), (13, base.upper()),
        (None, base), (14, prose(5, 30) + " " + prose(2, 300)[:400]), (15, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40), (16, "\r\n\r\n  tabs\tand\x0bmore\x0c  "),
    ]
    return out


def documents(spark, data=None, extra=False):
    data = rows() if data is None else data
    d = spark.createDataFrame([(i, t, "en" if k % 2 else None, f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "N_WORDS", "kept", "n_tokens", "contaminated", "component_id", "severity", "lang_pred"):
            d = d.withColumn(name, F.lit("mine"))
    return d


def empty(spark):
    return documents(spark, [])

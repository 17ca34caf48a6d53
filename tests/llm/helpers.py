"""Small document tables with the awkward cases every operator must take."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
EXTRA = ["row", "fp", "key", "bundle", "unit", "spans", "cut_here", "_cut_here", "base", "found", "score", "start", "host"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """(doc_id, text, lang, source, n_chars): null and empty values, a very long
    text, repeated rows, repeated and null doc_ids."""
    rng = random.Random(seed)
    body = words(rng, 80)
    rows = [
        (1, body, "en", "a", len(body)),
        (2, body, "en", "b", len(body)),
        (2, body, "en", "b", len(body)),
        (2, words(rng, 60), None, "b", None),
        (None, words(rng, 50), "en", None, 5),
        (None, None, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, words(rng, 30_000, 2000), "de", "c", 1),
        (7, "ñandú 漢字 🙂 " * 20, "es", "c", 2),
        (8, "x" * 5000, "en", "a", 5000),
        (9, "one", "en", "a", 3),
    ]
    return rows + [(100 + i, words(rng, rng.randrange(1, 120)), "en", f"s{i % 5}", None) for i in range(25)]


def frame(spark, rows, extra=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)]) if extra else df

"""Small frames with awkward rows, shared by the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, fp string, hits int, score double, tag long"


def frame(spark, rows):
    """documents of (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 0.5, 3) for i, t in rows], SCHEMA)


def long_text(n=3000, seed=0):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (None, "one two three"), (3, "one two three"), (3, "one two three"), (4, "É ü x\n\n\ty"), (5, long_text()), (6, " "), (7, "word"), (None, None)]

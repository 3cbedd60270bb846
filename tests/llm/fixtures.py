"""Small documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, h string, shared string, masked string"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "and", "ing", "tion", "or", "es", "re", "an", "th", "ou"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    texts = [(0, words(200, 1)), (1, words(200, 1)), (2, words(199, 1) + " changed"), (3, ""), (4, None), (5, " \n\t "), (6, words(20_000, 2)), (7, words(60, 3) + "\n" + words(60, 4)), (8, words(60, 5) + " " + words(60, 4)), (9, "Ünïcödé ß 中文 \U0001f600 it's"), (None, words(80, 6)), (10, words(80, 7)), (10, words(80, 7)), (11, "!!! 123"), (12, "one")]
    return [(i, t, None if k == 2 else ("en", "de", "fr", "es")[k % 4], None if k == 1 else f"src{k % 3}", None if t is None else len(t), 7, "x", "y", "z") for k, (i, t) in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)

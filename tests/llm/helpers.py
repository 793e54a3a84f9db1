"""Small tables with the odd cases that every operator must stand."""

LONG = "word%d and more of them, " * 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed: int, words: int = 40) -> str:
    """Plain words that no other seed has."""
    return " ".join(f"w{seed}x{i}" for i in range(words))


def docs(spark, texts, schema=DOCS, first=1):
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], schema)


ODD = [None, "", "   \n\t", "a", "one two three", "same text here for two rows", "same text here for two rows", "Ünïcödé ß 日本語 😀", "x" * 50_000, "many words " * 20_000]


def odd(spark):
    """Nulls, empty, blank, very long, equal and repeated rows, with columns whose names operators use themselves."""
    rows = [(i, t, None if i % 2 else "en", None, i, "s", 1, i) for i, t in enumerate(ODD, 1)] + [(1, None, "en", None, 1, "s", 1, 1), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, digest int, id long")


def empty(spark):
    return odd(spark).limit(0)

"""Awkward documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, fingerprint string"
PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven sailors sing old songs about the distant sea and its many storms."


def awkward(spark, extra=()):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    texts = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, PROSE), (5, PROSE), (None, PROSE), (None, None), (6, "word " * 30_000), (7, "x" * 200_000), (8, "é ü ß 漢字 \U0001f600 end."), *extra]
    rows = [(i, t, None, "s", None if t is None else len(t), "clash", None, "f") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

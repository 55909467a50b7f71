"""Small document tables that every operator of this folder must bear."""

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", 0.5),
    (2, None, "en", None),
    (3, "", "en", 0.0),
    (4, " \t\n\r\x0b\x0c ", None, 1.0),
    (None, "No id at all, only a text of some words", "en", 2.0),
    (5, "ein", "de", 3.0),
    (6, "É É é 漢字 💥 ß ǅ  x y", None, 4.0),
    (1, "The quick brown fox jumps over the lazy dog.", "en", 0.5),
    (7, "a" * 5000, "en", 5.0),
    (8, "word other " * 30000, "en", 6.0),
    (9, "the quick brown fox jumps over the lazy dog.", "en", 7.0),
    (10, "\x00\x1f null and controls \u0085  ", "en", 7.0),
]
#: Further columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, fp string, score double"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

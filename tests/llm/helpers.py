"""Small documents tables with the awkward cases every operator has to take."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "one", "en", "b", 3),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 1),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 1),
    (None, "no id here at all", None, "a", 1),
    (7, "ünï cödé 漢字   wörter\x0bvt " * 9, "de", "b", 1),
    (8, "long " * 30000, "en", "c", 1),
]


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows=None):
    """With columns whose names clash with inner ones."""
    df = spark.createDataFrame(AWKWARD if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "doc_id as fp", "source as size", "1 as cell", "'x' as target", "2 as weight", "3 as row", "4 as start")

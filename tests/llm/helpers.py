"""Small documents with every kind of row that operators must bear."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *[None, None][len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "two words"), (6, LONG), (7, "same text in two rows here"), (7, "same text in two rows here"), (None, "a row without an id of its own")]


def clashing(frame):
    """frame with columns whose names operators might use for themselves."""
    for name in ("size", "key", "range", "node", "n", "id", "unit", "score", "token", "at", "component", "path", "row", "p", "plan", "copies", "copy", "__size", "__key", "__plan", "__id", "__n", "__lang", "block", "wanted", "bucket", "place", "same", "kind"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)

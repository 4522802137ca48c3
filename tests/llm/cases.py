"""Small documents with the odd cases that every operator must take."""

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, k int, q string, bucket string"
LONG = " ".join(f"word{i % 977}x{i // 7}" for i in range(4000))
PROSE = "In the morning the old clock of the tower struck seven and nobody in the narrow street looked up because it always ran late"


def documents(spark, *more):
    """Null, empty, very long and repeated texts, ties, null keys, and columns whose names the operators use inside."""
    texts = [None, "", LONG, PROSE, PROSE, PROSE + " today", "ä ß é", "a", " \n\t ", "one two", "x" * 5000, *more]
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), 7, 1, "q", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "lost key", None, None, None, 1, 1, "", "")], DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)

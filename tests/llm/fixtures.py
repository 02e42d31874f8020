"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, h long, place int, block long"
LONG = " ".join(f"word{i % 977} #{i % 13}" for i in range(20_000))
LINES = "one two three four five six seven eight nine ten\n" * 9 + "tail"
TEXTS = [
    (0, "a b c", "s1"), (1, None, "s1"), (2, "", None), (3, LINES, "s2"), (4, LINES, "s2"), (4, LINES, "s2"), (5, LONG, "s3"),
    (6, "  \t\n ", "s3"), (7, "é ü x y #a$ <b>", "s4"), (8, "x " * 500, "s1"), (None, "no id here at all", "s2"), (9, LONG + " end", "s3"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 8, 9, 10) for i, t, s in rows], DOCS_SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)

"""Rows that every operator over documents has to take: nulls, empty and long texts, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("many words of one very long text " * 3000).strip()
ROWS = [
    (1, "Plain words stand here, more than five of them.", "en", "a", 47),
    (1, "Plain words stand here, more than five of them.", "en", "a", 47),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n \n", None, "b", 5),
    (None, "A row without an id but with words.", "en", None, 35),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 50_000, "de", "a", 50_000),
    (7, "¡Señor! ¿Qué? 你好 🎉 nbsp ﻿bom \x00 nul", "es", "c", 40),
    (1, "Another text under the same id.", "en", "a", 31),
]


def documents(spark, clashing: bool = False):
    df = spark.createDataFrame(ROWS, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        names = ["k1", "k2", "words", "hits", "near", "row", "_row", "n", "v", "set", "size", "target", "copies", "score", "pos", "label", "rank", "n_lines", "n_dropped", "spans"]
        df = df.withColumns({n: F.lit(7) for n in names})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

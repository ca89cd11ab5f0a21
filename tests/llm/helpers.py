"""Small tables with the awkward rows that every operator must stand."""

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog " * 8, "s0"),
    (2, "the quick brown fox jumps over the lazy dog " * 8, "s0"),
    (3, None, "s1"),
    (4, "", None),
    (5, "one", "s1"),
    (5, "one", "s1"),
    (None, "no id here but words", "s0"),
    (6, "\n\n \t\n", "s2"),
    (7, "x" * 5000, "s2"),
    (8, "tab\tand\x0bvertical\x0cform\rreturn 😀 é ▁ \\ <s> [INST]", "s2"),
    (9, "long words of text again and again " * 4000, "s0"),
]


def documents(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if not extra:
        return df
    from pyspark.sql import functions as F

    # Columns whose names an operator might use itself.
    return df.withColumns({n: F.lit(1) for n in ("shard", "slot", "label", "key", "position", "kept", "n_words", "set", "rep")})

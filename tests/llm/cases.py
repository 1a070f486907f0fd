"""Small tables with the cases that every operator must take."""

CLASHING = ("ids", "digest", "locator", "key", "start", "length", "class_id", "token", "word", "cell", "block", "rank", "_kept", "batch", "part", "spans", "host", "found")

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards make toxic brew for the evil queen and jack".split()


def texts() -> list[tuple]:
    """(doc_id, text, lang)"""
    long = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] + str(i % 13) for i in range(6000))
    base = [WORDS[(i * 5) % len(WORDS)] + str(i) for i in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    far = base[:30] + ["x", "y", "z"] * 10 + base[60:]
    rows = [
        (0, " ".join(base), "en"), (1, None, "en"), (2, "", None), (3, " ".join(base), "en"), (4, " ".join(near), "en"), (5, " ".join(far), "fr"),
        (6, long, "en"), (7, long, None), (8, "  two   spaces\n\n and\ttabs ", "en"), (9, "😀 é́ ñ 日本語 1234", None), (10, "12 34 !!", "en"), (10, "12 34 !!", "en"),
        (None, "no identifier", "en"), (12, "<|endoftext|> it's password= \"abcdefghijkl\"", "en"), (13, "short", "en"), (14, "Short", "en"), (15, "\u00a0", None),
    ]
    return rows


def documents(spark, path=None, rows=None):
    """The cases as a table with extra columns of clashing names; read from files if a path is given."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string, lang string")
    frame = frame.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit(None).cast("string") for c in CLASHING}})
    if path is None:
        return frame
    frame.repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))

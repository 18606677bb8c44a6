"""Small document tables with the odd cases every operator must take."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, uid string"

ODD = [
    (5, None, "en", "s", 0, 0.5, "x"),
    (6, "", "en", "s", 0, 0.5, "x"),
    (7, " \n\t ", None, None, None, None, None),
    (None, "no id here", "en", "s", 1, 0.1, "y"),
    (8, "twice the same row", "en", "s", 3, 0.1, "y"),
    (8, "twice the same row", "en", "s", 3, 0.1, "y"),
    (8, "same id, other text", "de", "t", 3, 0.1, "y"),
    (9, "It's 12 ½ Ünïcödé — ΟΔΟΣ <|endoftext|> ### word###, Ⅷ x²y\x1cz", "fr", "t", 3, 0.1, "y"),
    (10, "longer text with words " * 2500, "es", "t", 3, 0.1, "y"),
    (11, "a" * 30000, "es", "t", 3, 0.1, "y"),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(name=SF):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{name}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))

"""Small documents with the cases that every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, kept string, words string"


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, None, s, None, "x", "y", None) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows(df):
    return [tuple(r) for r in df.collect()]
